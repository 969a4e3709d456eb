"""Queries over fetch policy, schedules, proxies and texts of lists. Oracles spell out every fixed value."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import fetch_policy, jobs, proxies, schedules
from . import views
from .registry import query
from .views import AS_OF, WITH, table

_NOW = f"TIMESTAMP '{AS_OF}'"
# kinds of a row by its number, in Spark and in SQL
_FREQUENCIES = ["daily", "weekly", "biweekly", "monthly", "hourly"]
_STRATEGIES = ["basic_http", "headless_browser", "headless_proxy", "playwright", "lightpanda", "unknown"]
_DOMAINS = ["linkedin.com", "sales.linkedin.com", "www.linkedin.com", "a.org", "linkedin.com.evil.org"]
_TITLES = ["CTO", "Director of Sales", "VP Marketing, EMEA", "Head of Data", "Gardener", " Recruiter ", "Senior Software Engineer"]


def _now():
    return F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")


def _of(values: list[str], key: str = "id"):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _sql(values: list[str], key: str = "id") -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST({key} % {len(values)} + 1 AS INT)]"


def _tracked(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("is_active"))
    return rows.select(
        "id", F.concat(F.lit("d"), F.col("id").cast("string")).alias("domain"), _of(_FREQUENCIES).alias("frequency"), "is_active",
        (_now() + F.make_dt_interval(hours=(F.col("id") % 49 - 24).cast("int"))).alias("next_run_at"), (F.col("id") % 4).cast("int").alias("consecutive_failures"), F.lit(None).cast("timestamp_ntz").alias("last_run_at"))


_T = f"WITH t AS (SELECT c_custkey AS id, 'd' || c_custkey AS domain, {_sql(_FREQUENCIES, 'c_custkey')} AS frequency, c_acctbal > 0 AS is_active, {_NOW} + to_hours(c_custkey % 49 - 24) AS next_run_at, CAST(c_custkey % 4 AS INT) AS consecutive_failures FROM customer) "
_DAYS = "CASE frequency WHEN 'daily' THEN 1 WHEN 'weekly' THEN 7 WHEN 'biweekly' THEN 14 WHEN 'monthly' THEN 30 ELSE 7 END"


@query("x29_next_runs", _T + f"SELECT id, {_NOW} + to_days({_DAYS}) AS next_at FROM t")
def x29_next_runs(spark, sf_dir):
    """The next run by frequency; unknown ones are weekly."""
    return _tracked(spark, sf_dir).select("id", schedules.next_run(F.col("frequency"), _now()).alias("next_at"))


@query("x31_backoff", _T + f"SELECT id, {_NOW} + to_seconds(least({_DAYS} * 86400.0 * pow(2, consecutive_failures), 86400.0)) AS next_at FROM t")
def x31_backoff(spark, sf_dir):
    return _tracked(spark, sf_dir).select("id", (_now() + schedules.backoff(F.col("frequency"), F.col("consecutive_failures"))).alias("next_at"))


@query("f06_due_searches", _T + f"SELECT id FROM t WHERE is_active AND next_run_at <= {_NOW}")
def f06_due_searches(spark, sf_dir):
    return schedules.due(_tracked(spark, sf_dir), _now()).select("id")


@query("p17_after_runs", _T + f"""SELECT domain, CASE WHEN id % 3 = 0 THEN {_NOW} + to_days({_DAYS}) WHEN id % 3 = 1 THEN {_NOW} + to_seconds(least({_DAYS} * 86400.0 * pow(2, consecutive_failures + 1), 86400.0)) ELSE next_run_at END AS next_run_at,
CAST(CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN consecutive_failures + 1 ELSE consecutive_failures END AS INT) AS consecutive_failures, CASE WHEN id % 3 = 0 THEN {_NOW} END AS last_run_at FROM t""")
def p17_after_runs(spark, sf_dir):
    """Tracked domains after good runs, bad runs and none; without jitter, which SQL lacks the hash for."""
    rows = _tracked(spark, sf_dir)
    runs = rows.where("id % 3 < 2").select("domain", (F.col("id") % 3 == 0).alias("ok"))
    return schedules.after_run(rows, runs, _now(), seed=None).drop("frequency")


@query("p18_after_searches", _T + f", r AS (SELECT o_custkey AS id, count(*) AS runs, sum(o_orderkey % 5) AS domains FROM orders GROUP BY 1) SELECT t.id, CASE WHEN runs > 0 THEN {_NOW} + to_days({_DAYS}) ELSE next_run_at END AS next_run_at, consecutive_failures + coalesce(runs, 0) AS total_runs, t.id * 10 + coalesce(domains, 0)::BIGINT AS total_domains FROM t LEFT JOIN r ON t.id = r.id")
def p18_after_searches(spark, sf_dir):
    """Tracked searches after their runs; an order stands for a run."""
    searches = _tracked(spark, sf_dir).withColumn("total_runs", F.col("consecutive_failures").cast("long")).withColumn("total_domains", F.col("id") * 10)
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 5).alias("domains"))
    return schedules.after_search(searches, runs, _now()).drop("frequency")


@query("k03_tracked", _T + f""", c AS (SELECT id, 'd' || CASE WHEN id % 2 = 0 THEN id ELSE id + 100000 END AS domain, 'daily' AS frequency FROM t WHERE id % 5 = 0)
SELECT domain, frequency, is_active, next_run_at FROM t WHERE domain NOT IN (SELECT domain FROM c) UNION ALL SELECT domain, 'daily', true, {_NOW} + to_days(1) FROM c""")
def k03_tracked(spark, sf_dir):
    """An upsert of tracked domains, which makes them active again."""
    rows = _tracked(spark, sf_dir)
    changed = F.concat(F.lit("d"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 100_000).cast("string"))
    changes = rows.where("id % 5 = 0").select(changed.alias("domain"), F.lit("daily").alias("frequency"), F.col("id").alias("seq"))
    return schedules.tracked_domains(rows, changes, _now())


@query("c30_enqueued", _T + f"SELECT domain, 'pending' AS status, {_NOW} AS created_at FROM t WHERE is_active AND next_run_at <= {_NOW}")
def c30_enqueued(spark, sf_dir):
    """Jobs of the domains that are due."""
    return schedules.enqueued(_tracked(spark, sf_dir), _now(), "domain")[0]


@query("c31_rescheduled", _T + f"SELECT id, CASE WHEN is_active AND next_run_at <= {_NOW} THEN {_NOW} + to_days({_DAYS}) ELSE next_run_at END AS next_run_at FROM t")
def c31_rescheduled(spark, sf_dir):
    """Tracked searches once the due ones are queued."""
    return schedules.enqueued(_tracked(spark, sf_dir), _now(), "id")[1].select("id", "next_run_at")


@query("k16_bulk_jobs", f"SELECT n_nationkey AS pos, n_name AS domain, 6 AS types, 'pending' AS status, {_NOW} + to_seconds(n_nationkey * 30) AS start_at FROM nation")
def k16_bulk_jobs(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("domain"))
    return schedules.bulk_jobs(rows, _now()).select("pos", "domain", F.size("data_types").alias("types"), "status", "start_at")


@query("x37_costs", WITH + "SELECT domain, round(sum(CASE id % 3 WHEN 0 THEN 0.001 WHEN 1 THEN 0.003 ELSE 0.0035 END::DOUBLE), 6) AS cost FROM v_jobs GROUP BY 1")
def x37_costs(spark, sf_dir):
    """What fetching a domain has cost, by tier."""
    cost = fetch_policy.tier_cost(_of(fetch_policy.TIERS))
    return views.jobs(spark, sf_dir).groupBy("domain").agg(F.round(F.sum(cost), 6).alias("cost"))


@query("x38_tiers", f"SELECT c_custkey AS id, CASE {_sql(_STRATEGIES, 'c_custkey')} WHEN 'basic_http' THEN 'lightpanda' WHEN 'headless_browser' THEN 'playwright' WHEN 'headless_proxy' THEN 'playwright_proxy' WHEN 'playwright' THEN 'playwright' WHEN 'lightpanda' THEN 'lightpanda' END AS tier, CASE WHEN {_sql(_STRATEGIES, 'c_custkey')} = 'lightpanda' THEN 'lightpanda' ELSE 'playwright' END AS fetcher FROM customer")
def x38_tiers(spark, sf_dir):
    """Present names of tiers, and which fetcher a name gets."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return rows.select("id", fetch_policy.current_tier(_of(_STRATEGIES)).alias("tier"), fetch_policy.fetcher(_of(_STRATEGIES)).alias("fetcher"))


@query("x39_rate_limits", f"SELECT c_custkey AS id, CASE WHEN {_sql(_DOMAINS, 'c_custkey')} IN ('linkedin.com', 'sales.linkedin.com', 'www.linkedin.com') THEN 3000 ELSE 0 END AS ms FROM customer")
def x39_rate_limits(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return rows.select("id", fetch_policy.rate_limit(_of(_DOMAINS)).alias("ms"))


@query("p07_initial_tiers", f"""WITH r AS (SELECT c_custkey AS id, {_sql(_DOMAINS, 'c_custkey')} AS domain, CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey % 3 = 1 END AS auth, c_custkey % 80 AS requests, CASE WHEN c_custkey % 7 > 0 THEN {_sql(_STRATEGIES, 'c_custkey')} END AS last FROM customer)
SELECT id, CASE WHEN domain IN ('linkedin.com', 'sales.linkedin.com', 'www.linkedin.com') AND auth AND requests < 50 THEN 'playwright' WHEN domain IN ('linkedin.com', 'sales.linkedin.com', 'www.linkedin.com') AND auth THEN 'playwright_proxy'
WHEN last = 'headless_browser' OR last = 'playwright' THEN 'playwright' WHEN last = 'headless_proxy' THEN 'playwright_proxy' ELSE 'lightpanda' END AS tier FROM r""")
def p07_initial_tiers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    session = F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey") % 3 == 1)
    return rows.select("id", fetch_policy.initial_tier(_of(_DOMAINS), session, F.col("id") % 80, F.when(F.col("id") % 7 > 0, _of(_STRATEGIES))).alias("tier"))


@query("p02_escalations", WITH + "SELECT id, status_code IN (403, 429, 503) OR latency < 20 OR id % 10 = 0 AS escalate, CASE WHEN (status_code IN (403, 429, 503) OR latency < 20) AND id % 10 = 0 THEN 'blocked_flag, captcha' WHEN status_code IN (403, 429, 503) OR latency < 20 THEN 'blocked_flag' WHEN id % 10 = 0 THEN 'captcha' ELSE 'none' END AS reason FROM v_jobs")
def p02_escalations(spark, sf_dir):
    """Whether and why a fetch goes to the next tier; latency stands for the page's length."""
    blocked, captcha = fetch_policy.is_blocked(F.col("status_code"), F.col("latency")), F.col("id") % 10 == 0
    return views.jobs(spark, sf_dir).select("id", fetch_policy.should_escalate(blocked, captcha).alias("escalate"), fetch_policy.escalation_reason(blocked, captcha).alias("reason"))


@query("p04_tier_orders", "SELECT * FROM (VALUES (true, true, 'lightpanda,playwright,playwright_proxy'), (true, false, 'lightpanda,playwright'), (false, true, 'playwright,playwright_proxy'), (false, false, 'playwright')) AS t(cheapest, proxy, tiers)")
def p04_tier_orders(spark, sf_dir):
    rows = [(a, b, ",".join(fetch_policy.tier_order(a, b))) for a in (True, False) for b in (True, False)]
    return spark.createDataFrame(rows, "cheapest boolean, proxy boolean, tiers string")


@query("p10_retries", "SELECT c_custkey AS id, least(pow(2.0, c_custkey % 9), 30.0) AS seconds FROM customer")
def p10_retries(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), fetch_policy.retry_delay(F.col("c_custkey") % 9).alias("seconds"))


@query("p15_outcomes", """WITH c AS (SELECT c_custkey AS job_id, c_custkey % 2 = 0 AS erred, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
SELECT job_id, CASE WHEN n = 0 THEN 'failed' ELSE 'completed' END AS status, n AS pages_scraped, CASE WHEN n = 0 AND erred THEN 'No data extracted. Errors: timeout; http 503' WHEN n = 0 THEN 'No data extracted from domain (empty site or blocked)' END AS error_message FROM c""")
def p15_outcomes(spark, sf_dir):
    """How jobs ended; orders stand for records."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("timeout"), F.lit("http 503"))).alias("errors"))
    return fetch_policy.outcome(rows, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id")))


@query("p16_cancelled", WITH + "SELECT id, CASE WHEN id % 3 = 0 AND status IN ('pending', 'running') THEN 'cancelled' ELSE status END AS status FROM v_jobs")
def p16_cancelled(spark, sf_dir):
    rows = views.jobs(spark, sf_dir).select("id", "status")
    return fetch_policy.cancelled(rows, rows.where("id % 3 = 0"))


@query("c04_cancelled", WITH + "SELECT id, id % 3 = 0 AND status = 'pending' AS cancelled FROM v_jobs")
def c04_cancelled(spark, sf_dir):
    rows = views.jobs(spark, sf_dir).select("id", "status")
    return jobs.is_cancelled(fetch_policy.cancelled(rows, rows.where("id % 3 = 0")), rows)


@query("f09_stale", WITH + f"SELECT id FROM v_jobs WHERE id % 2 = 0 AND coalesce(CASE WHEN id % 5 = 0 THEN created_at + INTERVAL 3 DAY END, created_at) < {_NOW} - INTERVAL 10 MINUTE")
def f09_stale(spark, sf_dir):
    """Running jobs (those of even number) without activity for ten minutes."""
    active = F.when(F.col("id") % 5 == 0, F.col("created_at") + F.expr("INTERVAL 3 DAY"))
    status = F.when(F.col("id") % 2 == 0, "running").otherwise(F.col("status"))
    return views.jobs(spark, sf_dir).where(fetch_policy.is_stale(status, active, F.col("created_at"), _now())).select("id")


_LOG = "SELECT 'p' || user_id % 40 AS url, ts AS \"at\", event_type <> 'error' AND event_type <> 'signup' AS ok, event_id AS seq FROM events"


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("url"), F.col("ts").alias("at"), (~F.col("event_type").isin("error", "signup")).alias("ok"), F.col("event_id").alias("seq"))


@query("p13_health", f"""WITH l AS ({_LOG}), n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY "at", seq) AS i FROM l), o AS (SELECT url, max(i) FILTER (ok) AS last_ok FROM n GROUP BY 1)
SELECT n.url, count(*) FILTER (ok) AS success_count, count(*) FILTER (NOT ok) AS fail_count, count(*) FILTER (i > coalesce(last_ok, 0)) AS consecutive_failures, max("at") FILTER (NOT ok) AS last_failure_at FROM n JOIN o ON n.url = o.url GROUP BY 1""")
def p13_health(spark, sf_dir):
    """The state of every proxy out of its log."""
    return proxies.health(_log(spark, sf_dir))


@query("x36_weights", f"WITH l AS ({_LOG}) SELECT url, greatest(count(*) FILTER (ok)::DOUBLE / count(*) * (1000.0 / greatest(length(url), 1)), 0.01) AS weight FROM l GROUP BY 1")
def x36_weights(spark, sf_dir):
    """Weights of proxies; the length of a name stands for its latency."""
    return proxies.health(_log(spark, sf_dir)).select("url", proxies.weight(proxies.success_rate(F.col("success_count"), F.col("fail_count")), F.length("url")).alias("weight"))


@query("p12_resting", f"SELECT c_custkey AS id, c_custkey % 8 >= 5 AND c_custkey % 600 < 300 AS rests FROM customer")
def p12_resting(spark, sf_dir):
    """Proxies that failed c % 8 times in a row, the last time c % 600 seconds ago."""
    at = _now() - F.make_dt_interval(secs=(F.col("c_custkey") % 600).cast("decimal(18,6)"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), proxies.rests(F.col("c_custkey") % 8, at, _now()).alias("rests"))


_POOLS = """SELECT n_nationkey AS org_id, CASE n_nationkey % 3 WHEN 0 THEN '[{"url": "http://a' || n_nationkey || ':1", "region": "US"}, {"server": "http://b:2", "region": "eu"}]' WHEN 1 THEN 'not json' END AS config, 'http://c:1, http://d' || n_nationkey || ':2,' AS urls FROM nation"""


def _pool(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    config = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit('[{"url": "http://a'), key, F.lit(':1", "region": "US"}, {"server": "http://b:2", "region": "eu"}]'))).when(F.col("n_nationkey") % 3 == 1, "not json")
    return proxies.pool(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("org_id"), config.alias("config"), F.concat(F.lit("http://c:1, http://d"), key, F.lit(":2,")).alias("urls")))


@query("s05_proxy_pools", """SELECT n_nationkey AS org_id, unnest([0, 1]) AS pos, CASE WHEN n_nationkey % 3 = 0 THEN unnest(['http://a' || n_nationkey || ':1', 'http://b:2']) ELSE unnest(['http://c:1', 'http://d' || n_nationkey || ':2']) END AS url, CASE WHEN n_nationkey % 3 = 0 THEN unnest(['US', 'eu']) END AS region FROM nation""")
def s05_proxy_pools(spark, sf_dir):
    """Pools of organisations: a JSON list, or else addresses between commas."""
    return _pool(spark, sf_dir)


@query("p11_candidates", """WITH p AS (SELECT n_nationkey AS org_id, unnest([0, 1]) AS pos, CASE WHEN n_nationkey % 3 = 0 THEN unnest(['http://a' || n_nationkey || ':1', 'http://b:2']) ELSE unnest(['http://c:1', 'http://d' || n_nationkey || ':2']) END AS url, CASE WHEN n_nationkey % 3 = 0 THEN unnest(['US', 'eu']) END AS region FROM nation),
r AS (SELECT c_custkey AS request_id, c_nationkey AS org_id, ['us', 'EU', 'asia', ''][CAST(c_custkey % 4 + 1 AS INT)] AS region FROM customer),
b AS (SELECT request_id, pos, url, coalesce(lower(p.region) = lower(r.region) AND r.region <> '', false) AS here FROM r JOIN p USING (org_id)),
k AS (SELECT * FROM (SELECT *, bool_or(here) OVER (PARTITION BY request_id) AS any_here FROM b) WHERE here OR NOT any_here)
SELECT request_id, pos, url, CASE WHEN url = 'http://b:2' THEN greatest(0.25 * (1000.0 / 50), 0.01) ELSE 1000.0 END::DOUBLE AS weight, url = 'http://b:2' AS rests FROM k""")
def p11_candidates(spark, sf_dir):
    """The proxies from which each request is served: of its region if there are any, with weights; one of them rests."""
    states = spark.createDataFrame([("http://b:2", 1, 3, 50, 6)], "url string, success_count long, fail_count long, avg_latency_ms long, consecutive_failures long").withColumn("last_failure_at", _now())
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_nationkey").alias("org_id"), _of(["us", "EU", "asia", ""], "c_custkey").alias("region"))
    return proxies.candidates(_pool(spark, sf_dir), states, requests, _now())


@query("j12_job_proxies", "SELECT c_custkey AS id, CASE WHEN n_nationkey % 2 = 0 AND n_regionkey > 0 THEN 'http://' || n_name END AS proxy_url FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j12_job_proxies(spark, sf_dir):
    organisations = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("org_id"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("http://"), "n_name")).otherwise("").alias("proxy_url"))
    return jobs.organisation_proxies(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("org_id")), organisations)


@query("x19_functions", f"SELECT c_custkey AS id, ['Technology', 'Sales', 'Marketing', 'Technology', NULL, 'Human Resources', 'Technology'][CAST(c_custkey % 7 + 1 AS INT)] AS function FROM customer")
def x19_functions(spark, sf_dir):
    """Functions of job titles, by whole titles and by parts of them."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), texts.job_function(_of(_TITLES, "c_custkey")).alias("function"))


@query("x17_names", "SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS first, trim(substr(p_name, length(split_part(p_name, ' ', 1)) + 1)) AS last FROM part")
def x17_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), texts.names(F.col("p_name")).alias("n")).select("id", "n.*")


@query("x32_elapsed", WITH + f"SELECT id, CASE WHEN id % 2 = 0 THEN CAST(epoch_us({_NOW}) // 1000 - epoch_us(created_at) // 1000 AS BIGINT) END AS ms FROM v_jobs")
def x32_elapsed(spark, sf_dir):
    return views.jobs(spark, sf_dir).select("id", texts.elapsed_ms(F.when(F.col("id") % 2 == 0, "running").otherwise("pending"), F.col("created_at"), _now()).alias("ms"))


@query("x33_ages", WITH + f"""SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago' WHEN s < 604800 THEN CAST(floor(s / 86400) AS BIGINT) || 'd ago' ELSE strftime(created_at, '%b %d') END AS age
FROM (SELECT id, created_at, (epoch_us({_NOW}) - epoch_us(created_at)) / 1000000.0 AS s FROM v_jobs)""")
def x33_ages(spark, sf_dir):
    return views.jobs(spark, sf_dir).select("id", texts.age(F.col("created_at"), _now()).alias("age"))


@query("x34_labels", "SELECT DISTINCT event_type AS data_type, CASE event_type WHEN 'view' THEN 'Blog URLs' WHEN 'click' THEN 'Tech Stack' WHEN 'error' THEN 'Job Posting' ELSE 'Pages' END AS label FROM events")
def x34_labels(spark, sf_dir):
    """Labels of record types; those without one of their own are their names."""
    kind = F.when(F.col("event_type") == "view", "blog_url").when(F.col("event_type") == "click", "tech_stack").when(F.col("event_type") == "error", "job_posting").otherwise("page")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("data_type"), texts.label(kind).alias("label")).distinct()


@query("x35_regions", "SELECT n_nationkey AS id, ['en-US,en;q=0.9', 'de-DE,de;q=0.9,en;q=0.8', NULL][n_nationkey % 3 + 1] AS language, ['America/New_York', 'Europe/Berlin', 'America/New_York'][n_nationkey % 3 + 1] AS zone FROM nation")
def x35_regions(spark, sf_dir):
    region = _of(["US", "de", "mars"], "n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), texts.region_language(region).alias("language"), texts.region_zone(region).alias("zone"))


@query("x40_default_titles", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Title' ELSE 'PDF: ' || regexp_extract(url, '[^/]*$') END AS title FROM pages")
def x40_default_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", texts.default_title(F.when(F.col("page_id") % 2 == 0, "Title").otherwise(""), F.col("url")).alias("title"))


@query("x07_fenced", """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '{"a": ' || c_custkey || '}' WHEN 1 THEN '[' || c_custkey || ']' END AS json FROM customer""")
def x07_fenced(spark, sf_dir):
    """JSON out of answers in fences, without them, and none."""
    key = F.col("c_custkey").cast("string")
    answer = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('```json\n{"a": '), key, F.lit("}\n```\n"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" ["), key, F.lit("] "))).otherwise(F.concat(F.lit("no {"), key))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), texts.fenced_json(answer).alias("json"))


_REFERENCES = ["/r/a", "?q=2", "#f", "//c.org/x", "https://o.org/z", "", "d", "./d", "../d?x"]
_BASE = r"regexp_extract(url, '^([^?#]*)', 1)"
_ROOT = r"regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


@query("u02_resolved", f"""SELECT page_id, CASE page_id % 9 WHEN 0 THEN {_ROOT} || '/r/a' WHEN 1 THEN {_BASE} || '?q=2' WHEN 2 THEN regexp_extract(url, '^([^#]*)', 1) || '#f' WHEN 3 THEN regexp_extract(url, '^([a-z]+:)', 1) || '//c.org/x'
WHEN 4 THEN 'https://o.org/z' WHEN 5 THEN url WHEN 8 THEN {_ROOT} || coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), '/[^/]+/[^/]*$', '/'), regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1)), '/') || 'd?x'
ELSE {_ROOT} || regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), '[^/]*$', '') || 'd' END AS resolved FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/]+/')""")
def u02_resolved(spark, sf_dir):
    """References of all kinds against each page's address."""
    from ..functions import urls

    rows = table(spark, sf_dir, "pages").where("url rlike '^[a-z]+://[^/]+/'")
    return rows.select("page_id", urls.resolve_url(F.col("url"), _of(_REFERENCES, "page_id")).alias("resolved"))


@query("x12_error_titles", "SELECT page_id, page_id % 4 < 2 AS error FROM pages")
def x12_error_titles(spark, sf_dir):
    from ..functions import html

    return table(spark, sf_dir, "pages").select("page_id", html.is_error_title(_of(["Page Not Found", "Error 5", "Welcome", "About"], "page_id")).alias("error"))


@query("x18_full_names", "SELECT c_custkey AS id, ['Ada B', 'Ada', 'B', NULL][CAST(c_custkey % 4 + 1 AS INT)] AS name FROM customer")
def x18_full_names(spark, sf_dir):
    first, last = F.when(F.col("c_custkey") % 4 < 2, "Ada"), F.when(F.col("c_custkey") % 2 == 0, "B")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 3, F.lit(None)).otherwise(texts.full_name(first, last)).alias("name"))


@query("x21_numbers", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey * 1000 AS VARCHAR) WHEN 1 THEN c_custkey || '.5' ELSE 'n/a' END AS value FROM customer")
def x21_numbers(spark, sf_dir):
    """Numbers as they are written, with marks, or left as they are."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("$"), k.cast("string"), F.lit(",000"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".5"))).otherwise("n/a")
    return table(spark, sf_dir, "customer").select(k.alias("id"), texts.coerced_number(text).alias("value"))


@query("x24_json_paths", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def x24_json_paths(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("x25_json_search", "SELECT event_id FROM events WHERE props ILIKE '%7%'")
def x25_json_search(spark, sf_dir):
    """Records whose JSON holds a term anywhere."""
    return table(spark, sf_dir, "events").where(F.col("props").ilike("%7%")).select("event_id")


@query("x26_notices", """SELECT event_id AS key, '{"id":' || event_id || ',"job_id":' || user_id || ',"domain":"d","data_type":"' || event_type || '","url":"u"}' AS value FROM events""")
def x26_notices(spark, sf_dir):
    """What a listener is told of each new record, as the stream tells it."""
    from ..streaming import feeds

    rows = table(spark, sf_dir, "events").selectExpr("event_id AS id", "user_id AS job_id", "'d' AS domain", "event_type AS data_type", "'u' AS url")
    return feeds.inserts(rows).select(F.col("key").cast("long").alias("key"), "value")


@query("s21_signatures", "SELECT * FROM (VALUES ('cms', 9), ('analytics', 7), ('marketing', 11), ('framework', 7), ('cdn', 6), ('js_library', 4)) AS t(category, n)")
def s21_signatures(spark, sf_dir):
    """The catalog of technologies as a relation."""
    from ..functions import html

    return html.signatures(spark).groupBy("category").agg(F.count("*").cast("int").alias("n"))


@query("x28_schema_specs", """SELECT * FROM (VALUES (false, '{"type": "object", "properties": {"name": {"type": "string"}, "price": {"type": "number"}}, "description": "Extract these fields from the content."}'),
(true, '{"type": "array", "items": {"type": "object", "properties": {"name": {"type": "string"}, "price": {"type": "number"}}}, "description": "Extract one object per item."}')) AS t(listed, spec)""")
def x28_schema_specs(spark, sf_dir):
    """Schemas of fields as JSON specifications."""
    from ..operators import extraction

    schema = [extraction.Field("name", "h2"), extraction.Field("price", ".price", kind="number", required=True)]
    return spark.createDataFrame([(x, extraction.specification(schema, listed=x)) for x in (False, True)], "listed boolean, spec string")
