"""Queries behind lists, searches, queues and summaries; limits are those of the lists themselves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import records
from . import views
from .registry import query
from .views import AS_OF, WITH, table

_NOW = f"TIMESTAMP '{AS_OF}'"


def _now():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("f02_results", WITH + "SELECT id, domain, data_type FROM v_records WHERE data_type <> 'page'")
def f02_results(spark, sf_dir):
    """Records as listed without a type or search term: no pages."""
    return views.records(spark, sf_dir).where("data_type <> 'page'").select("id", "domain", "data_type")


@query("f02_search", "SELECT doc_id, source FROM documents WHERE text ILIKE '%the%' OR lang ILIKE '%the%' OR source ILIKE '%the%'")
def f02_search(spark, sf_dir):
    """Records in which a term occurs in any searched column, without regard to case."""
    hit = F.lit(False)
    for c in ("text", "lang", "source"):
        hit = hit | F.coalesce(F.col(c).ilike("%the%"), F.lit(False))
    return table(spark, sf_dir, "documents").where(hit).select("doc_id", "source")


@query("f03_export_rows", WITH + "SELECT id, domain, status, created_at FROM v_jobs ORDER BY created_at DESC, id DESC LIMIT 10000")
def f03_export_rows(spark, sf_dir):
    """The newest 10,000 rows, pages included."""
    return views.jobs(spark, sf_dir).select("id", "domain", "status", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(10_000)


@query("f04_by_domain", WITH + "SELECT id, domain, status FROM v_jobs WHERE domain = 'site7.example.com' ORDER BY created_at DESC, id DESC LIMIT 100")
def f04_by_domain(spark, sf_dir):
    rows = views.jobs(spark, sf_dir).where("domain = 'site7.example.com'")
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(100).select("id", "domain", "status")


@query("f05_due_domains", WITH + f"SELECT domain FROM v_jobs GROUP BY domain HAVING max(created_at) + INTERVAL 3 HOUR <= {_NOW} AND bool_or(status = 'completed')")
def f05_due_domains(spark, sf_dir):
    """Active domains whose next run, three hours after the last, is due."""
    last = views.jobs(spark, sf_dir).groupBy("domain").agg(F.max("created_at").alias("at"), F.bool_or(F.col("status") == "completed").alias("active"))
    return last.where(F.col("active") & (F.col("at") + F.expr("INTERVAL 3 HOUR") <= _now())).select("domain")


@query("f07_recent_domains", WITH + f"SELECT domain, max(created_at) AS last_at FROM v_jobs WHERE status = 'completed' GROUP BY domain HAVING max(created_at) >= {_NOW} - INTERVAL 2 DAY")
def f07_recent_domains(spark, sf_dir):
    last = views.jobs(spark, sf_dir).where("status = 'completed'").groupBy("domain").agg(F.max("created_at").alias("last_at"))
    return last.where(F.col("last_at") >= _now() - F.expr("INTERVAL 2 DAY"))


@query("f08_queued", WITH + f"SELECT DISTINCT domain FROM v_jobs WHERE status IN ('pending', 'running') AND created_at > {_NOW} - INTERVAL 10 DAY AND domain IN ('site1.example.com', 'site2.example.com', 'site3.example.com')")
def f08_queued(spark, sf_dir):
    """Those of some domains that are queued already."""
    rows = views.jobs(spark, sf_dir).where(F.col("status").isin("pending", "running") & (F.col("created_at") > _now() - F.expr("INTERVAL 10 DAY")))
    return rows.where(F.col("domain").isin([f"site{k}.example.com" for k in (1, 2, 3)])).select("domain").distinct()


@query("f12_expired", f"SELECT event_id, ts + INTERVAL 1 DAY < {_NOW} AS expired FROM events")
def f12_expired(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL 1 DAY") < _now()).alias("expired"))


@query("f11_owned", WITH + "SELECT id, domain FROM v_jobs WHERE user_id = 7")
def f11_owned(spark, sf_dir):
    """What a user who is no administrator sees."""
    return records.tenant_scope(views.jobs(spark, sf_dir), 7).select("id", "domain")


@query("j02_active_keys", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND o_orderstatus <> 'F' AND c_acctbal > 0")
def j02_active_keys(spark, sf_dir):
    """Keys that are active, with their users, of active users only."""
    users = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").join(users, "o_custkey").select("o_orderkey", "c_name")


@query("j03_without_duplicates", "SELECT a.event_id FROM events a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND (b.ts > a.ts OR (b.ts = a.ts AND b.event_id > a.event_id)))")
def j03_without_duplicates(spark, sf_dir):
    """The newest row of each key. An aggregate with map-side partials, where a self-join would square a hot key."""
    newest = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return newest.select("m.event_id")


@query("j04_children", "SELECT o_orderkey, count(l_orderkey) AS children, coalesce(sum(l_quantity), 0) AS cost FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j04_children(spark, sf_dir):
    """Parents with figures of their children, which are summed up before the join."""
    children = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("children"), F.sum("l_quantity").alias("cost"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(children, "o_orderkey", "left").na.fill({"children": 0, "cost": 0.0})


@query("j06_domain_health", WITH + "SELECT domain, count(*) AS jobs, count(*) FILTER (status = 'failed') AS failed FROM v_jobs WHERE domain IN (SELECT DISTINCT domain FROM v_jobs ORDER BY 1 LIMIT 5) GROUP BY 1")
def j06_domain_health(spark, sf_dir):
    """Figures of the first five tracked domains, in one join and not one query each."""
    jobs = views.jobs(spark, sf_dir)
    five = jobs.select("domain").distinct().orderBy("domain").limit(5)
    return jobs.join(F.broadcast(five), "domain", "left_semi").groupBy("domain").agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "failed").alias("failed"))


@query("j08_badges", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS tracked FROM customer")
def j08_badges(spark, sf_dir):
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("tracked", F.lit(True))
    return table(spark, sf_dir, "customer").select("c_custkey").join(known, "c_custkey", "left").na.fill({"tracked": False})


@query("a02_count_by_job", WITH + "SELECT user_id, count(*) AS n FROM v_jobs GROUP BY 1")
def a02_count_by_job(spark, sf_dir):
    return views.jobs(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))


@query("a03_types_without_pages", WITH + "SELECT lang, data_type, count(*) AS n FROM v_records WHERE data_type <> 'page' GROUP BY 1, 2")
def a03_types_without_pages(spark, sf_dir):
    return views.records(spark, sf_dir).where("data_type <> 'page'").groupBy("lang", "data_type").agg(F.count("*").alias("n"))


@query("a12_rollup", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus = 'P') AS partial FROM orders GROUP BY 1")
def a12_rollup(spark, sf_dir):
    """Counts of children by status."""
    counts = [F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("O", "open"), ("F", "failed"), ("P", "partial"))]
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*counts)


@query("a15_benchmark", WITH + "SELECT status, count(*) AS n, count(*) FILTER (status_code = 200) AS ok, round(avg(latency), 6) AS mean, round(sum(latency), 4) AS total, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, round(quantile_cont(latency, 0.99), 6) AS p99 FROM v_jobs GROUP BY 1")
def a15_benchmark(spark, sf_dir):
    """Counts, mean, total and percentiles of each tier; a status stands for a tier."""
    p = [F.round(F.percentile("latency", q), 6).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)]
    return views.jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("status_code") == 200).alias("ok"), F.round(F.avg("latency"), 6).alias("mean"), F.round(F.sum("latency"), 4).alias("total"), *p)


@query("a16_success_rate", "SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 1.0 ELSE CAST(count(*) FILTER (o_orderstatus = 'O') AS DOUBLE) / count(o_orderkey) END AS rate FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a16_success_rate(spark, sf_dir):
    """Successes over all; 1 where there is nothing yet."""
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count_if(F.col("o_orderstatus") == "O") / F.count("*")).alias("rate"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(own, "c_custkey", "left").na.fill({"rate": 1.0})


@query("a17_by_strategy", WITH + f"SELECT status_code, count(*) AS n, count(*) FILTER (status = 'completed') AS ok FROM v_jobs WHERE created_at > {_NOW} - INTERVAL 5 DAY GROUP BY 1")
def a17_by_strategy(spark, sf_dir):
    rows = views.jobs(spark, sf_dir).where(F.col("created_at") > _now() - F.expr("INTERVAL 5 DAY"))
    return rows.groupBy("status_code").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("ok"))


@query("w03_first_seen_order", WITH + "SELECT domain, row_number() OVER (ORDER BY min(pos)) AS rank FROM v_hits GROUP BY domain")
def w03_first_seen_order(spark, sf_dir):
    """Distinct domains numbered as first seen: within ranges of positions, whose sizes give the offsets, so no task sorts all."""
    firsts = views.hits(spark, sf_dir).groupBy("domain").agg(F.min("pos").alias("pos")).withColumn("part", F.floor(F.col("pos") / 1_000_000))
    sizes = firsts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    k = F.row_number().over(Window.partitionBy("part").orderBy("pos"))
    return firsts.withColumn("k", k).join(before, "part").select("domain", (F.col("before") + F.col("k")).cast("long").alias("rank"))


@query("w04_distinct_hosts", "SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS host, count(*) AS n, count(*) - 1 AS duplicates FROM pages GROUP BY 1")
def w04_distinct_hosts(spark, sf_dir):
    """Hosts without case and ``www.``, with how many were duplicates."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)), r"^www\.", "")
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n"), (F.count("*") - 1).alias("duplicates"))


@query("w09_ranked_hits", WITH + "SELECT id, CASE WHEN domain = 'site1' THEN 0 WHEN domain ILIKE 'site1%' THEN 1 WHEN domain ILIKE '%site1%' THEN 2 ELSE 3 END AS rank FROM v_jobs ORDER BY rank, created_at DESC, id LIMIT 50")
def w09_ranked_hits(spark, sf_dir):
    """Search hits: equal, beginning, containing, other; then the newest."""
    rank = F.when(F.col("domain") == "site1", 0).when(F.col("domain").ilike("site1%"), 1).when(F.col("domain").ilike("%site1%"), 2).otherwise(3)
    return views.jobs(spark, sf_dir).withColumn("rank", rank).orderBy("rank", F.desc("created_at"), "id").limit(50).select("id", "rank")


@query("w10_merged_contacts", """SELECT email, profile_url, name, page, pos FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(email, profile_url, name) ORDER BY page, pos) AS n FROM (
SELECT CASE WHEN user_id % 3 = 0 THEN 'm' || user_id % 50 END AS email, CASE WHEN user_id % 3 = 1 THEN 'u' || user_id % 50 END AS profile_url, 'n' || user_id % 20 AS name, CAST(event_id % 40 + 1 AS INT) AS page, event_id AS pos FROM events) WHERE page <= 30) WHERE n = 1""")
def w10_merged_contacts(spark, sf_dir):
    """Contacts of up to 30 pages: by address, else profile, else name; the first page's one stays."""
    key = lambda text, n: F.concat(F.lit(text), (F.col("user_id") % n).cast("string"))
    rows = table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 3 == 0, key("m", 50)).otherwise("").alias("email"), F.when(F.col("user_id") % 3 == 1, key("u", 50)).alias("profile_url"), key("n", 20).alias("name"), (F.col("event_id") % 40 + 1).cast("int").alias("page"), F.col("event_id").alias("pos"))
    return records.merged_contacts(rows)


@query("l01_sorted_page", WITH + "SELECT id, domain, latency FROM v_jobs ORDER BY domain ASC NULLS LAST, id LIMIT 50 OFFSET 50")
def l01_sorted_page(spark, sf_dir):
    """The second page of 50, by domain."""
    return views.jobs(spark, sf_dir).orderBy(F.asc_nulls_last("domain"), "id").offset(50).limit(50).select("id", "domain", "latency")


@query("l03_last_jobs", WITH + "SELECT id, status FROM v_jobs ORDER BY created_at DESC, id DESC LIMIT 5")
def l03_last_jobs(spark, sf_dir):
    return views.jobs(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("id")).limit(5).select("id", "status")


@query("l06_first_per_job", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem) WHERE n <= 3")
def l06_first_per_job(spark, sf_dir):
    """The first pages of each job, up to its cap."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n")).where("n <= 3").drop("n")


@query("o03_union", "SELECT url FROM pages UNION SELECT regexp_replace(url, '#.*$', '') FROM pages")
def o03_union(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("url").union(pages.select(F.regexp_replace("url", "#.*$", ""))).distinct()


@query("o04_supplement", WITH + ", listed AS (SELECT domain FROM v_records WHERE data_type = 'article') SELECT domain, min(source) AS source FROM (SELECT domain, 0 AS source FROM listed UNION ALL SELECT domain, 1 FROM v_records) GROUP BY 1")
def o04_supplement(spark, sf_dir):
    """What the first list names, then what only the second does."""
    rows = views.records(spark, sf_dir).select("domain", F.when(F.col("data_type") == "article", 0).otherwise(1).alias("source"))
    return rows.groupBy("domain").agg(F.min("source").alias("source"))


@query("o05_not_queued", WITH + "SELECT DISTINCT domain FROM v_jobs WHERE domain NOT IN (SELECT domain FROM v_jobs WHERE status = 'pending' AND user_id < 20)")
def o05_not_queued(spark, sf_dir):
    jobs = views.jobs(spark, sf_dir)
    return jobs.select("domain").distinct().join(jobs.where("status = 'pending' AND user_id < 20").select("domain"), "domain", "left_anti")
