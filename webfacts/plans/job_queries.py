"""Queries over tables of jobs, users, searches, captured pages and pushed records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import html
from ..operators import jobs
from ..sources import lists
from . import views
from .registry import query
from .views import AS_OF, WITH, table

_NOW = f"TIMESTAMP '{AS_OF}'"


def _now():
    return F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")


@query("c01_created", WITH + f"SELECT id, user_id, domain, status, created_at FROM v_jobs UNION ALL SELECT c_custkey + 10000000, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey END, -1), lower(c_name), 'pending', {_NOW} FROM customer")
def c01_created(spark, sf_dir):
    """Jobs with new ones, which are pending; those without a user go to a default one."""
    rows = views.jobs(spark, sf_dir).select("id", "user_id", "domain", "status", "created_at").withColumnRenamed("user_id", "org_id")
    new = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 10_000_000).alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("org_id"), F.lower("c_name").alias("domain"))
    return jobs.created(rows, new, _now(), F.lit(-1)).withColumnRenamed("org_id", "user_id")


@query("c02_found", WITH + "SELECT id, domain, status FROM v_jobs WHERE id = 77")
def c02_found(spark, sf_dir):
    return jobs.found(views.jobs(spark, sf_dir).select("id", "domain", "status"), "id", 77)


@query("c10_children", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_custkey = 7")
def c10_children(spark, sf_dir):
    """The domains of one discovery; a customer's orders stand for them."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return jobs.children(rows, "o_custkey", 7).select("id", "status")


@query("c11_tracked_searches", f"SELECT n_nationkey AS id, 'weekly' AS frequency, true AS is_active, {_NOW} + to_days(7) AS next_run_at, 0 AS total_runs FROM nation UNION ALL SELECT s_suppkey + 1000, 'daily', true, {_NOW} + to_days(1), 0 FROM supplier")
def c11_tracked_searches(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("weekly").alias("frequency"), F.lit(True).alias("is_active"), (_now() + F.expr("INTERVAL 7 DAYS")).alias("next_run_at"), F.lit(0).alias("total_runs"), F.lit(0).cast("long").alias("total_domains"), _now().alias("created_at"))
    return jobs.tracked_search(rows, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).alias("id"), F.lit("daily").alias("frequency")), _now()).drop("total_domains", "created_at")


@query("c12_active_searches", "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_acctbal > 0")
def c12_active_searches(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("is_active"))
    return jobs.listed(rows, F.desc("id"), active="is_active").drop("is_active")


@query("c22_listed_keys", "SELECT c_custkey AS id, c_name AS name FROM customer")
def c22_listed_keys(spark, sf_dir):
    """Keys as listed: without their hashes."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.sha2("c_name", 256).alias("key_hash"))
    return jobs.listed(rows, F.asc("id"), hidden=("key_hash",))


@query("c23_touched", "SELECT c_custkey AS id, greatest(CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '1995-06-01' END, max(o_orderdate)) AS last_login FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def c23_touched(spark, sf_dir):
    """Users with the time of their last visit; orders stand for visits."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.expr("TIMESTAMP_NTZ '1995-06-01 00:00:00'")).alias("last_login"))
    return jobs.touched(rows, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at")), "id", "last_login")


@query("l04_page", WITH + "SELECT id, domain FROM v_jobs ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100")
def l04_page(spark, sf_dir):
    """The third page of the newest jobs."""
    return jobs.page(views.jobs(spark, sf_dir), 3, sort="no such column").select("id", "domain")


@query("l05_history", WITH + "SELECT id, domain FROM v_jobs ORDER BY created_at DESC, id DESC LIMIT 100")
def l05_history(spark, sf_dir):
    return jobs.history(views.jobs(spark, sf_dir), "created_at").select("id", "domain")


@query("l07_users", "SELECT n_nationkey AS id, n_name AS name, row_number() OVER (ORDER BY n_name, n_nationkey) AS place FROM nation")
def l07_users(spark, sf_dir):
    """A list in its order, shown by numbers."""
    rows = jobs.listed(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), F.col("name"), F.col("id"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("name", "id")).cast("long"))  # 25 rows


@query("f10_tool_results", WITH + "SELECT id, domain FROM v_records WHERE data_type = 'article' ORDER BY id LIMIT 200")
def f10_tool_results(spark, sf_dir):
    return jobs.tool_results(views.records(spark, sf_dir), "article", 1000).select("id", "domain")


@query("f13_active_signals", "SELECT s_suppkey AS id FROM supplier WHERE s_nationkey = 3 AND s_acctbal > 0")
def f13_active_signals(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("org_id"), (F.col("s_acctbal") > 0).alias("is_active"))
    return jobs.listed(jobs.visible(rows, 3), F.desc("id"), active="is_active").select("id")


@query("f14_policies", "SELECT s_suppkey AS id, s_nationkey = 3 AS allowed FROM supplier")
def f14_policies(spark, sf_dir):
    """Which new rows a writer of an organisation may add."""
    return jobs.writable(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("org_id")), 3).select("id", "allowed")


@query("a08_active_orgs", "SELECT DISTINCT s_nationkey AS org_id FROM supplier WHERE s_acctbal > 0")
def a08_active_orgs(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("org_id")).distinct()


@query("a10_total", WITH + "SELECT count(*) AS total FROM v_records WHERE data_type <> 'page' AND lang = 'en'")
def a10_total(spark, sf_dir):
    return jobs.total(views.records(spark, sf_dir), (F.col("data_type") != "page") & (F.col("lang") == "en"))


@query("a18_completed", WITH + "SELECT count(*) AS total FROM v_jobs WHERE status = 'completed'")
def a18_completed(spark, sf_dir):
    return jobs.total(views.jobs(spark, sf_dir), F.col("status") == "completed")


@query("j07_with_counts", "SELECT c_custkey AS id, count(o_orderkey) AS records FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j07_with_counts(spark, sf_dir):
    return jobs.with_counts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id")))


@query("j10_skipped", WITH + ", best AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY coalesce(score, 0) DESC, pos) AS n FROM v_hits WHERE domain IN (SELECT 'd' || c_custkey FROM customer WHERE c_custkey % 4 = 0)) SELECT domain, score, pos FROM best WHERE n = 1")
def j10_skipped(spark, sf_dir):
    """Discovered domains that were scraped before, each by its best hit."""
    recent = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("domain"))
    return jobs.skipped(views.hits(spark, sf_dir), recent)


@query("j15_supplemented", """WITH a AS (SELECT DISTINCT o_custkey AS domain, 'u' || o_orderkey % 30 AS url FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT DISTINCT o_custkey AS domain, 'u' || o_orderkey % 30 AS url FROM orders WHERE o_orderkey % 3 <> 0),
u AS (SELECT domain, url, 0 AS list FROM a UNION ALL SELECT domain, url, 1 FROM (SELECT * FROM b EXCEPT SELECT * FROM a)), n AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY list, url) AS rank FROM u) SELECT domain, url, CAST(rank AS INT) AS rank FROM n WHERE rank <= 5""")
def j15_supplemented(spark, sf_dir):
    """A first list of addresses, filled up from a second to five a domain."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("domain"), F.concat(F.lit("u"), (F.col("o_orderkey") % 30).cast("string")).alias("url"), "o_orderkey")
    return jobs.supplemented(rows.where("o_orderkey % 3 = 0").drop("o_orderkey"), rows.where("o_orderkey % 3 <> 0").drop("o_orderkey"), 5)


@query("c32_contact_facts", "SELECT 'people.example.org' AS domain, 'contact' AS data_type, CASE WHEN c_custkey % 3 = 0 THEN 'l' || c_custkey WHEN c_custkey % 3 = 1 THEN 'p' || c_custkey END AS url, CASE c_custkey % 4 WHEN 0 THEN 'Ada B' WHEN 1 THEN 'Ada' ELSE c_name END AS title FROM customer")
def c32_contact_facts(spark, sf_dir):
    """Records of contacts, with fall-backs for address and name."""
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    rows = table(spark, sf_dir, "customer").select(
        F.when(k % 4 <= 1, "Ada").otherwise("").alias("first_name"), F.when(k % 4 == 0, "B").alias("last_name"), F.col("c_name").alias("name"),
        F.when(k % 3 == 0, F.concat(F.lit("l"), key)).otherwise("").alias("linkedin_url"), F.when(k % 3 <= 1, F.concat(F.lit("p"), key)).alias("profile_url"))
    return jobs.contact_facts(rows, "people.example.org")


@query("s26_captured", """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'table_data' ELSE 'contact' END AS data_type, CASE WHEN c_custkey % 2 = 1 THEN 'l' || c_custkey END AS url,
CASE WHEN c_custkey % 2 = 0 THEN c_name || ' — ' || c_mktsegment ELSE 'Ada' END AS title FROM customer""")
def s26_captured(spark, sf_dir):
    """Rows that a browser captured as records: generic ones by their first two values that are not blank."""
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    values = F.array(pair("first_name", F.when(F.col("c_custkey") % 2 == 1, "Ada").otherwise("")), pair("name", F.col("c_name")), pair("profile_url", F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("l"), F.col("c_custkey").cast("string"))).otherwise("")), pair("segment", F.col("c_mktsegment")))
    return jobs.captured_facts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 2 == 0).alias("generic"), values.alias("values")))


@query("h19_crawl_plans", """WITH d AS (SELECT o_custkey AS job_id, min(o_orderkey) AS pos, o_orderpriority AS url FROM orders GROUP BY 1, 3), n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY pos, url) AS n FROM d) SELECT job_id, pos, url FROM n WHERE n <= 3""")
def h19_crawl_plans(spark, sf_dir):
    """The first three distinct addresses of each job; priorities stand for them."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("url"))
    return jobs.crawl_plan(rows, 3)


@query("h18_second_phase", """WITH l AS (SELECT o_custkey AS job_id, 'p' || (o_orderkey % 200) AS url FROM orders WHERE o_orderkey % 2 = 0), v AS (SELECT o_custkey AS job_id, 'p' || (o_orderkey % 200) AS url FROM orders WHERE o_orderkey % 5 = 0)
SELECT DISTINCT l.job_id, 'p' || page_id AS url, page_id FROM l JOIN pages ON l.url = 'p' || page_id WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.job_id = l.job_id AND v.url = l.url)""")
def h18_second_phase(spark, sf_dir):
    """Captured articles that listings name and the job hasn't visited."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.concat(F.lit("p"), (F.col("o_orderkey") % 200).cast("string")).alias("url"), "o_orderkey")
    listings = rows.where("o_orderkey % 2 = 0").groupBy("job_id", F.col("o_orderkey") % 7).agg(F.collect_list("url").alias("article_urls"))
    captured = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("url"), "page_id")
    return jobs.second_phase(listings, rows.where("o_orderkey % 5 = 0"), captured).select("job_id", "url", "page_id")


@query("s10_paged_hits", """WITH h AS (SELECT o_custkey AS query_id, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 + 1 AS INT) AS page, o_orderkey FROM orders),
k AS (SELECT query_id, page, o_orderkey FROM h WHERE NOT (query_id % 3 = 0 AND page = 2) AND NOT (query_id % 3 = 1 AND page = 1 AND o_orderkey % 2 = 0)),
c AS (SELECT query_id, page, count(*) AS n FROM k GROUP BY ALL), e AS (SELECT query_id, page, row_number() OVER w = page AND coalesce(bool_or(n < 5) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) = false AS ok FROM c WINDOW w AS (PARTITION BY query_id ORDER BY page))
SELECT k.query_id, k.page, o_orderkey FROM k JOIN e ON k.query_id = e.query_id AND k.page = e.page WHERE ok""")
def s10_paged_hits(spark, sf_dir):
    """Pages of hits up to the first one that isn't full, or that lacks."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.expr("0").alias("x"), "o_orderkey", n.alias("n")).withColumn("page", (F.floor((F.col("n") - 1) / 5) + 1).cast("int"))
    rows = rows.where("not (query_id % 3 = 0 and page = 2) and not (query_id % 3 = 1 and page = 1 and o_orderkey % 2 = 0)").select("query_id", "page", "o_orderkey")
    return lists.paged_hits(rows, 5)


@query("s12_ingested", """SELECT o_custkey AS id, 'd' || o_custkey AS domain, 'completed' AS status, count(*)::INT AS pages_scraped FROM orders GROUP BY o_custkey HAVING count(*) <= 500""")
def s12_ingested(spark, sf_dir):
    """The jobs of pushed batches; a customer's orders stand for a batch."""
    record = F.struct(F.lit("contact").alias("data_type"), F.lit(None).cast("string").alias("url"), F.col("o_orderpriority").alias("title"), F.lit("{}").alias("metadata"))
    batches = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.collect_list(record).alias("records"))
    batches = batches.select("job_id", F.lit(1).alias("org_id"), F.lit(None).cast("long").alias("user_id"), F.concat(F.lit("d"), F.col("job_id").cast("string")).alias("domain"), F.lit("extension").alias("source"), "records")
    return lists.ingested(batches, _now())[0].select("id", "domain", "status", "pages_scraped")


@query("s22_seeded", "SELECT n_name AS domain, n_nationkey AS seed FROM nation UNION ALL SELECT * FROM (VALUES ('new.example.org', 1), ('other.example.org', 2)) AS t(domain, seed)")
def s22_seeded(spark, sf_dir):
    """Rows that are put in unless their key is there."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("domain"), F.col("n_nationkey").alias("seed"))
    new = rows.select("domain", F.lit(99).alias("seed")).unionByName(spark.createDataFrame([("new.example.org", 1), ("other.example.org", 2)], "domain string, seed int"))
    return jobs.seeded(rows, new, "domain")


for _name, _table, _key in [
    ("c06_discovery", "orders", "o_orderkey"), ("c13_search", "supplier", "s_suppkey"), ("c15_domain_stats", "customer", "c_custkey"), ("c17_tracked_domain", "nation", "n_nationkey"), ("c18_signal", "part", "p_partkey"),
]:

    def _look_up(spark, sf_dir, source=_table, key=_key):
        """The row of one key."""
        return jobs.found(table(spark, sf_dir, source), key, 7)

    query(_name, f"SELECT * FROM {_table} WHERE {_key} = 7")(_look_up)


@query("c05_discoveries", "SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS created_at FROM orders UNION ALL SELECT c_custkey + 90000000, 'pending', TIMESTAMP '2024-01-31 00:00:00' FROM customer")
def c05_discoveries(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return jobs.created(rows, table(spark, sf_dir, "customer").select((F.col("c_custkey") + 90_000_000).alias("id")), _now())


@query("c08_found_domains", "SELECT s_suppkey AS id, s_name AS domain, 'found' AS status FROM supplier UNION ALL SELECT n_nationkey + 1000000, n_name, 'found' FROM nation")
def c08_found_domains(spark, sf_dir):
    """Discovered domains with new ones, whose status is the default."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("domain"), F.lit("found").alias("status"))
    return jobs.appended(rows, table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1_000_000).alias("id"), F.col("n_name").alias("domain")), status=F.lit("found"))


@query("c09_domain_updates", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'done' ELSE 'found' END AS status, CASE WHEN s_suppkey % 8 = 0 THEN 0.5::DOUBLE ELSE s_acctbal END AS score FROM supplier")
def c09_domain_updates(spark, sf_dir):
    """A sparse update of discovered domains."""
    from ..operators import edits

    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("found").alias("status"), F.col("s_acctbal").alias("score"))
    changes = rows.where("id % 4 = 0").select("id", F.lit("done").alias("status"), F.when(F.col("id") % 8 == 0, 0.5).alias("score"))
    return edits.patched(rows, changes, "id")


@query("c16_active_domains", "SELECT c_name AS domain FROM customer WHERE c_acctbal > 0")
def c16_active_domains(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("domain"), (F.col("c_acctbal") > 0).alias("is_active"))
    return jobs.listed(rows, F.asc("domain"), active="is_active").select("domain")


@query("c19_executions", "SELECT event_id AS id, user_id AS signal_id, ts AS fired_at FROM events UNION ALL SELECT n_nationkey + 70000000, n_nationkey, TIMESTAMP '2024-01-31 00:00:00' FROM nation")
def c19_executions(spark, sf_dir):
    """A log of firings with new rows."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("signal_id"), F.col("ts").alias("fired_at"))
    return jobs.appended(rows, table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 70_000_000).alias("id"), F.col("n_nationkey").alias("signal_id")), fired_at=_now())


@query("c24_teams", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 2")
def c24_teams(spark, sf_dir):
    """An organisation's teams by name."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("org_id"))
    return jobs.listed(jobs.visible(rows, 2), F.asc("name"), F.asc("id"), hidden=("org_id",))


@query("s08_sitemaps", """WITH p AS (SELECT page_id % 20 AS d, page_id % 3 AS k, url FROM pages), u AS (SELECT d, k, url FROM p WHERE d % 4 > 0 OR k > 0),
f AS (SELECT d, min(k) AS k FROM u WHERE NOT regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1)), '\\.(pdf|jpg|jpeg|png|gif|svg|ico|css|js|woff|woff2|ttf|eot|mp3|mp4|avi|mov|zip|gz|tar|xml|rss|atom)$') GROUP BY 1)
SELECT DISTINCT 'd' || u.d AS domain, url FROM u JOIN f ON u.d = f.d AND u.k = f.k WHERE NOT regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1)), '\\.(pdf|jpg|jpeg|png|gif|svg|ico|css|js|woff|woff2|ttf|eot|mp3|mp4|avi|mov|zip|gz|tar|xml|rss|atom)$')""")
def s08_sitemaps(spark, sf_dir):
    """Pages of sitemaps: three paths a domain, the first of which is an index of one file for domains of even number, and empty for some."""
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("d"), (F.col("page_id") % 3).cast("int").alias("k"), "url").where("d % 4 > 0 or k > 0")
    body = F.array_join(F.transform(F.collect_list("url"), lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>"))), "")
    files = pages.groupBy("d", "k").agg(body.alias("xml")).select(F.concat(F.lit("d"), F.col("d").cast("string")).alias("domain"), "d", "k", "xml")
    child = F.concat(F.lit("c"), F.col("d").cast("string"))
    index = F.concat(F.lit("<sitemapindex><sitemap>\n<loc>"), child, F.lit("</loc></sitemap></sitemapindex>"))
    below = (F.col("k") == 0) & (F.col("d") % 2 == 0)
    top = files.select("domain", F.col("k").alias("path_rank"), F.lit(None).cast("string").alias("url"), F.when(below, index).otherwise(F.col("xml")).alias("xml"))
    return lists.sitemap_urls(top.unionByName(files.where(below).select("domain", F.lit(None).cast("int").alias("path_rank"), child.alias("url"), "xml")))


@query("s11_search_hits", "SELECT o_orderkey AS pos, unnest([0, 1]) AS rank, unnest(['https://www.A' || o_custkey || '.org/x', 'https://b.org/']) AS url, unnest(['t', NULL]) AS title, unnest([0.5, NULL])::DOUBLE AS score, unnest(['A' || o_custkey || '.org', 'b.org']) AS domain FROM orders")
def s11_search_hits(spark, sf_dir):
    """Results of search responses with their domains."""
    body = F.concat(F.lit('{"query": "q", "results": [{"url": "https://www.A'), F.col("o_custkey").cast("string"), F.lit('.org/x", "title": "t", "score": 0.5}, {"url": "https://b.org/"}]}'))
    return lists.search_hits(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), body.alias("body")))


@query("s14_video_ids", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 < 3 THEN 'abcdefgh-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') END AS video FROM customer")
def s14_video_ids(spark, sf_dir):
    k = F.concat(F.lit("abcdefgh-"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"))
    url = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("https://www.youtube.com/watch?t=1&v="), k)).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("https://youtu.be/"), k, F.lit("?x"))).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("https://www.youtube.com/embed/"), k)).otherwise(F.concat(F.lit("https://v.org/"), k))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), lists.video_id(url).alias("video"))


#: A page stands for its first reference, which leads to its other ones; a crawl begins where nothing leads.
_EDGES = """p AS (SELECT list_filter(regexp_extract_all(html, '(?is)<a\\s[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|mailto:|tel:|javascript:)')) AS h FROM pages),
e AS (SELECT DISTINCT h[1] AS src, unnest(h) AS dst FROM p), l AS (SELECT src, dst FROM e WHERE src <> dst)"""


@query("j14_closure", f"""WITH RECURSIVE {_EDGES}, s AS (SELECT DISTINCT src AS url FROM l WHERE src NOT IN (SELECT dst FROM l)),
r(url, depth) AS (SELECT url, 0 FROM s UNION ALL SELECT DISTINCT l.dst, r.depth + 1 FROM r JOIN l ON l.src = r.url WHERE r.depth < 5) SELECT url, min(depth) AS depth FROM r GROUP BY url""")
def j14_closure(spark, sf_dir):
    """Addresses reached in five steps over the references of pages."""
    refs = table(spark, sf_dir, "pages").select(html.links(F.col("html")).alias("h"))
    edges = refs.select(F.get("h", F.lit(0)).alias("src"), F.explode("h").alias("dst")).where("src <> dst").distinct()
    seeds = edges.select(F.col("src").alias("url")).distinct().join(edges.select(F.col("dst").alias("url")).distinct(), "url", "left_anti")
    return lists.closure(edges, seeds, 5)
