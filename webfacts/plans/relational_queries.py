"""Queries over jobs, records, search results, users: filters, joins, aggregates, windows, signals, fetch policy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fetch_policy, records
from . import views
from .registry import query
from .views import AS_OF, WITH, table

_DAY = f"TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY"
_WEEK = f"TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"


@query("a01_dashboard", WITH + "SELECT count(*) AS jobs, count(*) FILTER (status = 'pending') AS pending, (count(*) FILTER (status = 'completed') * 100) // nullif(count(*), 0) AS success_rate, count(DISTINCT domain) AS domains FROM v_jobs")
def a01_dashboard(spark, sf_dir):
    """Key figures in one pass; the rate is an integer division."""
    return views.jobs(spark, sf_dir).agg(
        F.count("*").alias("jobs"), F.count_if(F.col("status") == "pending").alias("pending"),
        F.expr("(count_if(status = 'completed') * 100) div nullif(count(*), 0)").alias("success_rate"), F.countDistinct("domain").alias("domains"))


@query("a04_stats_by_type", WITH + "SELECT data_type, count(*) AS n, count(DISTINCT domain) AS domains, sum(n_chars) AS chars FROM v_records GROUP BY 1")
def a04_stats_by_type(spark, sf_dir):
    return views.records(spark, sf_dir).groupBy("data_type").agg(F.count("*").alias("n"), F.countDistinct("domain").alias("domains"), F.sum("n_chars").alias("chars"))


@query("a05_types_by_domain", WITH + "SELECT domain, data_type, count(*) AS n FROM v_records WHERE data_type <> 'page' GROUP BY 1, 2")
def a05_types_by_domain(spark, sf_dir):
    return views.records(spark, sf_dir).where("data_type <> 'page'").groupBy("domain", "data_type").agg(F.count("*").alias("n"))


@query("a06_domains", WITH + "SELECT DISTINCT domain FROM v_jobs")
def a06_domains(spark, sf_dir):
    return views.jobs(spark, sf_dir).select("domain").distinct()


@query("a07_execution_stats", WITH + "SELECT domain, count(*) AS n, count(*) FILTER (status = 'completed') AS ok, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending, max(created_at) AS last_at FROM v_jobs GROUP BY 1")
def a07_execution_stats(spark, sf_dir):
    by = lambda s: F.count_if(F.col("status") == s)
    return views.jobs(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n"), by("completed").alias("ok"), by("failed").alias("failed"), by("pending").alias("pending"), F.max("created_at").alias("last_at"))


@query("a09_spikes", WITH + f"SELECT domain, count(*) AS n FROM v_jobs WHERE created_at >= {_WEEK} GROUP BY 1 HAVING count(*) >= 10")
def a09_spikes(spark, sf_dir):
    """Domains with at least twice the threshold of 5 in the last week."""
    return views.jobs(spark, sf_dir).where(f"created_at >= {_WEEK}").groupBy("domain").agg(F.count("*").alias("n")).where("n >= 10")


@query("a11_status_last_day", WITH + f"SELECT status, count(*) AS n FROM v_jobs WHERE created_at >= {_DAY} GROUP BY 1")
def a11_status_last_day(spark, sf_dir):
    return views.jobs(spark, sf_dir).where(f"created_at >= {_DAY}").groupBy("status").agg(F.count("*").alias("n"))


@query("a13_domain_reputation", WITH + "SELECT domain, count(*) AS total, count(*) FILTER (status_code = 200) AS successes, count(*) FILTER (status_code IN (403, 429, 503)) AS blocks, ((200 * count(*) FILTER (status_code = 200) + count(*)) // (2 * count(*))) / 100.0::DOUBLE AS success_rate FROM v_jobs GROUP BY 1")
def a13_domain_reputation(spark, sf_dir):
    return views.jobs(spark, sf_dir).groupBy("domain").agg(
        F.count("*").alias("total"), F.count_if(F.col("status_code") == 200).alias("successes"), F.count_if(F.col("status_code").isin(fetch_policy.BLOCK_STATUS)).alias("blocks"),
        F.round(F.count_if(F.col("status_code") == 200) / F.count("*"), 2).alias("success_rate"))


@query("j01_users", "SELECT c_custkey AS user_id, n_name AS org, coalesce(o.n, 0) AS orders, coalesce(e.n, 0) AS events FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) o ON c_custkey = o_custkey LEFT JOIN (SELECT user_id, count(*) n FROM events GROUP BY 1) e ON c_custkey = user_id")
def j01_users(spark, sf_dir):
    """Users with their organisation and counts; both facts are aggregated before they are joined."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("orders"))
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"))
    users = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("org"))
    return users.join(orders, "user_id", "left").join(events, "user_id", "left").select("user_id", "org", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("events", F.lit(0)).alias("events"))


@query("j09_not_recent", WITH + f"SELECT DISTINCT domain FROM v_jobs WHERE domain NOT IN (SELECT domain FROM v_jobs WHERE created_at >= {_DAY} AND status = 'failed')")
def j09_not_recent(spark, sf_dir):
    """Domains without a failure in the last day."""
    jobs = views.jobs(spark, sf_dir)
    return jobs.select("domain").distinct().join(jobs.where(f"created_at >= {_DAY} AND status = 'failed'").select("domain"), "domain", "left_anti")


@query("j11_failed_users", WITH + "SELECT user_id, count(*) AS n FROM v_jobs WHERE user_id IN (SELECT user_id FROM v_jobs WHERE status = 'failed') GROUP BY 1")
def j11_failed_users(spark, sf_dir):
    jobs = views.jobs(spark, sf_dir)
    return jobs.join(jobs.where("status = 'failed'").select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


@query("w01_best_per_domain", WITH + "SELECT domain, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY coalesce(score, 0) DESC, pos) AS n FROM v_hits) WHERE n = 1")
def w01_best_per_domain(spark, sf_dir):
    return records.best_by_score(views.hits(spark, sf_dir)).select("domain", "score", "pos")


@query("w02_latest_per_key", WITH + "SELECT domain, status, id FROM (SELECT *, row_number() OVER (PARTITION BY domain, status ORDER BY created_at DESC, id DESC) AS n FROM v_jobs) WHERE n = 1")
def w02_latest_per_key(spark, sf_dir):
    return records.first_by(views.jobs(spark, sf_dir), ["domain", "status"], F.desc("created_at"), F.desc("id")).select("domain", "status", "id")


@query("w06_failure_streaks", WITH + ", r AS (SELECT *, sum(CASE WHEN status_code = 200 THEN 1 ELSE 0 END) OVER (PARTITION BY domain ORDER BY created_at, id) AS run FROM v_jobs) SELECT domain, max(s) AS longest FROM (SELECT domain, CAST(sum(CASE WHEN status_code <> 200 THEN 1 ELSE 0 END) OVER (PARTITION BY domain, run ORDER BY created_at, id) AS BIGINT) AS s FROM r) GROUP BY 1")
def w06_failure_streaks(spark, sf_dir):
    """Each domain's longest run of failed fetches."""
    log = views.jobs(spark, sf_dir).withColumn("failed", F.col("status_code") != 200)
    return records.running_failures(log, "domain", "failed", "created_at", "id").groupBy("domain").agg(F.max("streak").alias("longest"))


@query("w07_transitions", WITH + "SELECT id, domain, old, status FROM (SELECT *, lag(status) OVER (PARTITION BY domain ORDER BY created_at, id) AS old FROM v_jobs) WHERE old IS DISTINCT FROM status")
def w07_transitions(spark, sf_dir):
    return records.transitions(views.jobs(spark, sf_dir), "domain", "status", "created_at", "id").select("id", "domain", "old", "status")


@query("w08_staggered_starts", "SELECT s_suppkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) * 30 AS offset_s FROM supplier")
def w08_staggered_starts(spark, sf_dir):
    """Starts of a nation's suppliers, 30 seconds apart."""
    n = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", ((n - 1) * 30).cast("long").alias("offset_s"))


@query("f01_job_list", WITH + "SELECT id, domain, status FROM v_jobs WHERE domain ILIKE '%site1%' AND status = 'failed' ORDER BY created_at DESC, id DESC LIMIT 50")
def f01_job_list(spark, sf_dir):
    """A page of the job list, newest first."""
    return views.jobs(spark, sf_dir).where("domain ILIKE '%site1%' AND status = 'failed'").orderBy(F.desc("created_at"), F.desc("id")).limit(50).select("id", "domain", "status")


@query("l02_top_domains", WITH + "SELECT domain, count(*) AS n FROM v_jobs WHERE status = 'completed' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def l02_top_domains(spark, sf_dir):
    return views.jobs(spark, sf_dir).where("status = 'completed'").groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(5)


@query("o01_both", WITH + "SELECT domain FROM v_jobs WHERE status = 'failed' INTERSECT SELECT domain FROM v_jobs WHERE status = 'pending'")
def o01_both(spark, sf_dir):
    jobs = views.jobs(spark, sf_dir)
    return jobs.where("status = 'failed'").select("domain").intersect(jobs.where("status = 'pending'").select("domain"))


@query("o02_minus", WITH + f"SELECT DISTINCT user_id FROM v_jobs EXCEPT SELECT user_id FROM v_jobs WHERE created_at >= {_WEEK}")
def o02_minus(spark, sf_dir):
    jobs = views.jobs(spark, sf_dir)
    return jobs.select("user_id").distinct().subtract(jobs.where(f"created_at >= {_WEEK}").select("user_id"))


@query("p01_blocked", WITH + "SELECT id, status_code IN (403, 429, 503) OR latency < 20 AS blocked, CASE WHEN status_code IN (403, 429, 503) THEN CASE WHEN latency < 1 THEN 'blocked_flag, captcha' ELSE 'blocked_flag' END WHEN latency < 1 THEN 'captcha' ELSE 'none' END AS reason FROM v_jobs")
def p01_blocked(spark, sf_dir):
    """Block flags and escalation reasons of fetches, the latency standing in for lengths."""
    code, n = F.col("status_code"), F.col("latency")
    return views.jobs(spark, sf_dir).select("id", fetch_policy.is_blocked(code, n).alias("blocked"), fetch_policy.escalation_reason(code.isin(fetch_policy.BLOCK_STATUS), n < 1).alias("reason"))


@query("p05_next_tier", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'playwright' WHEN 1 THEN 'playwright_proxy' END AS next FROM events")
def p05_next_tier(spark, sf_dir):
    tier = F.try_element_at(F.array(*map(F.lit, [*fetch_policy.TIERS, "unknown"])), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", fetch_policy.next_tier(tier).alias("next"))
