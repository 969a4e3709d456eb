"""When what is tracked runs next: intervals, jitter, back-off after failures, and the jobs that are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from .records import first_by

# Days between runs by frequency, those of unknown ones, what is scraped where nothing is said, and bounds in seconds.
DAYS = {"daily": 1, "weekly": 7, "biweekly": 14, "monthly": 30}
OTHER_DAYS, MOST_BACKOFF, MOST_JITTER = 7, 86_400, 900
DATA_TYPES = ["blog_url", "article", "contact", "tech_stack", "resource", "pricing"]


def interval(frequency: Column) -> Column:
    return F.make_dt_interval(days=F.coalesce(texts.lookup(frequency, DAYS), F.lit(OTHER_DAYS)))


def jitter(key: Column, seed: int = 0) -> Column:
    """0 to 15 minutes, spread by a hash of the key and a seed, so that a run can be repeated."""
    return F.make_dt_interval(secs=F.pmod(F.xxhash64(F.lit(seed), key), F.lit(MOST_JITTER + 1)).cast("decimal(18,6)"))


def next_run(frequency: Column, as_of: Column) -> Column:
    return as_of + interval(frequency)


def backoff(frequency: Column, failures: Column) -> Column:
    """The interval doubled with each failure, a day at most."""
    days = F.coalesce(texts.lookup(frequency, DAYS), F.lit(OTHER_DAYS))
    return F.make_dt_interval(secs=F.least(days * 86_400.0 * F.pow(F.lit(2.0), failures), F.lit(float(MOST_BACKOFF))).cast("decimal(18,6)"))


def due(tracked: DataFrame, as_of: Column) -> DataFrame:
    """Active rows (is_active, next_run_at) whose time has come."""
    return tracked.where(F.col("is_active") & (F.col("next_run_at") <= as_of))


def tracked_domains(tracked: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Tracked domains after an upsert by domain: changed rows are active again and next run an interval from now.

    Of several changes to one domain the last by ``seq`` counts; tables have domain, frequency, is_active, next_run_at.
    """
    new = first_by(changes, ["domain"], F.col("seq").desc()).select("domain", "frequency", F.lit(True).alias("is_active"), next_run(F.col("frequency"), as_of).alias("next_run_at"))
    return tracked.join(new.select("domain"), "domain", "left_anti").select(*new.columns).unionByName(new)


def after_run(tracked: DataFrame, runs: DataFrame, as_of: Column, seed: int | None = 0) -> DataFrame:
    """Tracked domains (domain, frequency, next_run_at, consecutive_failures, last_run_at) after runs (domain, ok).

    A good run sets failures to 0 and the next one an interval from now; a bad
    one counts up and backs off. Both get jitter by ``seed``; None for none.
    """
    both = tracked.join(runs.select("domain", "ok"), "domain", "left")
    spread = F.make_dt_interval() if seed is None else jitter(F.col("domain"), seed)
    failures = F.coalesce("consecutive_failures", F.lit(0)) + 1
    return both.select(
        "domain", "frequency",
        F.when(F.col("ok"), next_run(F.col("frequency"), as_of) + spread).when(~F.col("ok"), as_of + backoff(F.col("frequency"), failures) + spread).otherwise(F.col("next_run_at")).alias("next_run_at"),
        F.when(F.col("ok"), 0).when(~F.col("ok"), failures).otherwise(F.col("consecutive_failures")).alias("consecutive_failures"),
        F.when(F.col("ok"), as_of).otherwise(F.col("last_run_at")).alias("last_run_at"))


def after_search(searches: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Tracked searches (id, frequency, next_run_at, total_runs, total_domains) after runs (id, domains), of which each counts."""
    done = runs.groupBy("id").agg(F.count("*").alias("_runs"), F.sum("domains").alias("_domains"))
    both = searches.join(done, "id", "left")
    return both.select(
        "id", "frequency", F.when(F.col("_runs") > 0, next_run(F.col("frequency"), as_of)).otherwise(F.col("next_run_at")).alias("next_run_at"),
        (F.col("total_runs") + F.coalesce("_runs", F.lit(0))).alias("total_runs"), (F.col("total_domains") + F.coalesce("_domains", F.lit(0))).alias("total_domains"))


def enqueued(tracked: DataFrame, as_of: Column, *parameters: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, tracked): a pending job for each row that is due, with its parameters, and all rows with their next runs set."""
    jobs = due(tracked, as_of).select(*parameters, F.lit("pending").alias("status"), as_of.alias("created_at"))
    ready = F.col("is_active") & (F.col("next_run_at") <= as_of)
    return jobs, tracked.withColumn("next_run_at", F.when(ready, next_run(F.col("frequency"), as_of)).otherwise(F.col("next_run_at")))


def bulk_jobs(domains: DataFrame, as_of: Column, stagger: int = 30) -> DataFrame:
    """(pos, domain, data_types, status, start_at): a pending job for each of an upload's domains (pos from 0), one some seconds after the other."""
    start = as_of + F.make_dt_interval(secs=(F.col("pos") * stagger).cast("decimal(18,6)"))
    return domains.select("pos", "domain", F.array(*map(F.lit, DATA_TYPES)).alias("data_types"), F.lit("pending").alias("status"), start.alias("start_at"))
