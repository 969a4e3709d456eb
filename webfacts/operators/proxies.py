"""Proxies: pools out of settings, health out of a log of requests, eligibility, weights and a seeded choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import first_by

# Failures in a row until a proxy rests, seconds of rest, the least weight.
MOST_FAILURES, REST_SECONDS, LEAST_WEIGHT = 5, 300, 0.01
_POOL = "array<struct<url: string, server: string, region: string>>"


def pool(settings: DataFrame) -> DataFrame:
    """(org_id, pos, url, region) of settings (org_id, config, urls): a JSON list with regions, else addresses between commas.

    What is no JSON list falls back to the addresses.
    """
    listed = F.from_json("config", _POOL)
    plain = F.transform(F.filter(F.transform(F.split("urls", ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.struct(x.alias("url"), F.lit(None).cast("string").alias("server"), F.lit(None).cast("string").alias("region")))
    ok = F.ltrim("config").startswith("[") & F.try_parse_json("config").isNotNull()
    rows = settings.select("org_id", F.posexplode(F.when(ok, listed).otherwise(plain)).alias("pos", "p"))
    return rows.select("org_id", "pos", F.coalesce(F.nullif("p.url", F.lit("")), F.nullif("p.server", F.lit(""))).alias("url"), "p.region").where("url is not null")


def health(log: DataFrame) -> DataFrame:
    """(url, success_count, fail_count, consecutive_failures, last_failure_at) of a log (url, at, ok, seq)."""
    last_ok = F.max(F.when(F.col("ok"), F.struct("at", "seq")))
    counts = log.groupBy("url").agg(F.count_if(F.col("ok")).alias("success_count"), F.count_if(~F.col("ok")).alias("fail_count"), F.max(F.when(~F.col("ok"), F.col("at"))).alias("last_failure_at"), last_ok.alias("_ok"))
    since = log.where(~F.col("ok")).join(counts.select("url", "_ok"), "url").where(F.col("_ok").isNull() | (F.struct("at", "seq") > F.col("_ok")))
    since = since.groupBy("url").agg(F.count("*").alias("consecutive_failures"))
    return counts.join(since, "url", "left").select("url", "success_count", "fail_count", F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"), "last_failure_at")


def success_rate(good: Column, bad: Column) -> Column:
    """1 for a proxy without requests."""
    return F.when(good + bad == 0, 1.0).otherwise(good / (good + bad))


def weight(rate: Column, latency_ms: Column) -> Column:
    return F.greatest(rate * (1000.0 / F.greatest(latency_ms, F.lit(1))), F.lit(LEAST_WEIGHT))


def rests(failures: Column, last_failure_at: Column, as_of: Column) -> Column:
    """Whether a proxy that failed several times in a row is still left alone."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last_failure_at.cast("timestamp"))
    return F.coalesce((failures >= MOST_FAILURES) & (age < REST_SECONDS * 1_000_000), F.lit(False))


def candidates(pools: DataFrame, states: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """(request_id, pos, url, weight, rests) of requests (request_id, org_id, region): the proxies of the region if it has any, else all of the pool's.

    states: (url, success_count, fail_count, avg_latency_ms, consecutive_failures, last_failure_at); proxies without one are new.
    """
    both = requests.join(pools.withColumnRenamed("region", "_region"), "org_id")
    here = (F.lower("_region") == F.lower("region")) & (F.col("region") != "")
    both = both.withColumn("_here", F.coalesce(here, F.lit(False)))
    both = both.withColumn("_any", F.max("_here").over(Window.partitionBy("request_id"))).where("_here or not _any")
    both = both.join(states, "url", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(
        "request_id", "pos", "url", weight(success_rate(zero("success_count"), zero("fail_count")), zero("avg_latency_ms")).alias("weight"),
        rests(zero("consecutive_failures"), F.col("last_failure_at"), as_of).alias("rests"))


def chosen(candidates_: DataFrame, seed: int = 0) -> DataFrame:
    """(request_id, url): of those that don't rest one by chance in proportion to weight, seeded; the first of the pool if all rest."""
    chance = (F.pmod(F.xxhash64(F.lit(seed), "request_id", "url"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    # the least of exponential waiting times is each one's with the probability of its share of the weights
    wait = F.when(~F.col("rests"), -F.log(chance) / F.col("weight"))
    return first_by(candidates_.withColumn("_wait", wait), ["request_id"], F.col("_wait").asc_nulls_last(), F.col("pos")).select("request_id", "url")
