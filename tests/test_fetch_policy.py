"""Folds over long logs: equal to a plain fold, and no array of a key's whole log."""

import math
import random

import pytest
from pyspark.sql import functions as F

from webfacts.operators import folds


def log():
    r = random.Random(5)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.choice([200] * 6 + [429, 503, 404, None]), r.choice([0, 1, 5, 80, 900])) for i in range(12_000)]
    rows += [(20_000 + i, "up", 429, 7) for i in range(2500)] + [(30_000 + i, "up", 200, 9) for i in range(3)] + [(7, "tie", 200, 3), (7, "tie", 429, 50), (8, "gap", 404, None), (9, "gap", 404, 5)]
    return rows


def plain(start, step, at):
    out = {}
    for row in sorted(log(), key=lambda x: (x[0], x[2] or 0, x[3] or 0)):
        out[row[1]] = step(out.get(row[1], start), row[at])
    return out


def test_adaptive_delay(spark):
    df = spark.createDataFrame(log(), "id long, domain string, status int, latency int").repartition(5)
    got = {r.domain: r.delay for r in folds.adaptive_delay(df, "domain", "status", "id", 1.0).collect()}
    want = plain(1.0, lambda d, s: min(d * 2, 30.0) if s in (429, 503) else max(d * 0.9, 1.0) if s == 200 else d, 2)
    assert got == pytest.approx(want, rel=1e-9) and want["up"] == pytest.approx(30 * 0.9**3)


def test_latency_average(spark):
    df = spark.createDataFrame(log(), "id long, domain string, status int, latency int").repartition(5)
    out = folds.latency_average(df, "domain", "latency", "id")
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString() and out.schema.simpleString() == "struct<domain:string,avg_latency:int>"
    want = plain(0, lambda a, x: x if a == 0 else None if a is None or x is None else math.floor(a * 0.7 + x * 0.3), 3)
    # rows of one place come in the order of latencies, which plain() doesn't know
    got = {r.domain: r.avg_latency for r in out.collect()}
    assert {k: v for k, v in got.items() if k != "tie"} == {k: v for k, v in want.items() if k != "tie"}
    assert folds.latency_average(df.limit(0), "domain", "latency", "id").count() == 0


@pytest.mark.parametrize("run", [64, 70, 500])
def test_runs_of_any_length(spark, run):
    """Heads and tails of runs: constant latencies, which keep states apart for ever, zeros, negative numbers, nulls."""
    r = random.Random(run)
    make = {
        "constant": lambda i: 7, "zeros": lambda i: r.choice([0, 0, 1]), "small": lambda i: r.choice([-3, 0, 2, 9]), "large": lambda i: r.choice([2**31 - 1, -(2**31), 5]), "late null": lambda i: None if i == 900 else 100 + i % 9,
        "early null": lambda i: None if i == 3 else i, "any": lambda i: r.randint(0, 60_000),
    }
    rows = [(i, k, f(i), r.choice([200, 200, 429, 503, 404, None])) for k, f in make.items() for i in range(1000)]
    want, delays = {}, {}
    for i, k, x, s in rows:
        want[k] = folds.smoothed(want.get(k, 0), x)
        d = delays.get(k, 2.0)
        delays[k] = min(d * 2, 30.0) if s in (429, 503) else max(d * 0.9, 2.0) if s == 200 else d
    df = spark.createDataFrame(rows, "id long, domain string, latency int, status int").repartition(6)
    assert {x.domain: x.avg_latency for x in folds.latency_average(df, "domain", "latency", "id", run=run).collect()} == want
    assert {x.domain: x.delay for x in folds.adaptive_delay(df, "domain", "status", "id", 2.0, run=run).collect()} == pytest.approx(delays, rel=1e-9)


def test_one_key_lies_in_many_tasks(spark):
    """A key of a million rows: equal to the plain fold, in even shares, and what comes together is small."""
    df = spark.range(1_000_000).select("id", F.lit("a").alias("domain"), (F.xxhash64("id") % 3000 + 3000).cast("int").alias("latency"))
    want = 0
    for x in df.orderBy("id").select("latency").toPandas()["latency"].tolist():
        want = folds.smoothed(want, x)
    assert [tuple(r) for r in folds.latency_average(df, "domain", "latency", "id").collect()] == [("a", want)]
    runs = folds._runs(df, "domain", "id", F.col("latency"), lambda v: (len(v),), {"n": folds.pa.int32()}, folds.RUN)
    shares = [r.n for r in runs.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()]
    assert len(shares) >= 4 and max(shares) < 500_000 and runs.count() < 150


def test_delays_are_composed_by_levels(spark):
    df = spark.range(5000).select(F.col("id"), F.lit("a").alias("domain"), F.lit(200).alias("status"))
    plan = folds.adaptive_delay(df, "domain", "status", "id", 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.count("collect_list") == folds.LEVELS
