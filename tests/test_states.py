"""State of keys over streams: values, restarts, expiry by the clock and by event time, late rows."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from webfacts.streaming import feeds, states

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "domain string, ts timestamp, status int, latency_ms int, job_id long"


@pytest.fixture
def play(spark, tmp_path):
    """Runs an operator over files that come one after the other, each time with a restart from the checkpoint; gives the rows of each run."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    states.prepare(spark)

    def run(operator, batches, pause=0.0, wait=0.0):
        out = []
        for k, rows in enumerate(batches):
            time.sleep(pause if k else 0)
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            got = []
            stream = operator(feeds.read_events(spark, f"{tmp_path}/in", SCHEMA))
            query = stream.writeStream.outputMode("update").foreachBatch(lambda b, i, got=got: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/state")
            query = query.start()  # by the clock there is always another batch, so a query for what is there does not end
            end = time.time() + 40
            while time.time() < end and sum(p["numInputRows"] for p in query.recentProgress) < len(rows):
                time.sleep(0.1)
            time.sleep(wait)
            query.stop()
            out.append(sorted(got, key=str))
        return out

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def row(domain, minute, status=200, latency=100, job=1):
    return (domain, None if minute is None else T0 + dt.timedelta(minutes=minute), status, latency, job)


def test_latency_goes_on_after_a_restart(play):
    out = play(states.latency, [[row("a", 1, latency=200), row("a", 0, latency=100), row("b", 0, latency=7), row("a", 2, latency=None), row(None, 2)], [row("a", 3, latency=50), row("a", None)]])
    assert out == [[("a", 130, 2), ("b", 7, 1)], [("a", 106, 3)]]


def test_latency_expires(play):
    out = play(lambda s: states.latency(s, ttl="2 seconds"), [[row("a", 0, latency=100)], [row("a", 1, latency=9)]], pause=3)
    assert out == [[("a", 100, 1)], [("a", 9, 1)]]


def test_rate_and_recent_refusals(play):
    first = [row("a", i, status=s) for i, s in enumerate([429, 429, 200])]
    second = [row("a", 10 + i) for i in range(30)]
    out = play(states.rate, [first, [row("a", 5, status=503)], second])
    assert [x[0][0] for x in out] == ["a"] * 3
    assert [x[0][1] for x in out] == pytest.approx([3.6, 7.2, 1.0]) and [x[0][2] for x in out] == pytest.approx([2 / 3, 3 / 4, 0])


def test_reputation(play):
    out = play(lambda s: states.reputation(s, "domain", F.col("status") == 200), [[row("a", 0), row("a", 9, status=500), row("b", 1, status=None)], [row("a", 4)]])
    assert [[(r[0], r[1], r[2], r[3].minute) for r in x] for x in out] == [[("a", 2, 1, 9), ("b", 1, 0, 1)], [("a", 3, 2, 9)]]


def test_parts_of_a_batch(play, spark):
    """A key's rows of one batch come in several parts and are counted once each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = play(lambda s: states.reputation(s, "domain", F.lit(True)), [[row("a", i) for i in range(50)]])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out[0][0][:3] == ("a", 50, 50)


def test_liveness_by_the_clock(play):
    out = play(lambda s: states.liveness(s, silence="2 seconds"), [[row("a", 0, job=1), row("a", 1, job=2)], [row("a", 2, job=2)]], pause=3)
    assert out[0] == [("1", 1, False), ("2", 1, False)]
    assert ("1", 1, True) in out[1] and ("2", 1, True) not in out[1] or ("2", 1, False) in out[1]


def test_liveness_by_event_time_drops_late_beats(play):
    beat = lambda s: states.liveness(s, silence="10 minutes", late="1 minute")
    out = play(beat, [[row("a", 0, job=1), row("a", 5, job=2)], [row("a", 30, job=3)], [row("a", 1, job=4), row("a", 31, job=3)]], wait=2)
    assert out[0] == [("1", 1, False), ("2", 1, False)]
    rest = [r for x in out[1:] for r in x]
    assert ("1", 1, True) in rest and ("2", 1, True) in rest and ("3", 2, False) in rest
    assert not any(r[0] == "4" for r in rest)
