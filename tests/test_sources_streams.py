"""Sources, crawl closure and streams over small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from webfacts.operators import edits
from webfacts.sources import lists
from webfacts.streaming import feeds

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "seq int, domain string, ts timestamp, latency_ms int, ok boolean"


def test_sitemaps(spark):
    files = [("a", 0, "<urlset></urlset>"), ("a", 1, "<loc>https://a/1</loc><loc>https://a/x.pdf</loc><loc>https://a/1</loc>"), ("a", 2, "<loc>https://a/2</loc>"), ("b", 0, None)]
    got = lists.sitemap_urls(spark.createDataFrame(files, "domain string, path_rank int, xml string"))
    assert [tuple(r) for r in got.collect()] == [("a", "https://a/1")]


def test_search_hits(spark):
    body = '{"query":"q","results":[{"url":"https://www.B.org/p","title":"t","score":2.5},{"url":"http://c.org","title":null}]}'
    got = lists.search_hits(spark.createDataFrame([(1, body), (2, "no json"), (3, None)], "pos int, body string")).collect()
    assert [(r["pos"], r["rank"], r["domain"], r["score"]) for r in got] == [(1, 0, "B.org", 2.5), (1, 1, "c.org", None)]


@pytest.mark.parametrize("url, wanted", [
    ("https://www.youtube.com/watch?v=abcdefghijk", "abcdefghijk"), ("https://youtube.com/watch?t=1&v=abc-efg_ijk#x", "abc-efg_ijk"), ("https://youtu.be/abcdefghijk?t=2", "abcdefghijk"),
    ("https://www.youtube.com/embed/abcdefghijk", "abcdefghijk"), ("https://youtu.be/short", None), ("https://x.org/?v=abcdefghijk", None), (None, None),
])
def test_video_id(spark, url, wanted):
    assert spark.createDataFrame([(url,)], "url string").select(lists.video_id(F.col("url")).alias("v")).first()["v"] == wanted


def test_crawl(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("a", "a")], "src string, dst string")
    n = iter(range(100))

    def checkpoint(df):
        df.write.parquet(path := f"{tmp_path}/{next(n)}")
        return spark.read.schema(df.schema).parquet(path)

    seeds = spark.createDataFrame([("a",), ("a",)], "url string")
    depth = {r["url"]: r["depth"] for r in lists.crawl(edges, seeds, checkpoint).collect()}
    assert depth == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert lists.crawl(edges, seeds, checkpoint, most_rounds=1).count() == 2


def _events(spark, path, rows, k):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/in", mode="append" if k else "overwrite")


def _run(stream, mode, name, path):
    stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start().awaitTermination(120)


def _rows(hours, domain="a", latency=100):
    return [(h, domain, T0 + dt.timedelta(hours=h), latency + h, h % 2 == 0) for h in hours]


def test_windows_and_reputation(spark, tmp_path):
    _events(spark, tmp_path, _rows([0, 1, 30]) + _rows([2], "b"), 0)
    stream = feeds.read_events(spark, f"{tmp_path}/in", SCHEMA)
    _run(feeds.windowed_counts(stream, "domain", length="1 day", slide="1 day"), "complete", "windows", tmp_path)
    got = spark.table("windows").select(F.dayofmonth("window_start").alias("d"), "domain", "n").collect()
    assert sorted(tuple(r) for r in got) == [(1, "a", 2), (1, "b", 1), (2, "a", 1)]
    _run(feeds.domain_reputation(feeds.read_events(spark, f"{tmp_path}/in", SCHEMA), F.col("ok")), "complete", "reputation", tmp_path)
    assert sorted((r["domain"], r["total"], r["successes"]) for r in spark.table("reputation").collect()) == [("a", 3, 2), ("b", 1, 1)]


def test_first_seen(spark, tmp_path):
    _events(spark, tmp_path, _rows([0, 1, 2]) + _rows([1], "b"), 0)
    _run(feeds.first_seen(feeds.read_events(spark, f"{tmp_path}/in", SCHEMA), ["domain"]), "append", "firsts", tmp_path)
    assert sorted(r["domain"] for r in spark.table("firsts").collect()) == ["a", "b"]


def test_upsert_batches(spark, tmp_path):
    for k, rows in enumerate([_rows([0]) + _rows([1], "b"), _rows([2])]):
        _events(spark, tmp_path, rows, k)
        stream = feeds.read_events(spark, f"{tmp_path}/in", SCHEMA)
        feeds.upsert_batches(stream, f"{tmp_path}/t", f"{tmp_path}/cp", ["domain"]).start().awaitTermination(120)
    assert sorted((r["domain"], r["seq"]) for r in feeds.current(spark, f"{tmp_path}/t", 1).collect()) == [("a", 2), ("b", 1)]


def test_upserts_expire_what_no_kept_table_needs(spark, tmp_path):
    """Five batches of which two can be read: the newest two are right, an older one is an error, and no other version stays."""
    where = f"{tmp_path}/t"
    for k, rows in enumerate([_rows([0]) + _rows([1], "b"), _rows([2]), _rows([3]) + _rows([4], "c"), _rows([5]), _rows([6], "c")]):
        _events(spark, tmp_path, rows, k)
        stream = feeds.read_events(spark, f"{tmp_path}/in", SCHEMA)
        feeds.upsert_batches(stream, where, f"{tmp_path}/cp", ["domain"], buckets=64, keep=2).start().awaitTermination(120)
    read = lambda n: sorted((r["domain"], r["seq"]) for r in feeds.current(spark, where, n).collect())
    assert read(4) == [("a", 5), ("b", 1), ("c", 6)] and read(3) == [("a", 5), ("b", 1), ("c", 4)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        feeds.current(spark, where, 2)
    # b's first version, a's of the fourth batch, c's of the third and the fifth
    assert sorted(int(p.parent.name[2:]) for p in (tmp_path / "t" / "data").glob("v=*/_bucket=*")) == [0, 2, 3, 4]
    assert feeds.expire(spark, where, 4, 2) == 0 and read(4) == [("a", 5), ("b", 1), ("c", 6)]
    with pytest.raises(ValueError):
        feeds.expire(spark, where, 4, 1)


def test_edits(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, None, None), (None, "c", False)], "id int, x string, is_active boolean")
    changes = spark.createDataFrame([(1, None), (2, "z"), (9, "q")], "id int, x string")
    assert sorted((r["id"] or 0, r["x"]) for r in edits.patched(rows, changes, "id").collect()) == [(0, "c"), (1, "a"), (2, "z")]
    keys = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert {r["id"]: r["is_active"] for r in edits.toggled(rows, keys, "id", "is_active").collect()} == {1: False, 2: None, None: False}
    assert {r["id"]: r["is_active"] for r in edits.soft_deleted(rows, keys, "id").collect()} == {1: False, 2: False, None: False}
    assert [r["id"] for r in edits.cascaded(rows, keys, "id").collect()] == [None]
    cases = [("blog_url", '{"blog_landing_url":"u"}', True), ("blog_url", "{}", False), ("article", '{"word_count":"x"}', False), ("other", "{}", True), ("other", "[1]", False), ("pricing", None, False)]
    got = spark.createDataFrame(cases, "t string, m string, w boolean").select("w", edits.is_valid(F.col("t"), F.col("m")).alias("v")).collect()
    assert all(r["w"] == r["v"] for r in got)


FACTS = "id long, org_id long, domain string, data_type string, metadata string, scraped_at timestamp_ntz"


@pytest.mark.parametrize("cuts", [[], [1], [5, 6, 20], list(range(1, 40))])
def test_changes_in_any_split_into_batches(spark, tmp_path, cuts):
    from webfacts.operators.records import transitions

    values = ["pending", "pending", "running", None, None, "failed", "running", "running", "completed"]
    rows = [(i, f"j{i % 4}" if i % 4 else None, values[(i * 5 + i // 7) % 9]) for i in range(40)]
    want = {tuple(r) for r in transitions(spark.createDataFrame(rows, "seq int, job string, status string"), "job", "status", "seq").select("job", "seq", "old", "status").collect()}
    step = feeds.change_step(f"{tmp_path}/c", "job", "status", "seq", buckets=3)
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, 40])):
        for _ in range(1 + (n == 1)):  # the second batch is run twice
            step(spark.createDataFrame(rows[a:b], "seq int, job string, status string"), n)
    got = [tuple(r) for r in feeds.changes(spark, f"{tmp_path}/c").select("job", "seq", "old", "status").collect()]
    assert len(got) == len(want) and set(got) == want


def test_change_feed_goes_on_after_a_restart(spark, tmp_path):
    for k, ok in enumerate([True, True, False]):
        _events(spark, tmp_path, [(k, "a", T0 + dt.timedelta(hours=k), 1, ok)], k)
        stream = feeds.read_events(spark, f"{tmp_path}/in", SCHEMA)
        feeds.change_feed(stream, f"{tmp_path}/c", f"{tmp_path}/cp", "domain", "ok", "seq").start().awaitTermination(60)
    assert sorted((r.seq, r.old, r.ok) for r in feeds.changes(spark, f"{tmp_path}/c").collect()) == [(0, None, True), (2, True, False)]


def test_alerts_fire_once(spark, tmp_path):
    """A batch that is run again fires nothing twice, a window fires once, and counts are those of one evaluation of all facts."""
    from webfacts.operators import signals

    fact = lambda i, hour: (i, 1, f"d{i % 2}", "job_posting", "{}", T0 + dt.timedelta(hours=hour))
    rules = spark.createDataFrame([(1, 1, '{"type": "hiring_spike", "filters": {"spike_threshold": 1}}'), (2, 1, '{"type": "funding_round"}')], "signal_id int, org_id long, trigger_config string")
    batches = [[fact(0, 0.1)], [fact(2, 0.2), fact(1, 0.3)], [fact(3, 0.4)], [fact(4, 1.5)], []]
    step = feeds.alert_step(rules, f"{tmp_path}/a")
    for n, rows in enumerate(batches):
        for _ in range(2):
            step(spark.createDataFrame(rows, FACTS), n)
    got = sorted((r.signal_id, r.window_start.hour, r.match_count) for r in feeds.alerts(spark, f"{tmp_path}/a").collect())
    assert got == [(1, 0, 1), (1, 1, 2)]
    every = spark.createDataFrame([r for b in batches for r in b], FACTS)
    last = signals.evaluate(rules, every, F.lit(T0 + dt.timedelta(hours=1.5, microseconds=1)).cast("timestamp_ntz")).collect()
    assert [(r.signal_id, r.match_count) for r in last] == [(1, 2)]
