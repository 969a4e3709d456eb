"""Rows that differed from the queries' SQL on other tables than the given ones."""

import json

from pyspark.sql import functions as F


def _records(spark, n):
    return spark.range(n).select(
        F.col("id"), F.lit(7).alias("job_id"), F.lit("a.org").alias("domain"), F.lit("page").alias("data_type"), F.lit("/x").alias("url"),
        F.lit(None).cast("string").alias("title"), F.lit("{}").alias("metadata"), F.lit("2024").alias("scraped_at"))


def test_a_large_job_has_one_envelope(spark):
    from webfacts.operators.exports import job_envelopes

    facts, jobs = _records(spark, 2500).repartition(5), spark.createDataFrame([(7, "a.org")], "job_id int, domain string")
    [row] = job_envelopes(jobs, facts, F.lit("now")).collect()
    payload = json.loads(row.payload)
    assert row.records == payload["total_records"] == 2500 and [int(r["id"]) for r in payload["data"]] == list(range(2500))
    parts = job_envelopes(jobs, facts, F.lit("now"), per_part=1000).collect()
    assert len(parts) == 3 and sorted(int(r["id"]) for p in parts for r in json.loads(p.payload)["data"]) == list(range(2500))


def test_a_large_job_has_one_webhook(spark):
    from webfacts.operators.exports import webhook_payloads

    [row] = webhook_payloads(_records(spark, 2500).repartition(5)).collect()
    payload = json.loads(row.payload)
    assert payload["count"] == 2500 and [int(r["id"]) for r in payload["data"]] == list(range(2500))


def test_stamps_of_webhooks_keep_their_seconds(spark, tmp_path):
    """A stamp loses the zeros at its fraction's end only, as in the queries' SQL."""
    import duckdb

    from webfacts.plans.catalog import ORACLE, QUERIES

    times = ["00:00:10", "00:00:00", "10:20:30.5", "10:20:30.050", "23:59:40.000001", "12:00:01"]
    events = f"SELECT i::BIGINT AS event_id, ('2024-01-02 ' || t)::TIMESTAMP AS ts, (i % 2)::BIGINT AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{}}' AS props FROM (SELECT unnest({times}) AS t, unnest(range(6)) AS i)"
    db = duckdb.connect()
    db.execute(f"COPY ({events}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    db.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    for name in ("k09_webhooks", "k07_envelopes"):
        want = sorted(db.execute(ORACLE[name]).fetchall())
        assert sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want and '"scraped_at":"2024-01-02 00:00:10"' in want[0][-1]

def test_references_end_with_a_semicolon(spark):
    from webfacts.functions import dom as D
    from webfacts.operators.extraction import rich_metadata

    html = "<title>a &lt;b&gt; &#39;c&#39; &amp;&amp &lt d&amp</title><script>x && y &amp; &amp z</script><a href='/?a=1&copy=2&amp;b=&amp'>R&D &amp;</a>"
    row = D.with_nodes(spark.createDataFrame([(1, "https://a.org/", html)], "page_id int, url string, html string")).select(
        rich_metadata(F.col("dom"), F.col("url"))["title"].alias("title"), D.first(F.col("dom"), "a")["attrs"]["href"].alias("href"),
        D.text_of(F.col("dom"), D.first(F.col("dom"), "a")).alias("text"), D.raw_text(F.col("dom"), D.first(F.col("dom"), "script"), "#code").alias("code")).first()
    assert tuple(row) == ("a <b> 'c' &&amp &lt d&amp", "/?a=1&copy=2&b=&amp", "R&D &", "x && y &amp; &amp z")


def test_numbers_in_titles_are_no_errors(spark):
    from webfacts.functions.html import is_error_title

    errors = ["404", "404 - Acme", "Acme | 404", "Acme - 404", "Oops! 404", "HTTP 404", "Page 404", "(404) gone", "Error 5", "Page Not Found", "Server error"]
    good = ["Acme 404", "Acme 1404", "Acme 4040", "Lot $404", "Suite #404", "404,000 readers", "Welcome", None]
    rows = spark.createDataFrame([(t,) for t in errors + good], "title string").withColumn("e", is_error_title(F.col("title"))).collect()
    assert [r.title for r in rows if r.e] == errors


def test_pages_with_a_number_like_404_give_records(spark):
    from webfacts.functions import dom as D
    from webfacts.operators.extraction import page_records

    page = lambda t: f"<html><head><title>{t}</title></head><body>{'some words ' * 120}</body></html>"
    pages = spark.createDataFrame([(i, "https://a.org/", page(t)) for i, t in enumerate(["Acme 404", "404 - Acme", "Acme 1404"])], "page_id int, url string, html string")
    nodes = D.with_nodes(pages.withColumn("_raw", F.col("html")), "_raw", keep=["page_id", "url", "html"])
    got = page_records(nodes, ["article", "tech_stack"]).select("page_id", "data_type").collect()
    assert sorted(tuple(r) for r in got) == [(i, t) for i in (0, 2) for t in ("article", "page", "tech_stack")]


def test_an_invalid_first_line_counts(spark, tmp_path):
    from webfacts.plans.catalog import QUERIES
    from webfacts.sources.lists import uploaded_domains

    # the first customer of an odd nation whose number gives a line without a domain
    keys = [(11, 1), (12, 1), (22, 2), (23, 2), (35, 3), (33, 3)]
    spark.createDataFrame(keys, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = QUERIES["s09_uploads"](spark, str(tmp_path)).collect()
    assert sorted((r.upload_id, r.pos, r.domain, r.state) for r in got) == [(1, 0, "nodot", "invalid"), (1, 1, "f0.org", "valid"), (2, 1, "c2.org", "valid"), (3, 0, "nodot", "invalid"), (3, 1, "WWW.a.org", "valid")]
    lines = spark.createDataFrame([(1, 0, ["who"]), (1, 1, ["a.org"]), (2, 0, ["Site"]), (2, 1, ["b.org"])], "upload_id int, pos int, cells array<string>")
    assert {(r.domain, r.state) for r in uploaded_domains(lines).collect()} == {("a.org", "valid"), ("b.org", "valid")}
    assert {(r.domain, r.state) for r in uploaded_domains(lines, guess=False).collect()} == {("who", "invalid"), ("a.org", "valid"), ("b.org", "valid")}


def test_nodes_of_a_batch_are_made_in_slices(spark):
    import pyarrow as pa

    from webfacts.functions import dom as D

    html = pa.array(["<p>" + "x" * 600_000, None, "", "<b>y", "<i>" + "z" * 3_000_000, "<u>end"])
    assert list(D._slices(html)) == [(0, 4), (4, 1), (5, 1)] and list(D._slices(html.slice(0, 0))) == []
    pages = spark.createDataFrame([(i, x) for i, x in enumerate(html.to_pylist())], "page_id int, html string").coalesce(1)
    rows = D.with_nodes(pages)
    assert [(r.page_id, r.n) for r in rows.select("page_id", F.size("dom").alias("n")).orderBy("page_id").collect()] == [(0, 2), (1, None), (2, 0), (3, 2), (4, 2), (5, 2)]


def test_memory_of_a_batch_of_pages(spark):
    """Nodes of a large batch take no more at once than those of a slice."""
    import tracemalloc

    import pyarrow as pa

    from webfacts.functions import dom as D

    html = pa.array(["<ul>" + "<li class=a><a href='/x'>y</a>" * 40 + "</ul>"] * 4000)  # 5 MB, 480,000 nodes
    tracemalloc.start()
    n = 0
    for start, k in D._slices(html):
        splitter = D._Splitter()
        for x in html.slice(start, k):
            splitter.page(x.as_py())
        n += len(splitter.arrow().flatten())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4000 * 121 and peak < 60e6, peak
