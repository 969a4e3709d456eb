"""Signatures as a relation, closures in one plan, extraction that falls back by coverage."""

import pytest
from pyspark.sql import functions as F

from webfacts.functions import signatures
from webfacts.operators import extraction
from webfacts.sources import lists


@pytest.mark.parametrize("limit", [200_000, 2])  # by an automaton, by a join
def test_signatures(spark, monkeypatch, limit):
    monkeypatch.setattr(signatures, "SIGNALS", limit)
    pages = [(1, "a WP-Content wp-content/x", {"server": "NGINX"}), (2, None, {"x-powered-by": "express"}), (3, None, None), (4, "", None), (5, "he she hers", {}), (5, "ushers", None), (None, "nginx", None), (6, "n" * 100_000 + "ginx", None)]
    known = [("WordPress", "cms", "wp-content"), ("WordPress", "cms", "wp-content"), ("Nginx", "server", "nginx"), ("Express", "framework", "express"), ("H", "x", "he"), ("H2", "x", "hers"), ("S", "y", "he"), ("E", "y", ""), ("N", "y", None)]
    df = spark.createDataFrame(pages, "page_id int, html string, headers map<string,string>")
    rel = spark.createDataFrame(known, "name string, category string, signal string")
    got = [tuple(r) for r in signatures.matched(df, "page_id", signatures.searched(F.col("html"), F.col("headers")), rel).collect()]
    want = {(i, *k) for i, h, m in pages for k in known if k[2] and k[2] in "\n".join([*([h] if h is not None else []), *((m or {}).values())]).lower()}
    assert len(got) == len(want) and set(got) == want
    assert signatures.matched(df, "page_id", signatures.searched(F.col("html")), rel.limit(0)).count() == 0


def test_closure(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "a"), ("x", "y"), ("d", None), (None, "z")] + [(f"n{i}", f"n{i + 1}") for i in range(40)], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",), ("n0",), (None,)], "url string")
    got = {r.url: r.depth for r in lists.closure(edges, seeds, 12).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3} | {f"n{i}": i for i in range(13)}
    assert {r.url for r in lists.closure(edges, seeds, 0).collect()} == {"a", "n0"} and lists.closure(edges.limit(0), seeds.limit(0), 3).count() == 0


def test_fallback_sees_weak_pages_alone(spark):
    pages = spark.createDataFrame([(1, "<h1>A</h1><h2>B</h2>"), (2, "<h1>C</h1>"), (3, "<p>x</p>"), (4, None), (5, "<h2>only</h2><i>y</i>")], "page_id int, html string")
    schema = [extraction.Field("one", "h1"), extraction.Field("two", "h2"), extraction.Field("three", "h3")]
    asked = []

    def second(rows):
        asked.append(sorted(r.page_id for r in rows.collect()))
        return rows.where("page_id <> 3").select("page_id", F.create_map(F.lit("three"), F.lit("Z"), F.lit("one"), F.lit("W")).alias("fields"))

    got = {r.page_id: (r.mode, dict(r.fields), round(r.coverage, 3)) for r in extraction.extracted(pages, schema, second).collect()}
    assert asked == [[2, 3, 4, 5]]
    assert got == {1: ("css", {"one": "A", "two": "B"}, 0.667), 2: ("ai", {"one": "W", "three": "Z"}, 0.667), 3: ("ai", {}, 0.0), 4: ("ai", {"one": "W", "three": "Z"}, 0.667), 5: ("ai", {"one": "W", "two": "only", "three": "Z"}, 1.0)}
    assert {r.mode for r in extraction.extracted(pages, schema, second, mode="css").collect()} == {"css"} and len(asked) == 1
    assert {r.page_id: r.coverage for r in extraction.extracted(pages, schema, second, mode="ai").collect()}[1] == pytest.approx(2 / 3) and asked[1] == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        extraction.extracted(pages, schema, second, mode="other")
