"""The crawl closure has no depth bound of its own."""

import pytest

from webfacts.sources import lists


def test_long_chain(spark, tmp_path):
    n = iter(range(100))

    def checkpoint(df):
        df.write.parquet(path := f"{tmp_path}/{next(n)}")
        return spark.read.schema(df.schema).parquet(path)

    edges = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(13)], "src string, dst string").coalesce(1).cache()
    seeds = spark.createDataFrame([("p0",)], "url string")
    assert {r["url"]: r["depth"] for r in lists.crawl(edges, seeds, checkpoint).collect()} == {f"p{i}": i for i in range(14)}
    with pytest.raises(RuntimeError):
        lists.crawl(edges, seeds, checkpoint, guard=2)
