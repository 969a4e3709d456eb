"""Every query with an oracle returns the oracle's rows."""

import glob
import math
import os

import duckdb
import pytest

from webfacts.plans.catalog import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def _key(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(str(cell(r[i])) for i in order) for r in rows))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    rows = got.collect()
    if name in ORACLE:
        want = duck.sql(ORACLE[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert _key(rows, got.columns) == _key(want.fetchall(), want.columns)
