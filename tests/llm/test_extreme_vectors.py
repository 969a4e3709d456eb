"""Near-duplicate vectors of extreme magnitudes, of labels that are texts, and beside columns whose names clash."""

import numpy as np
import pytest

SCHEMA = "vec_id long, label long, embedding array<double>"


def plain(rows, cosine=0.93):
    """{vec_id: (n_links, component_id)} in exact enough arithmetic: each vector is divided by its largest component first."""
    known = [(i, label, np.array(x, dtype=np.longdouble)) for i, label, x in rows if label is not None and x and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    known = [(i, label, (v / abs(v).max()) / np.sqrt((np.square(v / abs(v).max())).sum())) for i, label, v in known]
    links, up = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}
    for n, (i, a, v) in enumerate(known):
        for j, b, w in known[:n]:
            if a == b and len(v) == len(w) and v @ w >= cosine:
                links[i], links[j] = links[i] + 1, links[j] + 1
                x, y = up[i], up[j]
                up = {k: min(x, y) if c in (x, y) else c for k, c in up.items()}
    return {i: (links[i], up[i]) for i in links}


def found(df):
    from webfacts.llm.embedding_dedup import near_vectors

    return {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}


def test_magnitudes(spark):
    rows = [
        (1, 1, [1e200, 1e200, 0.0]), (2, 1, [1e200, 1.0001e200, 0.0]), (3, 1, [1e-200, 1e-200, 0.0]), (4, 1, [5e-324, 5e-324, 0.0]), (5, 1, [1.7e308, 1.7e308, 1.7e308]), (6, 1, [1e-308, 1e-308, 1e-308]),
        (7, 1, [1e300, 1e-300, 0.0]), (8, 1, [3.0, 0.0, 1e-320]), (9, 1, [0.0, 0.0, 0.0]), (10, 1, [float("inf"), 1.0, 0.0]), (11, 1, [-1e250, -1e250, 0.0]), (12, 1, [1.0, 1.0, 1e-9]), (13, None, [1.0, 1.0, 0.0]), (14, 1, [1.0, None, 0.0]), (15, 1, None), (16, 1, []),
    ]
    got = found(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got == plain(rows) and got[1] == (4, 1) and got[6] == (1, 5) and got[7] == (1, 7)


@pytest.mark.parametrize("scale", [1.0, 1e200, 1e-200, 1e-310])
def test_scale_changes_nothing(spark, scale):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    data = np.concatenate([base, base + 0.05 * rng.normal(size=base.shape)])
    rows = [(i, i % 2, (v * (scale if i % 3 else 1.0)).tolist()) for i, v in enumerate(data)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_labels_of_text_and_clashing_columns(spark):
    rows = [(1, "a", [1.0, 0.1], 1), (2, "a", [1.0, 0.1], 2), (3, "b", [1.0, 0.1], 3), (4, "1", [1.0, 0.1], 4), (5, None, [1.0, 0.1], 5)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>, size long")
    for name in ("doc", "n_links", "key", "a.b", "KEPT"):
        assert found(df.withColumnRenamed("size", name)) == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5)}


def test_unlike_vectors_of_one_id(spark):
    """Rows of one vec_id are one vertex: what either is linked with hangs together."""
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (1, 1, [0.0, 1.0]), (3, 1, [1.0, 0.0])]
    from webfacts.llm.embedding_dedup import near_vectors

    out = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.component_id) for r in out) == [(1, 1), (1, 1), (2, 1), (3, 1)]
