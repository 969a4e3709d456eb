"""Columns whose names hold dots or differ by case, and labelled rows that repeat."""

import pytest

WORDS = {"en": "the quick brown fox jumps over one lazy dog and more words follow here", "de": "der schnelle braune fuchs springt über einen faulen hund und noch mehr wörter"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, WORDS[lang] + f" {i}", lang, "x", 1, 2, 3) for i in range(60) for lang in [["en", "de"][i % 2]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` string, Score int, `we``ird` int, REJECTED int")


def test_names(spark, docs):
    from webfacts.llm.language_id import identify
    from webfacts.llm.quality_classifier import classify

    out = identify(docs)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "a.b", "Score", "we`ird", "held_out", "lang_pred", "lang_score", "bits", "rejected"])
    assert {r["a.b"] for r in out.collect()} == {"x"} and out.count() == 60
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = classify(docs, labels)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "a.b", "we`ird", "REJECTED", "held_out", "score", "predicted"]) and out.count() == 60


def test_repeated_labelled_rows_are_learned_once(spark, docs, monkeypatch):
    """A doc_id with very many rows is one document of the sample, and the features that come to the driver are bounded."""
    from webfacts.llm import quality_classifier as q

    seen = []
    monkeypatch.setattr(q, "_sgd", lambda rows, *a: seen.append([len(r[0]) for r in rows]) or q.np.zeros(1))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    many = docs.select("doc_id", "text").union(spark.range(30_000).selectExpr("7L AS doc_id", "concat('a text of number ', id) AS text"))
    q.train(docs, labels)
    q.train(many, labels)
    assert len(seen[0]) == len(seen[1]) < 40
    q.train(many, labels, sample_docs=10)
    assert len(seen[2]) == 10
    q.train(many, labels, sample_features=sum(seen[0][:5]))
    assert 1 <= len(seen[3]) < 10 and sum(seen[3]) <= sum(seen[0][:5])
