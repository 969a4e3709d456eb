"""Rare languages, long clean texts and short gibberish."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string"
COMMON = "the of and to in is you that it he was for on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who oil its now find long down day did get come made may part".split()
RARE = "και το να είναι που δεν για με στο από θα τον την των ένα αυτό όλα μου σου μας καλά νερό σπίτι δρόμος".split()


def words(seed, n, of=COMMON):
    r = random.Random(seed)
    return " ".join(r.choice(of) for _ in range(n))


def test_rare_language_of_a_large_table(spark):
    """One row in thousands: its language is learned, has a limit, and its other rows are told."""
    from webfacts.llm.language_id import identify, train

    # hashes past those of the first thousands of rows, and not held out
    late = spark.range(50_000, 51_000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h")).where("h > 0 and crc32(cast(doc_id as string)) % 3 <> 1").limit(6)
    rare = spark.createDataFrame([(r.doc_id, words(r.doc_id, 30, RARE), "el") for r in late.collect()] + [(60_000 + i, words(i, 30, RARE), None) for i in range(20)], SCHEMA)
    text = F.element_at(F.array(*[F.lit(words(i, 8)) for i in range(50)]), (F.col("id") % 50 + 1).cast("int"))
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang")).unionByName(rare)
    model = train(docs)
    assert model.langs == ["el", "en"] and all(x < float("inf") for x in model.limit)
    out = identify(docs).where("doc_id >= 50000").collect()
    assert len(out) == 26 and all(r.lang_pred == "el" and not r.rejected for r in out)


def test_sample_is_the_first_rows_by_hash(spark):
    """Just the bound of rows of a language, those of the smallest buckets, also with null and repeated doc_ids."""
    from webfacts.llm.language_id import labelled_sample

    rows = [(i, f"a{i}", "a") for i in range(500)] + [(i, f"b{i}", "b") for i in range(7)] + [(None, f"c{i}", "c") for i in range(90)] + [(3, "d", "d")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = labelled_sample(df, 50, 20).collect()
    n = lambda lang, cal=(True, False): sum(r.lang == lang and r.calibrates in cal for r in got)
    assert [n(x) for x in "abcd"] == [50, 7, 50, 1]
    assert [n(x, [True]) for x in "abcd"] == [20, 3, 20, 0]
    assert sorted(map(tuple, got)) == sorted(map(tuple, labelled_sample(df.repartition(7), 50, 20).collect()))


def test_long_clean_texts_and_short_gibberish(spark):
    from webfacts.llm.language_id import identify

    # one document among the labelled ones is long and mislabelled
    plain = [(i, words(i, 12 + i % 60), "en") for i in range(600)]
    wrong = [(i, words(i, 4000, RARE), "en") for i in range(600, 640)][:4]
    shifted = words(1, 100_000) + " " + words(2, 100_000, [w[::-1] if k % 8 == 0 else w for k, w in enumerate(COMMON)])
    assert len(shifted) > 800_000
    r = random.Random(3)
    junk = [(2000 + i, "".join(r.choice("qxzjvkwpb") for _ in range(30)), None) for i in range(20)]
    out = {x.doc_id: x for x in identify(spark.createDataFrame([*plain, *wrong, (1000, shifted, None), *junk], SCHEMA)).collect()}
    assert not out[1000].rejected
    assert all(out[2000 + i].rejected for i in range(20))
    assert not any(out[i].rejected for i in range(600))


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_labelled_rows(spark, n):
    """Languages too rare to calibrate take the deviations of the others, so gibberish is rejected all the same."""
    from webfacts.llm.language_id import train

    rows = [(i, words(i, 30), "en") for i in range(300)]
    ids = [r.id for r in spark.range(500, 600).where("crc32(cast(id as string)) % 3 <> 1").limit(n).collect()]
    model = train(spark.createDataFrame(rows + [(i, words(i, 40, RARE), "el") for i in ids], SCHEMA))
    assert model.langs == ["el", "en"] and model.limit[0] == model.limit[1] < float("inf") and model.mean[0] > 0


def test_labels_without_letters(spark):
    from webfacts.llm.language_id import identify

    out = identify(spark.createDataFrame([(i, "123 ...", "en") for i in range(9)], SCHEMA)).collect()
    assert len(out) == 9 and all(r.lang_pred == "und" and r.rejected for r in out)


def test_model_is_kneser_ney(spark):
    """Bits a character of a plain interpolated model with the same discount."""
    import math
    from collections import Counter, defaultdict

    import numpy as np

    from webfacts.llm.language_id import _entropy, grams_of, kneser_ney

    def chars(x):
        out = [" "]
        for c in x.lower():
            if c.isalpha() or out[-1] != " ":
                out.append(c if c.isalpha() else " ")
        return "".join(out)

    own = {0: [words(1, 40), "ab, ba!"], 1: [words(2, 30, RARE), "Ünï  ab"]}
    d, alphabet, models = 0.75, 1 << 12, []
    for texts in own.values():
        c3 = Counter()
        for x in texts:
            s = " " + chars(x)
            c3.update(s[i : i + 3] for i in range(len(s) - 2))
        c2, c1 = Counter(g[1:] for g in c3), Counter()
        c1.update(g[1:] for g in c2)
        after = {n: defaultdict(Counter) for n in (2, 3)}
        for n, c in ((2, c2), (3, c3)):
            for g, k in c.items():
                after[n][g[:-1]][g[-1]] += k

        def p(a, b, c, c1=c1, after=after):
            out = max(c1[c] - d, 0) / sum(c1.values()) + (d * len(c1) / sum(c1.values()) + 1e-9) / alphabet
            for n, context in ((2, b), (3, a + b)):
                row = after[n].get(context)
                if row:
                    total = sum(row.values())
                    out = max(row[c] - d, 0) / total + d * len(row) / total * out
            return out

        models.append(p)
    code, lang, count = [], [], []
    for k, texts in own.items():
        x, n = np.unique(grams_of([t.encode() for t in texts])[2], return_counts=True)
        code.append(x), count.append(n), lang.append(np.full(len(x), k))
    model = kneser_ney(np.concatenate(lang), np.concatenate(code), np.concatenate(count), ["en", "el"])
    for x in [words(5, 9), words(6, 9, RARE), "zzz q", "ab ünï δρ"]:
        bits, n, _ = _entropy(model, [x.encode()])
        s = " " + chars(x)
        assert n[0] == len(s) - 2
        for k, p in enumerate(models):
            want = -sum(math.log2(p(s[i], s[i + 1], s[i + 2])) for i in range(len(s) - 2)) / n[0]
            assert abs(bits[0, k] - want) < 1e-4, (x, k, bits[0, k], want)
