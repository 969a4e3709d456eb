"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables and further columns."""

import functools
import math
import zlib
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

WORDS = "the quick brown fox jumps over one lazy dog while seven small birds watch from an old green tree near our river".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, score string, kept string"


def text(seed, n):
    return " ".join(WORDS[(seed * 7 + i * i * (seed % 5 + 1) + i // 3) % len(WORDS)] for i in range(n))


def rows():
    long = text(3, 40_000)
    base = [(i, text(i, 60 + i), "en" if i % 2 else "xx", f"src{i % 3}", 1) for i in range(40)]
    base += [(100, None, "en", "src1", None), (101, "", None, None, 0), (102, " \n\t ", "en", None, 3), (103, "one two", "en", "src1", 7), (104, "!!! ???", None, "src2", 7)]
    base += [(105, long, "en", "src0", len(long)), (106, text(5, 65).upper(), "en", "src0", 1), (5, text(5, 65), "en", "src2", 1), (107, text(5, 65) + " end", "en", "src1", 1)]
    base += [(108, "x\x00y CC BY here, all  rights\nreserved © été", "en", "odd", 1), (109, "This work is licensed under the GNU General Public License, version 3.", "en", "src2", 1), (110, "q" * 70_000, "en", "src2", 1)]
    base += [(None, "a row without a number", "en", "src1", 1), (111, "#### $$ a | b", "xx", "src1", 1)]
    return [(*r, "x", "y", "z") for r in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs, none):
    from webfacts.llm.minhash import near_duplicates

    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect() if r.doc_id is not None}
    want = brute.near_duplicates([(r[0], r[1]) for r in rows() if r[0] is not None])
    assert got == {(i, n, c, i == c) for i, (n, c) in want.items()}
    assert near_duplicates(none).count() == 0


def test_near_duplicates_split_nodes(spark):
    """Nodes larger than a leaf: branching, stars and blocks find what an exact join finds."""
    from webfacts.llm.minhash import near_duplicates

    family = []
    for i in range(90):
        w = text(2, 120).split()
        for k in range(i % 7):
            w[(i * 13 + k * 31) % 120] = f"w{i}x{k}"
        family.append((i, " ".join(w)))
    want = brute.near_duplicates(family)
    for levels, block in ((1, 256), (1, 8), (3, 8)):  # whole clusters, clusters in blocks, and at the last level
        out = near_duplicates(spark.createDataFrame(family, "doc_id long, text string"), leaf=8, levels=levels, block=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
        assert sum(r.stays for r in out) == sum(r.kept for r in out) == len({c for _, c in want.values()})


def test_near_duplicates_rows_are_documents(spark):
    """Null and repeated doc_ids, with equal and with different texts."""
    from webfacts.llm.minhash import near_duplicates

    a, b, c = (text(i, 80) for i in (2, 3, 4))
    data = [(7, a), (7, b), (7, a), (3, a), (None, b), (None, c), (None, c), (None, None), (9, ""), (9, ""), (2, c + " more")]
    out = near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    got = sorted((r.doc_id or 0, r.n_shingles > 0, r.component_id or 0, r.kept) for r in out)
    assert got == sorted([(7, True, 3, False)] * 2 + [(3, True, 3, True), (7, True, 7, True), (0, True, 7, False)] + [(0, True, 2, False)] * 2 + [(2, True, 2, True), (0, False, 0, False)] + [(9, False, 9, True)] * 2)
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in out if r.stays) == [(0, 0), (2, 2), (3, 3), (7, 7), (9, 9), (9, 9)]


def test_near_dedup_stage(spark):
    import corpus_pipeline as p

    a, b, c = (text(i, 80) for i in (2, 3, 4))
    data = [(7, a, 1), (7, b, 2), (7, a, 3), (3, a, 4), (None, b, 5), (None, c, 6), (None, c, 7), (None, None, 8), (9, "", 9), (9, "", 9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_chars long")
    out = sorted((r.doc_id or 0, r.text or "") for r in p.near_dedup(spark, docs, "").collect())
    assert out == sorted([(7, b), (3, a), (0, c), (0, ""), (9, "")])


def test_license_scan(docs, none):
    import re

    from webfacts.llm.license_scan import PHRASES, scan

    got = {(r.doc_id, r.n_words): r for r in scan(docs).collect()}
    for r in rows():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = sorted(i for p in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        g = got[r[0], len(words)]
        assert (g.n_base, g.first_word, g.last_word) == (len(at), at[0] if at else None, at[-1] if at else None)
        assert 0 <= g.score <= 1
    assert got[108, 10].base_labels == "cc-by,reserved"
    assert got[109, 12].labels == "gpl,gpl-work"
    assert scan(none).count() == 0


def test_license_spans_with_a_word_put_in(spark):
    from webfacts.llm.license_scan import TEMPLATES, scan

    w = TEMPLATES["bsd"].split()
    df = spark.createDataFrame([(1, "before it " + " ".join(w[:9] + ["oddly"] + w[9:]) + " after"), (2, " ".join(w[:6]))], "doc_id long, text string")
    for limit in (1_000_000, 0):  # templates that are broadcast, and that are shuffled
        with pytest.MonkeyPatch.context() as m:
            m.setattr("webfacts.llm.license_scan.BROADCAST_CHARS", limit)
            got = [(r.doc_id, x.template, x.start_word) for r in scan(df).collect() for x in r.spans or []]
        assert got == [(1, "bsd", 2)]


def test_license_rows_of_one_doc_id(spark):
    """Each row has the labels of its own text."""
    from webfacts.llm.license_scan import scan

    rows = [(None, "nothing to see here at all"), (None, "Released under the MIT License"), (7, "plain words only"), (7, "Released under the MIT License"), (7, "Released under the MIT License")]
    got = sorted((r.doc_id or 0, r.n_words, r.labels, r.score) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(0, 6, "", 0.0), (0, 5, "mit-notice", 1.0), (7, 3, "", 0.0)] + [(7, 5, "mit-notice", 1.0)] * 2)


def test_license_rivals(spark):
    """Two notices that differ by one word: each text has the label of the one that fits."""
    from webfacts.llm.license_scan import TEMPLATES, scan

    rows = [(1, TEMPLATES["cc-by-4.0"]), (2, TEMPLATES["cc-by-sa"]), (3, f"{TEMPLATES['cc-by-4.0']} and {TEMPLATES['cc-by-sa']}")]
    got = {r.doc_id: r.labels for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "cc-by-4.0", 2: "cc-by-sa", 3: "cc-by-4.0,cc-by-sa"}


def test_ctw(docs, none):
    from webfacts.llm.lm_scoring import score

    got = defaultdict(list)
    for r in score(docs).collect():
        got[r.doc_id].append(r)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    split = lambda x: (x or "").encode().lower().split()
    c = Counter(w for r in rows() if not held(r[0]) for w in [*split(r[1]), None])
    n, v = sum(c.values()), len(c)
    for r in rows():
        tokens = [*split(r[1]), None]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert any(
            g.n_tokens == len(tokens) and g.n_known == sum(c[w] > 0 for w in tokens) and math.isclose(g.base_score, base, rel_tol=1e-9) and g.train_tokens == n and g.held_out == held(r[0])
            for g in got[r[0]])
    assert all(g.score < 0 for own in got.values() for g in own)
    assert score(none).count() == 0


def test_ctw_rare_words_are_joined(docs):
    from webfacts.llm.lm_scoring import score

    key = lambda df: sorted((r.doc_id or -1, r.n_known, round(r.base_score, 6)) for r in df.collect())
    assert key(score(docs, frequent=3)) == key(score(docs))


def test_ctw_rows_are_distributions(docs):
    import numpy as np

    from webfacts.llm.lm_scoring import counts, tree

    model = tree(counts(docs).where("kind = 1"), contexts=60)
    assert np.allclose((10.0 ** model.rows.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_ctw_scores_are_those_of_the_whole_tree(docs):
    from webfacts.llm.lm_scoring import score

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    low = lambda x: b"\0\0\0" + bytes(y + 32 if 65 <= y <= 90 else y or 255 for y in (x or "").encode()) + b"\0"
    seen, below = defaultdict(Counter), defaultdict(set)
    for r in rows():
        x = low(r[1])
        for i in range(3, 0 if held(r[0]) else len(x)):
            for d in range(4):
                seen[x[i - d : i]][x[i]] += 1
                if d:
                    below[x[i - d + 1 : i]].add(x[i - d : i])

    @functools.cache
    def bits(context, k, prefix):
        n = [0, 0]
        for byte, m in seen[context].items():
            if byte >> (8 - k) == prefix:
                n[byte >> (7 - k) & 1] += m
        return n

    def block(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @functools.cache
    def weighted(context, k, prefix):
        own = block(*bits(context, k, prefix))
        if len(context) == 3 or not sum(bits(context, k, prefix)):
            return own
        rest = sum(weighted(c, k, prefix) for c in below[context])
        return max(own, rest) + math.log1p(math.exp(-abs(own - rest))) - math.log(2)

    @functools.cache
    def one(context, k, prefix):
        mix, share, kt = 0.0, 1.0, 0.5
        for d in range(4):
            if d and context[3 - d :] not in seen:
                break
            a, b = bits(context[3 - d :], k, prefix)
            kt, stay = (b + 0.5) / (a + b + 1), 1.0 if d == 3 else min(1.0, math.exp(block(a, b) - math.log(2) - weighted(context[3 - d :], k, prefix)))
            mix, share = mix + share * stay * kt, share * (1 - stay)
        return min(max(mix + share * kt, 1e-9), 1 - 1e-9)

    want = defaultdict(list)
    for r in [x for x in rows() if len(x[1] or "") < 400][:40]:
        x, total = low(r[1]), 0.0
        for i in range(3, len(x)):
            for k in range(8):
                p = one(x[i - 3 : i], k, x[i] >> (8 - k))
                total += math.log10(p if x[i] >> (7 - k) & 1 else 1 - p)
        want[r[0]].append(total)
    for contexts in (0, 7, 12_288):
        got = defaultdict(list)
        for r in score(docs, contexts=contexts).collect():
            got[r.doc_id].append(r.score)
        for i, totals in want.items():
            assert all(any(math.isclose(g, t, rel_tol=1e-4) for g in got[i]) for t in totals), (contexts, i, got[i], totals)


def test_quality_rules(docs, none):
    from webfacts.llm.quality_rules import judge

    got = {(r.doc_id, r.word_chars): r for r in judge(docs).collect()}
    for r in rows():
        x = r[1] or ""
        words = [str(w, "utf-8") for w in x.encode().split()]
        win = Counter(zip(words, words[1:], words[2:]))
        rep = {i + k for i, t in enumerate(zip(words, words[1:], words[2:])) if win[t] > 1 for k in range(3)}
        lines = [y for y in x.split("\n") if y.encode().split()]
        g = got[r[0], sum(map(len, words))]
        assert (g.n_words, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(words), sum(y in "#*$%&|<>" for y in x), len(lines) - len(set(lines)), len(rep))
        assert g.base_failed == (len(words) < 50 or 100 * len(rep) > 50 * len(words)) and not (g.base_failed and g.kept)
    assert judge(none).count() == 0


def test_host_verdicts(spark):
    """The prior by moments, and what it makes of small and large hosts; the verdicts in place."""
    from webfacts.llm.quality_rules import host_verdicts, judge

    counts = {"big": (900, 90), "bad": (400, 360), "one": (1, 1), None: (3, 0)}
    rows = [(h, i < bad) for h, (n, bad) in counts.items() for i in range(n)]
    got = {r.host: r.host_rate for r in host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    n, m = len(rows), sum(f for _, f in rows) / len(rows)
    spread = sum(k * (bad / k - m) ** 2 for k, bad in counts.values()) / n
    share = (spread / (m * (1 - m)) - 4 / n) / (1 - 4 / n)
    strength = min(max(1 / share - 1, 1.0), 1000.0)
    assert got == pytest.approx({h: (bad + m * strength) / (k + strength) for h, (k, bad) in counts.items()})
    # hosts that differ by chance alone are taken for alike
    same = [(f"h{i}", (i * 7 + j) % 4 == 0) for i in range(200) for j in range(4)]
    assert all(abs(r.host_rate - 0.25) < 1e-3 for r in host_verdicts(spark.createDataFrame(same, "host string, failed boolean")).collect())
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    docs = [(i, own(i), "good") for i in range(60)] + [(100 + i, "too short", "poor") for i in range(50)] + [(200, own(200), "poor"), (201, "a b c " * 30, "good")]
    kept = {r.doc_id for r in judge(spark.createDataFrame(docs, "doc_id long, text string, source string")).where("kept").collect()}
    assert kept == set(range(60))


def test_packing(docs, none):
    from webfacts.llm.packing import encoder, evolve, pack

    out = pack(docs, island_rows=20).collect()
    encode = encoder("byte_bpe_50k.json")
    want = sorted(((r[0] is None, r[0] or 0), len(encode(r[1] or "")) + 1) for r in rows())
    whole, places = defaultdict(list), defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None and r.doc_id != 5:
            whole[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for own in places.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= 1024
    texts = {r[0]: r[1] for r in rows()}
    import numpy as np

    for doc, own in whole.items():
        ids = np.append(encode(texts[doc] or ""), np.uint32(2)).astype("<u4")
        at = 0
        for k, (piece, start, n, crc) in enumerate(sorted(own)):
            assert (piece, start, crc) == (k, at, zlib.crc32(ids[at : at + n].tobytes()))
            at += n
        assert at == len(ids) and len(own) == -(-len(ids) // 1024)
    assert sum(r.length for r in out) == sum(n for _, n in want)
    assert pack(none).count() == 0
    assert len(evolve([6, 5, 5, 4, 3, 3, 2, 2], 10)) == 3


def triplets(bins, capacity=1000, seed=1):
    """Lengths that fill ``bins`` bins with three pieces each, and that best fit does not pack so."""
    import random

    r, out = random.Random(seed), []
    for _ in range(bins):
        a = r.randint(380, 490)
        b = r.randint(255, (capacity - a) // 2)
        out += [a, b, capacity - a - b]
    return out


def test_evolution_beats_best_fit():
    from webfacts.llm.packing import best_fit, evolve

    lengths = triplets(20)
    plain = len(best_fit(lengths, 1000))
    bins = evolve(lengths, 1000, population=20, generations=400)
    assert sorted(i for x in bins for i in x) == list(range(60)) and all(sum(lengths[i] for i in x) <= 1000 for x in bins)
    assert 20 <= len(bins) < plain


def test_islands_exchange_elites(spark):
    """More islands and spells never pack worse than one, and every piece has its place."""
    from webfacts.llm.packing import _blocks, best_fit
    from webfacts.llm.store import Scratch

    lengths = triplets(20)
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    with Scratch(spark) as scratch:
        packed = _blocks(items, scratch, 1000, 1, 1, 4, 3, {"population": 12, "generations": 80}).collect()
    bins = defaultdict(list)
    for r in packed:
        bins[r.bin].append((r.place, r.length, r.used))
    assert sorted(r.item for r in packed) == list(range(60)) and len(bins) < len(best_fit(lengths, 1000))
    for own in bins.values():
        end = 0
        for place, n, used in sorted(own):
            assert place == end and used == sum(x[1] for x in own) <= 1000
            end += n


def test_tokenizer_files_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    from webfacts.llm.packing import encoder

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    for x in [*(r[1] or "" for r in rows()), "it's 12  a b <|endoftext|> \U0001f600", "\r\n\r\n tab\t"]:
        assert encoder("byte_bpe_50k.json")(x).tolist() == whole.encode(x, add_special_tokens=False).ids


def test_embeddings(spark):
    import numpy as np

    from webfacts.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 16))
    for i in range(40, 80):
        x[i] = x[i - 40] + rng.normal(size=16) * 0.05
    x[90:95] = x[0]
    vs = [(i, i % 40 % 3 if i < 80 else 0, [float(y) for y in v], "extra") for i, v in enumerate(x)]
    vs += [(200, 0, None, "e"), (201, None, vs[0][2], "e"), (202, 0, [0.0] * 16, "e"), (203, 0, [float("nan")] * 16, "e"), (204, 0, [None] * 16, "e"), (205, 0, [], "e"), (206, 0, [1.0, 2.0], "e")]
    df = spark.createDataFrame(vs, "vec_id long, label int, embedding array<double>, n_links string")
    links = defaultdict(set)
    for i, a, u, _ in vs[:120]:
        for j, b, v, _ in vs[:120]:
            if i != j and a == b and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                links[i].add(j)
    part = brute.union_find([v[0] for v in vs], [(i, j) for i in links for j in links[i]])
    got = {r.vec_id: r for r in near_vectors(df, block=8).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {v[0]: (len(links[v[0]]), part[v[0]], part[v[0]] == v[0]) for v in vs}
    assert near_vectors(df.limit(0)).count() == 0


def test_embeddings_recall(spark):
    """Pairs just above the bound in one hot label and a small one, against all pairs of the label."""
    import numpy as np

    from webfacts.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(5)
    x = rng.normal(size=(5000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(2000):  # at cosines of 0.931 to 0.95
        c = rng.uniform(0.931, 0.95)
        y = rng.normal(size=48)
        y -= (y @ x[i]) * x[i]
        x[2000 + i] = c * x[i] + math.sqrt(1 - c * c) * y / np.linalg.norm(y)
    labels = [0 if i % 2000 < 1900 else 1 for i in range(5000)]
    df = spark.createDataFrame([(i, labels[i], v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: r.n_links for r in near_vectors(df).collect()}
    want = np.zeros(5000, int)
    for k in (0, 1):
        own = [i for i in range(5000) if labels[i] == k]
        want[own] = (x[own] @ x[own].T >= 0.93).sum(axis=1) - 1
    assert want.sum() >= 4000 and all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.98 * want.sum()


def test_sharding(docs, none):
    from webfacts.llm.sharding import shard

    for chunk in (50_000, 5):
        out = shard(docs, chunk_rows=chunk).collect()
        none_last = lambda x: -1 if x is None else x
        assert sorted((none_last(r.doc_id), r.size) for r in out) == sorted((none_last(r[0]), len((r[1] or "").encode()) + 1) for r in rows())
        texts, loads, slots = defaultdict(set), Counter(), defaultdict(list)
        for r in out:
            texts[r.text_crc32].add(r.shard)
            loads[r.shard] += r.size
            slots[r.shard].append(r.slot)
        assert all(len(s) == 1 for s in texts.values())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        if chunk == 50_000:  # the plain schedule: by descending size to the least-loaded shard
            sizes, plain = Counter(), [0] * 8
            for r in rows():
                sizes[r[1] or ""] += len((r[1] or "").encode()) + 1
            for n in sorted(sizes.values(), reverse=True):
                plain[plain.index(min(plain))] += n
            assert sorted(loads.get(k, 0) for k in range(8)) == sorted(plain)
    assert shard(none).count() == 0


def test_language_id(docs, none, spark):
    from webfacts.llm.language_id import identify

    out = identify(docs).collect()
    assert len(out) == len(rows())
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in out)
    assert identify(none).count() == 0
    two = [(i, ("der die das und nicht mit sich " if i % 2 else "the and with that this from have ") * 5 + text(i, 3), "de" if i % 2 else "en") for i in range(60)]
    out = identify(spark.createDataFrame(two, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == r.lang for r in out if r.held_out)


def test_quality_classifier(docs, none, spark):
    from webfacts.llm.quality_classifier import classify

    labels = spark.createDataFrame([(i, int(i % 2), None) for i in range(60)] + [(None, 1, 0), (7, None, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    out = classify(docs, labels).collect()
    assert len(out) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert classify(none, labels).count() == 0 and classify(docs, labels.limit(0)).count() == len(rows())
    junk = [(i, " ".join("###$$" if i % 2 == 0 and k % 2 else w for k, w in enumerate(text(i, 40).split()))) for i in range(200)]
    out = classify(spark.createDataFrame(junk, "doc_id long, text string"), spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int"))
    held = [r for r in out.collect() if r.held_out]
    assert held and all((r.score > 0.5) == bool(r.doc_id % 2) for r in held)


def test_classifier_is_the_plain_one(spark):
    """Scores of a plain version: vectors of words and character n-grams averaged, softmax, steps over one example at a time."""
    import numpy as np

    from webfacts.llm import quality_classifier as q

    data = [(i, " ".join(["ünï", "###", "good", "bad", "a"][(i * k + k) % 5] for k in range(3 + i % 4)), i % 2) for i in range(24)]
    data = [x for x in data if zlib.crc32(str(x[0]).encode()) % 4 != 2]

    def features(x):
        out = [int(q.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]), fold=False)[0]) >> 47 for w in x.split()]
        for n in q.GRAMS:
            for i in range(len(x) - n + 1):
                h = 0
                for c in x[i : i + n]:
                    h = (h * 0x01000193 + ord(c) + n) % 2**32
                h = h * 0x9E3779B1 % 2**32
                h = (h ^ h >> 15) * 0x85EBCA77 % 2**32
                out.append(h >> 15)
        return out

    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / 8, 1 / 8, (q.BUCKETS, 8)).astype(np.float32)
    out, bias, step = rng.normal(0, 0.5, (2, 8)).astype(np.float32), np.zeros(2, np.float32), 0
    for _ in range(5):
        for r in rng.permutation(len(data)):
            seen = Counter(features(data[r][1]))
            n, now = sum(seen.values()), 0.2 * (1 - step / (5 * len(data)))
            mean = sum(vectors[k] * (m / n) for k, m in seen.items())
            z = np.exp(out @ mean + bias - (out @ mean + bias).max())
            p = z / z.sum()
            p[data[r][2]] -= 1
            back, step = p @ out, step + 1
            out = out - now * 0.1 * np.outer(p, mean)
            bias = bias - now * 0.01 * p
            for k, m in seen.items():
                vectors[k] -= now * m / max(seen.values()) * back
    df = spark.createDataFrame(data, "doc_id long, text string, quality int")
    got = q.classify(df.select("doc_id", "text"), df.select("doc_id", "quality")).collect()
    for r in got:
        x = features(r.text)
        z = out @ (sum(vectors[k] for k in x) / len(x)) + bias
        assert abs(r.score - 1 / (1 + math.exp(z[0] - z[1]))) < 1e-3


def test_mixing(docs, none, spark):
    from webfacts.llm.mixing import budgets, mix

    out = mix(docs, share=0.5)
    tokens = sum(len((r[1] or "").encode().split()) + 1 for r in rows())
    got = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns
    leaf = Counter()
    for r in got:
        leaf[r.lang, r.source, r.leaf_budget] += r.n_tokens
    assert all(n >= key[2] - 1e-6 for key, n in leaf.items())
    assert sum(key[2] for key in leaf) == pytest.approx(0.5 * tokens)
    assert mix(none).count() == 0
    again = mix(docs, share=1.0, epochs=2).collect()
    assert len(again) >= len(rows())
    # a leaf that lacks tokens is made up for by its siblings first
    tree = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 100), ("a", "y", "s3", 100), ("b", "x", "s4", 1000)], "domain string, language string, source_name string, supply long")
    got = {r.source_name: r.budget for r in budgets(tree, F.lit(160)).collect()}
    assert got == pytest.approx({"s1": 10, "s2": 30, "s3": 40, "s4": 80})
    shares = spark.createDataFrame([("domain", "b", 3.0)], "level string, name string, weight double")
    assert {r.source_name: r.budget for r in budgets(tree, F.lit(160), shares).collect()} == pytest.approx({"s1": 10, "s2": 10, "s3": 20, "s4": 120})


def test_mixing_columns_that_clash(docs, spark):
    """Input columns of the plan's own names stay; those of the result's are replaced."""
    from webfacts.llm.mixing import mix

    names = ["language", "whole", "source_name", "rest", "cut", "key", "order", "epoch", "n_tokens"]
    wide = docs.select("doc_id", "text", "lang", "source", *[F.lit(f"own {n}").alias(n) for n in names])
    out = mix(wide, share=0.5).collect()
    assert len(out) == mix(docs, share=0.5).count() and all(r.language == "own language" and r.cut == "own cut" and r.epoch == 0 for r in out)


def test_mixing_prefixes(docs):
    """Every leaf gives whole epochs and then the shortest prefix of its seeded order that reaches its budget."""
    import hashlib

    from webfacts.llm.mixing import mix

    leaves = defaultdict(list)
    for r in rows():
        name = "d" + str(int(r[3][3:]) % 4) if r[3] and r[3][:3] == "src" else r[3]
        key = hashlib.md5("|".join([*([str(r[0])] if r[0] is not None else []), r[1] or ""]).encode()).hexdigest()
        leaves[name, r[2], r[3]].append((r[0], key, len((r[1] or "").encode().split()) + 1))
    for share, epochs, per_bucket in ((0.5, 1, 10_000), (1.7, 3, 4)):
        got = defaultdict(Counter)
        budget = {}
        for r in mix(docs, share=share, epochs=epochs, per_bucket=per_bucket).collect():
            got[r.domain, r.lang, r.source][r.doc_id] += 1
            budget[r.domain, r.lang, r.source] = r.leaf_budget
        for leaf, own in leaves.items():
            want, all_of = Counter(), sum(n for *_, n in own)
            whole = math.floor(budget.get(leaf, 0) / all_of)
            left = budget.get(leaf, 0) - whole * all_of
            place = lambda x: hashlib.md5(f"7|{whole}|{x[1]}".encode()).hexdigest()[:15]  # noqa: B023, E731
            for x in own:
                want[x[0]] += whole
            last = None
            for x in sorted(own, key=place):
                if left <= 0 and place(x) != last:
                    break
                want[x[0]] += 1
                left, last = left - x[2], place(x)
            assert +want == +got[leaf], (leaf, want, got[leaf])


def test_pipeline(spark, docs, tmp_path):
    """Every stage on what the one before kept, against what its operator says or a plain version finds."""
    import corpus_pipeline as p
    from webfacts.llm.language_id import identify
    from webfacts.llm.mixing import mix, targets
    from webfacts.llm.packing import encoder
    from webfacts.llm.quality_classifier import classify

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(111, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    seen = []
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.schema.names == read.schema.names and stage(spark, read.limit(0), str(tmp_path)).count() == 0
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append((now, spark.read.parquet(f"{tmp_path}/{name}")))
        now = seen[-1][1]
    assert ids(seen[0][1]) == ids(identify(read).where("not rejected"))
    assert ids(seen[1][1]) == ids(classify(seen[1][0], spark.read.parquet(f"{tmp_path}/labels.parquet")).where("predicted = 1"))
    before = [(r.doc_id, r.text) for r in seen[2][0].collect()]
    part = brute.near_duplicates([x for x in before if x[0] is not None])
    kept = Counter(i for i, (n, c) in part.items() if i == c) + Counter(i for i, x in before if i is None)
    assert ids(seen[2][1]) == kept
    assert ids(seen[3][1]) == ids(mix(seen[3][0], share=0.8, weights=targets(spark)))
    out, encode = p.run(spark, str(tmp_path)).collect(), encoder("byte_bpe_50k.json")
    want = Counter()
    for r in now.collect():
        want[r.doc_id] += len(encode(r.text or "")) + 1
    got = Counter()
    for r in out:
        got[r.doc_id] += r.length
    assert len(p.STAGES) == 5 and out and got == want
