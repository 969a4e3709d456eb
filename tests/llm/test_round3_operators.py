"""Concatenated packing, alignment of tokenizers and repair of conversations against plain versions."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

TEXTS = [
    "a plain text of some words. ", None, "", " ", "two  blanks and\ttabs\n\nlines", "été déjà vu, schön ﬁ １２ Å", "日本語のテキスト と emoji 👩‍👩‍👧 🏳️‍🌈", "▁ lower block ▁▁", "<|endoftext|> <s> </s> <0x41> <unk>",
    "x\x00y\x7f\x85\xa0z", "q" * 5000, "ab " * 3000, "aaaaaaaaaaaaaaaaaaaaaaab", "don't we'll I'M 1234567890", " leading and trailing ", "a plain text of some words. ", "​﻿­", "…—“quotes”", "한국어 ไทย हिन्दी العربية",
]
SCHEMA = "doc_id long, text string, row string, sequence_id string, `a.b` string, Place string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, x, "r", "s", "t", "u") for i, x in enumerate(TEXTS)] + [(None, "no number", "r", "s", "t", "u"), (3, "another third", "r", "s", "t", "u"), (3, "another third", "r", "s", "t", "u")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@functools.cache
def public():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids_of(text):
    return public().encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "'s", "ab", "é", "　", "９", "ﷺ", "̃", "👍🏽", "\U0001e900"]), max_size=30).map("".join))
def test_ids_are_those_of_the_tokenizers_library(text):
    from webfacts.llm.packing import encoder

    assert encoder("byte_bpe_50k.json")(text).tolist() == ids_of(text)


def packed(out):
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.offset)
        at = 0
        for r in rows:
            assert r.offset == at and r.length > 0
            at += r.length
    return {k: sum(r.length for r in v) for k, v in by.items()}


def test_concatenation_keeps_every_id_once(docs, spark):
    from webfacts.llm.concat_cut import pack, sequences

    out = pack(docs).collect()
    want = Counter((r.doc_id, tuple([*ids_of(r.text), 0])) for r in docs.collect())
    assert Counter((r.doc_id, r.doc_tokens) for r in out if r.start == 0) == Counter((d, len(x)) for d, x in want.elements())
    of = defaultdict(list)
    for r in docs.collect():
        of[r.doc_id, len(ids_of(r.text)) + 1].append([*ids_of(r.text), 0])
    for r in out:
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in of[r.doc_id, r.doc_tokens])
    lengths, total = packed(out), sum(len(x) * n for (_, x), n in want.items())
    assert sum(lengths.values()) == total and sorted(lengths) == list(range(len(lengths)))
    short = [n for n in lengths.values() if n < 1024]
    assert sum(short) == total % 1024 and len(short) == (total % 1024).bit_count() and all(n & (n - 1) == 0 for n in short)  # nothing is padded
    whole = {r.sequence_id: r for r in sequences(docs).collect()}
    assert {k: len(r.ids) // 4 for k, r in whole.items()} == lengths
    got = Counter((r.sequence_id, s.offset, s.doc_id, s.start, s.length, zlib.crc32(r.ids[4 * s.offset : 4 * (s.offset + s.length)])) for r in whole.values() for s in r.spans)
    assert got == Counter((r.sequence_id, r.offset, r.doc_id, r.start, r.length, r.ids_crc32) for r in out)
    assert pack(docs.limit(0)).count() == sequences(docs.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [1, 7, 16, 1000])
def test_windows_of_any_width(docs, capacity):
    from webfacts.llm.concat_cut import pack

    lengths = packed(pack(docs.where("length(text) < 100"), capacity=capacity).collect())
    assert max(lengths.values()) <= capacity and sum(n % capacity > 0 for n in lengths.values()) <= capacity.bit_length()


def test_prefix_sums_over_many_partitions(spark, monkeypatch):
    from webfacts.llm import concat_cut

    monkeypatch.setattr(concat_cut, "FAN", 3)
    rows = spark.range(40).selectExpr("id * 2 as part", "(id * 7) % 11 as doc_tokens")
    got = {r.part: r.base for r in concat_cut.offsets(rows).collect()}
    at = 0
    for i in range(40):
        assert got[2 * i] == at
        at += (i * 7) % 11


def plain_alignment(rows):
    import public_tokenizers as p
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    vocab = {i: x for x, i in public().get_vocab().items()}
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate([b for b in range(256) if b not in shown])}
    docs, count = [], Counter()
    for doc, text in rows:
        a = [(i, bytes(byte[c] for c in vocab[i])) for i in ids_of(" " + (text or ""))]
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if re.fullmatch("<0x..>", sp.id_to_piece(i)) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text or "")]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            docs.append((doc, [], [], []))
            continue
        spans = []
        for toks in (a, b):
            at, out = 0, []
            for i, x in toks:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        count.update(set(links))
        docs.append((doc, *spans, links))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for doc, a, b, links in docs:
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, s = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, x, y in side if s < y <= e) for side in (a, b)))
            s = e
        out.append((doc, len(a), len(b), len(ends), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("  ab,é\n\t\x1c\u3000\u2028▁'s1🏳"), max_size=40) | st.text(max_size=40))
def test_tokens_of_chunks_are_those_of_the_text(text):
    from webfacts.llm.token_alignment import _Memo, chunks, second_tokenizer

    parts = chunks(text)
    assert " ".join(parts) == text
    if text:
        memo = _Memo("byte_bpe_50k.json", "piece_bpe_32k.model")
        number, count = memo.numbers(["warm up", text])
        assert list(count) == [2, len(parts)] and memo.a.take(number[2:])[0].tolist() == ids_of(" " + text)
        whole = second_tokenizer("piece_bpe_32k.model")[0].encode(text)
        assert memo.b.take(number[2:])[0].tolist() == whole or not all(memo.ok[i] for i in number[2:])


@pytest.mark.parametrize("hot", [0, 3, 50_000])
def test_alignment(docs, hot):
    from webfacts.llm.token_alignment import align

    small = docs.where("text is null or length(text) < 400")
    want = plain_alignment([(r.doc_id, r.text) for r in small.collect()])
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in align(small, hot=hot).collect()]
    assert Counter(got) == Counter(want)
    assert sum(x[1] > 0 for x in want) > 8
    if not hot:
        assert align(docs.limit(0)).count() == 0


def test_alignment_of_long_texts(spark):
    from webfacts.llm.token_alignment import align

    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("abcdeénts") for _ in range(rng.randint(1, 12))) for _ in range(400))) for i in range(4)]
    got = align(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == sorted(plain_alignment(rows))


def test_new_chunks_are_encoded_and_aligned_together():
    """One call for all new chunks of a block but those at a text's ends that have white space there; changed texts have no links."""
    from webfacts.llm.token_alignment import _Memo

    memo, calls = _Memo("byte_bpe_50k.json", "piece_bpe_32k.model"), []
    own = memo.encode
    memo.encode = lambda x: calls.append(x) or own(x)
    texts = [" ".join(f"w{i}ord naïve  gap" for i in range(300)), "end of line\n", "\u2581 é", "", "w7ord naïve"]
    number, count = memo.numbers(texts)
    assert len(calls) == 2 and calls[1] == " line\n" and list(count) == [600, 3, 2, 0, 2]
    ends = np.cumsum(count)
    for text, part in zip(texts, np.split(number, ends[:-1])):
        if text and all(memo.ok[i] for i in part):
            [(_, n_a, n_b, n_groups, n_links, *_, sha)] = plain_alignment([(0, text)])
            got = [len(memo.a.take(part)[0]), len(memo.b.take(part)[0]), sum(memo.groups[i] for i in part), len(memo.links.take(part)[0])]
            assert got == [n_a, n_b, n_groups, n_links] and hashlib.sha256(b";".join(memo.said[i] for i in part)).hexdigest() == sha
        elif text:
            assert text[0] == "\u2581" and any(not memo.links.sizes(part[k : k + 1])[0] for k in range(len(part)))
    memo.numbers(texts)
    assert len(calls) == 2

def plain_repair(turns):
    """(cost, audit, repaired) of (role, text, fault) turns: all edits, by exhaustive search with memory."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def best(i, state, inserts):
        options = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
        if inserts < 4:
            for role in ("user", "assistant"):
                if (state, role[0]) in after:
                    c, a, r = best(i, after[state, role[0]], inserts + 1)
                    options.append((c + 2, "I" + a, ((role, ""), *r)))
        if i < len(turns):
            role, text, fault = turns[i]
            c, a, r = best(i + 1, state, 0)
            options.append((c + 3, "D" + a, r))
            if fault in (None, "truncated"):
                for new, cost, letter in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                    if (state, new[:1]) in after:
                        c, a, r = best(i + 1, after[state, new[:1]], 0)
                        options.append((c + cost + (fault == "truncated"), letter + a, ((new, text), *r)))
        return min(options, default=(10**9, "~", ()))

    for i in reversed(range(len(turns))):  # so that no search goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def plain_conversations(rows, damage=True):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        by[conv]
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 19
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            by[conv] += [(turn, "user" if hit == 4 else role, text)] * (1 + (hit == 3))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).digest()))
        seen, turns, known = set(), [], [t for t, _, _ in own if t is not None]
        for _, role, text in own:
            rest = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else None if rest[-1] in ".!?" else "truncated"
            seen.add((role, text))
            turns.append((role, text, fault))
        count = Counter(f for _, _, f in turns)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
        cost, audit, repaired = plain_repair(turns)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest())
    return out


def conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turns = rng.sample(range(30), rng.randint(1, 14)) if c % 9 else [rng.randint(0, 3) for _ in range(6)]
        for t in turns:
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "User"])
            rows.append((c if c else None, t if rng.random() < 0.95 else None, role, rng.choice(["One.", "two", "Three!", "", None, " \n", f"text {rng.random()}?  ", "été.\x0b", "x\x00"])))
    return rows


@pytest.mark.parametrize("damage", [True, False])
def test_repair(spark, damage):
    from webfacts.llm.conversation_repair import repair

    rows = conversations(5) + [(1000, t, "user", "Hi.") for t in range(1)] + conversations(5)[:3]
    rows += [(c, 1, "user", "Gone.") for c in range(2000, 2060)]  # some lose their only turn
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, code string, audit string").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in repair(df, damage=damage).collect()}
    want = plain_conversations(rows, damage)
    assert got == want
    if damage:
        assert any(x[6] == "" for x in want.values())
        assert repair(df.limit(0), damage=True).count() == 0


def test_repair_in_many_batches(spark):
    """A conversation over many Arrow batches, beside short ones."""
    from webfacts.llm.conversation_repair import repair

    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"{rng.random()}" + rng.choice([".", ""])) for t in range(300)] + [(c, t, "user", f"{t}.") for c in range(20, 60) for t in range(3)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.conv_id: tuple(r)[1:] for r in repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), damage=True).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain_conversations(rows)


def plain_spans(found):
    """Of (template, start, end, matched, coverage): those that stay, best first."""
    kept = []
    for x in sorted(found, key=lambda x: (-x[3], -x[4], x[0], x[1], x[2])):
        if not any(y[0] != x[0] and y[1] < x[2] and x[1] < y[2] for y in kept):
            kept.append(x)
    return kept


def test_license_spans_are_settled_best_first(spark):
    """A span that is dropped drops no other one."""
    from webfacts.llm.license_scan import scan

    w = [f"w{chr(97 + i)}" for i in range(26)]
    texts = {"aa": " ".join(w[0:10]), "bb": " ".join(w[6:15]), "cc": " ".join(w[12:20])}
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[6:20])), (3, " ".join(w[12:]))], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in scan(df, texts).collect()}
    assert got == {1: "aa,cc", 2: "bb", 3: "cc"}


def test_license_spans_of_many_templates(spark):
    from webfacts.llm.license_scan import scan

    rng = random.Random(2)
    w = [f"x{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(26)]
    texts = {f"t{k:02d}": " ".join(w[a : a + n]) for k in range(30) for a, n in [(rng.randint(0, 140), rng.randint(4, 16))]}
    got = {(x.template, x.start_word, x.end_word, x.matched) for r in scan(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string"), texts).collect() for x in r.spans}
    runs = []
    for name, t in texts.items():
        own = t.split()
        for end in range(len(own), 2, -1):  # at the text's end a template may be cut
            at = next((i for i in range(len(w)) if w[i : i + end] == own[:end]), None)
            if at is not None:
                if end / len(own) >= 0.7:
                    runs.append((name, at, at + end, end, end / len(own)))
                break
    assert got == {x[:4] for x in plain_spans(runs)} and 3 < len(got) < 30
