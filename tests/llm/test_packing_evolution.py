"""The registered settings of packing against an exact packer, planted corpora and edges of lengths."""

import random
from collections import Counter, defaultdict

import pytest


def exact(length, capacity):
    """The least number of bins, by trying every bin for every piece, longest first."""
    length = sorted(length, reverse=True)
    best = [len(length)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(length):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + length[i] <= capacity and bins[k] not in bins[:k]:
                place(i + 1, [*bins[:k], bins[k] + length[i], *bins[k + 1 :]])
        place(i + 1, [*bins, length[i]])

    place(0, [])
    return best[0]


def test_exact_packer_agrees():
    from webfacts.llm.packing import evolve, least_bins

    rng, off = random.Random(3), 0
    for turn in range(400):
        top = rng.choice([100, 60, 45])
        length = [rng.randint(1, top) for _ in range(rng.randint(0, 11))]
        want, bins = exact(length, 100), evolve(length, 100, seed=turn)
        assert sorted(i for x in bins for i in x) == list(range(len(length))) and all(sum(length[i] for i in x) <= 100 for x in bins)
        assert least_bins(length, 100) <= want <= len(bins)
        off += len(bins) - want
    assert off == 0


def triplets(bins, rng, capacity=1024):
    out = []
    for _ in range(bins):
        a = rng.randint(390, 500)
        b = rng.randint(260, (capacity - a) // 2)
        out += [a, b, capacity - a - b]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("bins,share", [(20, 0.7), (300, 0.6)])
def test_registered_settings_win_bins(bins, share):
    """Of the bins that best fit takes above the least number, the default evolution wins most."""
    from webfacts.llm.packing import best_fit, evolve

    length = triplets(bins, random.Random(8))
    plain = len(best_fit(length, 1024)) - bins
    assert plain > 0 and len(evolve(length, 1024)) - bins <= (1 - share) * plain


def test_blocks_leave_no_light_bins(spark, monkeypatch):
    """However many blocks there are, one bin at most is filled to half or less, and no piece is lost."""
    from webfacts.llm import packing

    rng = random.Random(2)
    want = [rng.choice([3, 40, 150, 333, 600]) for _ in range(3000)]
    rows = [(i, i, 0, n, 0) for i, n in enumerate(want)]
    table = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    monkeypatch.setattr(packing, "pieces", lambda *a, **k: table)
    out = packing.pack(spark.createDataFrame([], "doc_id long, text string"), capacity=1024, island_rows=150, rounds=1).collect()
    used, places = Counter(), defaultdict(list)
    for r in out:
        used[r.sequence_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert sorted(r.length for r in out) == sorted(want)
    assert max(used.values()) <= 1024 and sum(2 * n <= 1024 for n in used.values()) <= 1
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]


def test_lengths_at_the_edge(spark):
    """Documents of 1023, 1024, 1025 and 2048 ids with their end, and equal ones."""
    from webfacts.llm.packing import encoder, pack

    encode, texts = encoder("byte_bpe_50k.json"), {}
    word = " the"
    assert len(encode(word * 50)) == 50
    for i, ids in enumerate([1022, 1023, 1023, 1024, 2047, 2048, 0]):
        texts[i] = word * ids
    out = pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    got = defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.piece, r.start, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {
        0: [(0, 0, 1023)], 1: [(0, 0, 1024)], 2: [(0, 0, 1024)], 3: [(0, 0, 1), (1, 1, 1024)],
        4: [(0, 0, 1024), (1, 1024, 1024)], 5: [(0, 0, 1), (1, 1, 1024), (2, 1025, 1024)], 6: [(0, 0, 1)]}
    assert len({r.sequence_id for r in out}) == 9  # seven whole pieces, 1023 + 1, 1 + 1
