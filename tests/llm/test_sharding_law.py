"""One law of shards for all sizes: loads of the plain schedule, by the histogram of sizes."""

import heapq
import random
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st


def plain(sizes, shards, heap=None):
    """Each group by itself, by descending size, to the least-loaded shard."""
    heap = list(heap or [(0, k) for k in range(shards)])
    heapq.heapify(heap)
    for s in sorted(sizes, reverse=True):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + s, k))
    return sorted(heap)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=9), st.integers(1, 25), st.integers(0, 90))
def test_groups_of_one_size(loads, size, count):
    """Any loads, so also ones that are far apart or tie."""
    from webfacts.llm.sharding import deal

    heap = [(load, k) for k, load in enumerate(loads)]
    before = dict((k, load) for load, k in heap)
    taken = deal(heap, size, count)
    assert sum(taken) == count and sorted(heap) == sorted((before[k] + n * size, k) for k, n in enumerate(taken))
    assert sorted(heap) == plain([size] * count, len(loads), [(load, k) for k, load in enumerate(loads)])


def test_very_many_groups_of_a_size():
    """A billion groups of one size beside a giant cost no more than ten."""
    from webfacts.llm.sharding import deal

    heap, start = [(0, k) for k in range(8)], time.monotonic()
    deal(heap, 10**12, 1)  # the giant
    taken = deal(heap, 7, 10**9)
    assert taken[0] == 0 and max(taken[1:]) - min(taken[1:]) <= 1 and sum(taken) == 10**9
    taken = deal(heap, 1, 2 * 10**13)
    assert sum(taken) == 2 * 10**13 and max(heap)[0] - min(heap)[0] <= 1 and time.monotonic() - start < 5


@pytest.mark.parametrize("hot", [False, True])
def test_loads_of_200000_groups(spark, hot):
    """Loads equal the plain schedule's, every group has one shard, and one size may hold most groups."""
    from webfacts.llm.sharding import schedule
    from webfacts.llm.store import Scratch

    rng = random.Random(int(hot))
    sizes = [100 if hot and i % 3 else min(10**6, int(rng.paretovariate(1.1) * 20)) for i in range(200_000)]
    import pandas as pd

    groups = spark.createDataFrame(pd.DataFrame({"item": range(200_000), "size": sizes}), "item long, size long")
    with Scratch(spark) as scratch:
        got = schedule(groups, scratch, 8, 1_000).toPandas()
    assert sorted(got["item"]) == list(range(200_000))
    loads = Counter()
    for item, k in zip(got["item"], got["shard"]):
        loads[k] += sizes[item]
    assert sorted((n, k) for k, n in loads.items()) == plain(sizes, 8)


def test_repeated_rows_and_hot_texts(spark):
    """Thousands of equal rows and of equal texts: one shard, slots without gaps, loads of the plain schedule."""
    from webfacts.llm.sharding import shard

    rows = [(7, "same row")] * 3000 + [(i, "same text") for i in range(3000)] + [(10_000 + i, f"text {i}" * (i % 9)) for i in range(500)] + [(None, None)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = Counter()
    for _, text in rows:
        sizes[text or ""] += len(text or "") + 1
    for chunk in (20_000, 100):  # without hot texts by the parameter, and with them
        out = shard(docs, chunk_rows=chunk).collect()
        assert Counter((r.doc_id, r.size) for r in out) == Counter((d, len(t or "") + 1) for d, t in rows)
        loads, slots, homes = Counter(), {}, {}
        for r in out:
            loads[r.shard] += r.size
            slots.setdefault(r.shard, []).append(r.slot)
            homes.setdefault(r.text_crc32, set()).add(r.shard)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
        assert sorted((n, k) for k, n in loads.items()) == [x for x in plain(sizes.values(), 8) if x[0]]
