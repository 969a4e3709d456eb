"""Whole groups to numpy, many at a time: rows are dealt by key, sorted, and streamed in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import gathered

def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroups sorted batches so that no key is split; holds one group over at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and held[0].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def map_groups(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.RecordBatch], schema: str, rows: int | None = None, per_task: int = 5_000, parts: int | None = None) -> DataFrame:
    """Applies ``fn`` to tables of whole groups of the bigint ``key``; the caller keeps groups small (see ``in_blocks``).

    ``rows``, a bound of the number of rows, spares a small table tasks of less than ``per_task``. ``parts`` is a number of
    partitions that stays as it is, for groups that take long but are few bytes.
    """

    def run(batches):
        for table in whole_groups(batches, key):
            yield fn(table)

    dealt = df.repartition(parts, F.col(key)) if parts else gathered(df.repartition(F.col(key)), rows, per_task)
    return dealt.sortWithinPartitions(key).mapInArrow(run, schema)


def in_blocks(df: DataFrame, node: str, size: str, row: str, most: int) -> DataFrame:
    """Deals each node's rows to blocks of about ``most``, and each pair of blocks to a group of its own.

    A node of up to ``most`` rows is one group. A larger one of g blocks gets
    g (g + 1) / 2 groups of two blocks at most, so every pair of its rows meets
    once and no task holds more than some 2 * most rows of it. Adds ``group``
    (bigint), ``block`` (int) and ``within`` (the group is one block alone).
    """
    g = F.greatest(F.lit(1), F.ceil(F.col(size) / most)).cast("int")
    out = df.withColumn("_g", g).withColumn("block", F.pmod(F.xxhash64(F.lit(77), row), F.col("_g")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return out.select(
        *df.columns, "block", (F.col("block") == F.col("_other")).alias("within"),
        F.when(F.col("_g") == 1, F.col(node)).otherwise(F.xxhash64(node, F.least("block", "_other"), F.greatest("block", "_other"))).alias("group"),
    )


def pairs_within(keys: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (left < right) of all pairs of rows with one key, for sorted keys, some ``most`` pairs at a time."""
    n = len(keys)
    if n < 2:
        return
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    count = ends - np.arange(n) - 1
    total = np.cumsum(count)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most)))
        own = count[a:b]
        left = np.repeat(np.arange(a, b), own)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
        a = b
