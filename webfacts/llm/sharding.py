"""Longest-processing-time scheduling of groups that must stay together.

Groups go, by descending size, to the least-loaded of the shards through a heap.
Groups of one size are alike to that schedule, so it runs over the histogram of
sizes: how many groups of a size each shard takes is worked out at once, as if
they had come one by one, and the groups of a size are then dealt by their place
among them. A histogram of d sizes stands for d * d / 2 bytes or more, so it fits
one task at any scale. Only group sizes travel, never texts.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import map_groups
from .store import Scratch


def deal(heap: list[tuple[int, int]], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one size each shard takes; ``heap`` holds (load, shard) and is brought up to date.

    The lowest shards are first raised to just below the next one's turn, as
    many of them as the groups suffice for; from there they take turns, so whole
    rounds are given at once and the heap deals what is left.
    """
    taken, heads = [0] * len(heap), sorted(heap)
    raised = [0]
    for at, (level, k) in enumerate(heads[1:], 1):  # turns before (level, k) of the shards below it
        turns = [(level - load) // size + 1 if own < k else -(-(level - load) // size) for load, own in heads[:at]]
        if sum(turns) > count:
            break
        raised = [*turns, 0]
    active, rest = len(raised), count - sum(raised)
    rounds, rest = divmod(rest, active)
    low = []
    for (load, k), n in zip(heads, raised):
        taken[k] = n + rounds
        low.append((load + taken[k] * size, k))
    heapq.heapify(low)
    for _ in range(rest):
        load, k = low[0]
        taken[k] += 1
        heapq.heapreplace(low, (load + size, k))
    heap[:] = low + heads[active:]
    return taken


def schedule(groups: DataFrame, scratch: Scratch, shards: int = 8, chunk_rows: int = 20_000) -> DataFrame:
    """(item, shard) of (item, size), item being a distinct bigint and size positive.

    Which groups of one size a shard takes goes by a hash of ``item``; how many
    is the plain schedule's number, ties between shards going to the lower one.
    """

    def run(table: pa.Table) -> pa.RecordBatch:
        size, n = table.column("size").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(-size)
        heap, out = [(0, k) for k in range(shards)], np.zeros((len(size), shards), dtype=np.int64)
        for i, (s, c) in enumerate(zip(size[order].tolist(), n[order].tolist())):
            out[i] = deal(heap, s, c)
        ends = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * shards), pa.array(np.cumsum(out, axis=1).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(size[order]), ends], ["size", "ends"])

    sizes = groups.groupBy("size").agg(F.count("*").alias("n")).withColumn("one", F.lit(0).cast("long"))
    ends = scratch.cut(map_groups(sizes, "one", run, "size long, ends array<long>", parts=1))
    placed = numbered(groups, "size", [F.col("item")], chunk_rows, ends)
    return placed.select("item", F.size(F.filter("ends", lambda x: x <= F.col("slot"))).alias("shard"))


def numbered(rows: DataFrame, by: str, order: list[Column], per_bucket: int = 20_000, more: DataFrame | None = None) -> DataFrame:
    """Adds ``slot``, 0 to n - 1 among the rows of one ``by``, without gathering them in one task.

    Rows are dealt to buckets by a hash of ``order``, which tells rows apart; a
    bucket's slots follow those of the buckets before it. ``more``, a table of
    one row per ``by``, is joined to the buckets, so that no ``by`` is a hot key.
    """
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(max(1, -(-rows.count() // per_bucket)))))
    sizes = rows.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(by, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    if more is not None:
        sizes = sizes.join(more, by)
    own = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order)) - 1
    return rows.withColumn("_own", own).join(sizes, [by, "_bucket"]).withColumn("slot", (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_bucket")


def shard(docs: DataFrame, *, shards: int = 8, chunk_rows: int = 20_000) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1, so 1 for null and empty texts, which
    are one group. Rows of equal text share a shard; within one, a row's slot
    is its place. The law is ``bytes``: shards' sizes are near equal, as near as
    the largest group admits. Repeated rows are rows of their own; an empty
    table gives an empty result. ``chunk_rows`` is how many rows a task numbers,
    and how many equal texts make a hot group; it changes no shard's load.
    """
    with Scratch(docs.sparkSession) as scratch:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        rows = scratch.cut(docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("item"),
            F.monotonically_increasing_id().alias("row")))
        # texts that share the digest's 60 bits are one item, and so stay together too
        items = scratch.cut(rows.groupBy("item").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
        placed = scratch.cut(schedule(items.select("item", "size"), scratch, shards, chunk_rows))
        most = max(chunk_rows, scratch.rows(rows) // 100_000)
        hot = F.broadcast(items.where(F.col("n") > most).join(placed, "item").select("item", "shard"))  # 100,000 rows at most
        rows = rows.join(hot, "item").unionByName(rows.join(hot, "item", "left_anti").join(placed, "item"))
        rows = scratch.cut(rows.select("doc_id", "size", "text_crc32", "shard", "row"))
        rows = numbered(rows, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("row")], chunk_rows)
        return scratch.keep(rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))
