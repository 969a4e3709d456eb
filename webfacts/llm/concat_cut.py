"""Packing by concatenation: all documents in one stream of ids, cut into fixed windows.

The first pass encodes each document once and writes its ids with the tokens that
stand before it in its partition. Prefix sums over the partitions' totals give each
partition's place in the stream, so the second pass cuts every document on its own,
without a sort or a shuffle of ids. Only windows that reach over partitions' edges
are boundary records, which ``sequences`` brings together by their number.

What is left after the last whole window is cut at powers of two, the largest first,
so that no sequence needs any padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import encoder
from .store import Scratch
from .text import texts_of

#: Partitions whose totals are summed in one task of the prefix sums.
FAN = 1024
#: Bytes of ids that a task gathers before it passes them on.
BYTES = 8 << 20


def encoded(docs: DataFrame, *, vocabulary: str, end: int) -> DataFrame:
    """(part, before, doc_id, doc_tokens, ids) of (doc_id, text): ids are little-endian 32-bit numbers, ``before`` counts those before the row in its partition."""

    def run(batches):
        encode, part, before = encoder(vocabulary), TaskContext.get().partitionId(), 0
        rows, held = [], 0

        def out():
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 5, kinds)], ["part", "before", "doc_id", "doc_tokens", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids = np.append(encode(str(text, "utf-8")), np.uint32(end)).astype("<u4")
                rows.append((part, before, doc, len(ids), ids.tobytes()))
                before, held = before + len(ids), held + ids.nbytes
                if held > BYTES:
                    yield out()
                    rows, held = [], 0
        yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "part long, before long, doc_id long, doc_tokens long, ids binary")


def offsets(rows: DataFrame) -> DataFrame:
    """(part, base): ids before each partition, by sums over runs of FAN partitions and then within each."""
    totals = rows.groupBy("part").agg(F.sum("doc_tokens").alias("n")).withColumn("run", F.floor(F.col("part") / FAN))
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    runs = totals.groupBy("run").agg(F.sum("n").alias("n")).select("run", F.coalesce(F.sum("n").over(upto.orderBy("run")), F.lit(0)).alias("far"))
    near = totals.withColumn("near", F.coalesce(F.sum("n").over(upto.partitionBy("run").orderBy("part")), F.lit(0)))
    return near.join(runs, "run").select("part", (F.col("far") + F.col("near")).alias("base"))


class Layout:
    """Where sequences begin in a stream of ``total`` ids."""

    def __init__(self, total: int, capacity: int):
        self.capacity, self.full = capacity, total // capacity
        rest, at, starts = total % capacity, self.full * capacity, []
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                starts.append(at)
                at += 1 << bit
        self.tail = np.array([*starts, total], dtype=np.int64)

    def number(self, place: np.ndarray) -> np.ndarray:
        """The sequence that holds each place."""
        return np.where(place < self.full * self.capacity, place // self.capacity, self.full - 1 + np.searchsorted(self.tail, place, side="right"))

    def start(self, number: np.ndarray) -> np.ndarray:
        """The first place of each sequence; of the number after the last one, the end."""
        return np.where(number < self.full, number * self.capacity, self.tail[np.clip(number - self.full, 0, len(self.tail) - 1)])

    def cut(self, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start in the row, length, sequence, offset there) of all pieces of rows that begin at ``place``; rows aren't empty."""
        first, last = self.number(place), self.number(place + length - 1)
        count = last - first + 1
        row = np.repeat(np.arange(len(place)), count)
        number = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        begin, stop = np.maximum(self.start(number), place[row]), np.minimum(self.start(number + 1), place[row] + length[row])
        return row, begin - place[row], stop - begin, number, begin - self.start(number)


def _placed(docs: DataFrame, scratch: Scratch, vocabulary: str, end: int) -> tuple[DataFrame, int]:
    """Encoded documents with their place in the stream, and the stream's length."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.cut(encoded(docs, vocabulary=vocabulary, end=end))
    base = scratch.cut(offsets(rows))
    total = rows.agg(F.sum("doc_tokens")).first()[0] or 0
    return rows.join(base, "part").withColumn("place", F.col("base") + F.col("before")), total


def pack(docs: DataFrame, *, vocabulary: str = "byte_bpe_50k.json", end: int = 0, capacity: int = 1024) -> DataFrame:
    """One row per piece of (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end``; a null or empty text is ``end`` alone.
    Documents follow each other in the order in which the table is read. Repeated
    rows and rows of one or of no doc_id are documents each; further columns are
    ignored; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            place, length = (batch.column(c).to_numpy() for c in ("place", "doc_tokens"))
            row, start, size, number, offset = Layout(total, capacity).cut(place, length)
            ids = [memoryview(x.as_buffer()) for x in batch.column("ids")]
            sums = [zlib.crc32(ids[r][4 * a : 4 * (a + n)]) for r, a, n in zip(row.tolist(), start.tolist(), size.tolist())]
            doc = batch.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([doc, *(pa.array(x, pa.int64()) for x in (start, size, sums, length[row], number, offset))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    with Scratch(docs.sparkSession) as scratch:
        rows, total = _placed(docs, scratch, vocabulary, end)
        return scratch.keep(rows.select("place", "doc_id", "doc_tokens", "ids").mapInArrow(run, schema))


def sequences(docs: DataFrame, *, vocabulary: str = "byte_bpe_50k.json", end: int = 0, capacity: int = 1024) -> DataFrame:
    """(sequence_id, ids, spans) of the same packing: whole sequences of ids, and each piece's struct (offset, doc_id, start, length) in order.

    Sequences that a task holds whole are passed on as they are; parts of the
    others, some for each batch of documents, are boundary records, and only
    these are shuffled.
    """
    span = pa.struct([("offset", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])

    def run(batches):
        layout = Layout(total, capacity)
        for batch in batches:
            place, length = (batch.column(c).to_numpy() for c in ("place", "doc_tokens"))
            row, start, size, number, offset = layout.cut(place, length)
            ids, docs_ = [memoryview(x.as_buffer()) for x in batch.column("ids")], batch.column("doc_id").to_pylist()
            order = np.lexsort((offset, number))
            out = []
            for k in np.split(order, np.flatnonzero(np.diff(number[order])) + 1) if len(order) else []:
                spans = [{"offset": int(offset[i]), "doc_id": docs_[row[i]], "start": int(start[i]), "length": int(size[i])} for i in k]
                n = int(number[k[0]])
                whole = int(size[k].sum()) == int(layout.start(np.array([n + 1]))[0] - layout.start(np.array([n]))[0])
                out.append((n, whole, b"".join(ids[row[i]][4 * start[i] : 4 * (start[i] + size[i])] for i in k) if whole else None, [bytes(ids[row[i]][4 * start[i] : 4 * (start[i] + size[i])]) for i in k], spans))
            kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.binary()), pa.list_(span))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 5, kinds)], ["sequence_id", "whole", "ids", "parts", "spans"])

    schema = "sequence_id long, whole boolean, ids binary, parts array<binary>, spans array<struct<offset long, doc_id long, start long, length long>>"
    with Scratch(docs.sparkSession) as scratch:
        rows, total = _placed(docs, scratch, vocabulary, end)
        found = scratch.cut(rows.select("place", "doc_id", "doc_tokens", "ids").mapInArrow(run, schema))
        # at most ``capacity`` pieces make a sequence, so what a group gathers is bounded
        pieces = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("spans", "parts"))))
        joined = found.where("not whole").groupBy("sequence_id").agg(pieces.alias("x"))
        joined = joined.select("sequence_id", F.aggregate("x.parts", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"), F.col("x.spans").alias("spans"))
        return scratch.keep(found.where("whole").select("sequence_id", "ids", "spans").unionByName(joined))
