"""A quality classifier of supervised subword embeddings.

Words and character n-grams are hashed to learned vectors, averaged over a document
and put through a softmax; numpy stochastic gradient descent learns vectors and
output layer from a bounded sample of labelled documents. As the output is
linear in the average, scoring needs one number a bucket: the vector's
difference between the two classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .language_id import fold
from .store import Scratch
from .text import blocks, kept, span_hashes, texts_of, words_of

BUCKETS = 1 << 17
GRAMS = (3, 4)


def _buckets(texts: list):
    """Yields (bucket of each feature, first feature of each text and one more entry): words as they stand, then character n-grams."""
    w = words_of(texts)
    h = span_hashes(w.buf, w.starts, w.ends, fold=False)
    yield (h >> np.uint64(47)).astype(np.int64), w.first
    parts = [str(x, "utf-8", "replace") for x in texts]
    chars = np.frombuffer(" ".join([*parts, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in parts])]).astype(np.int64)
    for n in GRAMS:
        x = np.zeros(max(0, len(chars) - n + 1), dtype=np.uint32)
        for k in range(n):
            x = x * np.uint32(0x01000193) + chars[k : len(chars) - n + 1 + k] + np.uint32(n)
        x *= np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA77)
        lens = np.maximum(np.diff(first) - n, 0)  # grams that end within the text
        at = np.concatenate([[0], np.cumsum(lens)])
        own = np.repeat(first[:-1], lens) + np.arange(at[-1]) - np.repeat(at[:-1], lens)
        yield (x[own] >> np.uint32(15)).astype(np.int64), at


def _sgd(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """The bucket weights (class 1 over class 0) and bias of rows (buckets, shares, label)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.5, (2, dim)).astype(np.float32), np.zeros(2, dtype=np.float32)
    step, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, share, label = rows[r]
            now = rate * (1 - step / steps)
            step += 1
            mean = share @ vectors[at]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= now * 0.1 * np.outer(p, mean)
            bias -= now * 0.01 * p
            # a document's step on its vectors is that of its features' mean, scaled so that long texts teach as much as short ones
            vectors[at] -= now * (share / share.max())[:, None] * back
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, *, sample_docs: int = 3000, sample_features: int = 20_000_000, folds: int = 4, held_out: int = 2, dim: int = 8, epochs: int = 5, rate: float = 0.2, seed: int = 11) -> tuple[np.ndarray, float] | None:
    """Bucket weights and bias from at most ``sample_docs`` labelled documents outside the held-out fold, taken by a hash of doc_id.

    Of a doc_id with several labels the smallest counts, and of several texts the
    one of the least hash. What comes to the driver are a document's different
    buckets and their shares, 8 bytes each and ``sample_features`` of them at most:
    documents beyond that, by the same hash, are not learned from. None without labels.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    marks = marks.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "quality")).alias("x"))
    sample = sample.select("doc_id", "x.quality", "x.text")

    def run(batches):
        for batch in batches:
            for i, text in enumerate(texts_of(batch.column(2))):
                parts = [x for x, _ in _buckets([text])]
                at, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([len(at)], pa.int64()),
                    pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([(n / max(1, n.sum())).astype(np.float32).tobytes()], pa.binary())],
                    ["doc_id", "quality", "n", "at", "share"])

    with Scratch(docs.sparkSession) as scratch:
        found = scratch.cut(sample.mapInArrow(run, "doc_id long, quality int, n long, at binary, share binary"), sample_docs).withColumn("place", F.xxhash64("doc_id"))
        last = total = 0
        for r in found.select("place", "n").orderBy("place", "doc_id").collect():  # sample_docs numbers
            if total and total + r.n > sample_features:
                found = found.where(F.col("place") <= last)
                break
            last, total = r.place, total + r.n
        table = found.where("n > 0").select("doc_id", "quality", "at", "share").toArrow()
    cells = zip(*(table.column(c) for c in ("doc_id", "quality", "at", "share")))  # views of the table, no copies
    rows = sorted(((d.as_py(), np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(w.as_buffer(), np.float32), int(q.as_py() == 1)) for d, q, a, w in cells), key=lambda r: (r[0], r[3], len(r[1])))
    if not rows:
        return None
    return _sgd([r[1:] for r in rows], dim, epochs, rate, seed)


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_out: int = 2, least: float = 0.7, **options) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) with held_out, score, predicted.

    ``score`` is the softmax's share of label 1, from the bias alone for null
    and empty texts, 0.5 if nothing is labelled; ``predicted`` is 1 from
    ``least`` on. Texts of any length are scored whole. Repeated rows come back each; input columns of the same names
    as the new ones, in any case, are replaced; an empty table stays empty.
    """
    model = train(docs, labels, folds=folds, held_out=held_out, **options)
    weights, bias = model if model is not None else (np.zeros(BUCKETS, dtype=np.float32), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # BUCKETS numbers
    rows = docs.select(*kept(docs, "held_out", "score", "predicted"), (fold(F.col("doc_id"), folds) == held_out).alias("held_out"))
    text_at, given = rows.columns.index("text"), rows.schema
    rows = rows.toDF(*map(str, range(len(given))))  # names that need no quoting, for the Arrow stage

    def run(batches):
        weights = shared.value
        for batch in batches:
            texts = texts_of(batch.column(text_at))
            for a, b in blocks(texts):
                total, n = np.zeros(b - a), np.zeros(b - a)
                for at, first in _buckets(texts[a:b]):
                    sums = np.concatenate([[0], np.cumsum(weights[at], dtype=np.float64)])
                    total += sums[first[1:]] - sums[first[:-1]]
                    n += np.diff(first)
                score = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -50, 50)))
                new = [pa.array(score), pa.array((score >= least).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *new], [*given.names, "score", "predicted"])

    return rows.mapInArrow(run, StructType([*given.fields, *StructType.fromDDL("score double, predicted int").fields]))
