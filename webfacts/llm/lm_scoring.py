"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each in the context of up to three bytes
before it and the bits so far. Every context node has a Krichevsky-Trofimov
estimate from the counts of all training documents, and context-tree weighting
mixes the depths: a node's weight against its longer contexts is the share of
its own block probability in the weighted one. Since the counts are fixed once
learned, each context becomes one row of 256 byte probabilities.

The tree is whole: every context that training documents hold has its row, so it
grows with the corpus. It is worked out in groups of the contexts that share
their last two bytes. The rows of the most frequent contexts go to all tasks and
score in place; what other contexts score is counted per document and joined.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import map_groups
from .language_id import fold
from .store import Scratch
from .text import blocks, span_hashes, texts_of, words_of

#: The key of the token, and the byte, that ends every document.
END = 0
_fold_case = np.arange(256, dtype=np.uint8)
_fold_case[ord("A") : ord("Z") + 1] += 32
_fold_case[0] = 255  # a NUL in a text is no end; UTF-8 has no such byte


def _bytes_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Codes (3 bytes of context, byte) at each place of the texts and their ends, and each text's first place; absent bytes are 0."""
    buf = _fold_case[np.frombuffer(b"\0\0\0".join([b"", *texts, b""]), dtype=np.uint8)].astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(x) + 3 for x in texts])]) + 3
    for k in (3, 2, 1):  # the blanks between texts
        buf[at - k] = END
    code = (buf[:-3] << 24) | (buf[1:-2] << 16) | (buf[2:-1] << 8) | buf[3:]
    first = at - 3  # the code of the text's first byte, after its three blanks
    n = np.array([len(x) + 1 for x in texts], dtype=np.int64)
    places = np.concatenate([[0], np.cumsum(n)])
    index = np.repeat(first[:-1], n) + np.arange(places[-1]) - np.repeat(places[:-1], n)
    return code[index], places


def _batched(batches, column: int, most: int = 8 << 20):
    """(batch, a, b, texts) over runs of documents with some ``most`` bytes."""
    for batch in batches:
        texts = texts_of(batch.column(column))
        for a, b in blocks(texts, most):
            yield batch, a, b, texts


def counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over all of (doc_id, text): words and ends (kind 0), byte 4-grams (kind 1)."""

    def run(batches):
        for batch, a, b, texts in _batched(batches, 0):
            w = words_of(texts[a:b])
            words, n = np.unique(span_hashes(w.buf, w.starts, w.ends), return_counts=True)
            codes, m = np.unique(np.concatenate([_bytes_of(texts[c:d])[0] for c, d in _inner(texts, a, b)]), return_counts=True)
            keys = np.concatenate([words.view(np.int64), [END], codes.astype(np.int64)])
            kinds = np.concatenate([np.zeros(len(words) + 1, np.int8), np.ones(len(codes), np.int8)])
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys), pa.array(np.concatenate([n, [b - a], m]).astype(np.int64))], ["kind", "key", "n"])

    return docs.select("text").mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _inner(texts: list, a: int, b: int):
    for c, d in blocks(texts[a:b]):
        yield a + c, a + d


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return out - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def _nodes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 binary nodes of rows of byte counts."""
    zeros, ones = np.empty((len(c), 255)), np.empty((len(c), 255))
    for k in range(8):
        halves = c.reshape(len(c), 1 << k, 2, -1).sum(axis=3)
        zeros[:, (1 << k) - 1 : (2 << k) - 1], ones[:, (1 << k) - 1 : (2 << k) - 1] = halves[:, :, 0], halves[:, :, 1]
    return zeros, ones


def _block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - math.log(math.pi)


_HALF = math.log(2)


def _weigh(c: np.ndarray, below: np.ndarray) -> np.ndarray:
    """log of the weighted block probability of rows of byte counts whose longer contexts have ``below`` together."""
    return np.logaddexp(_block(*_nodes(c)), below) - _HALF


def _descend(c: np.ndarray, weighted: np.ndarray | None, passed: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is passed on to longer contexts, what is mixed so far, and log10 byte probabilities where the tree ends here.

    ``weighted`` is None at the longest contexts. Where a byte isn't followed
    further, what would be passed on stays.
    """
    zeros, ones = _nodes(c)
    kt = (ones + 0.5) / (zeros + ones + 1)
    stay = np.ones_like(kt) if weighted is None else np.minimum(1, np.exp(_block(zeros, ones) - _HALF - weighted))
    mix, on = mixed + passed * stay * kt, passed * (1 - stay)
    p1 = np.clip(mix + on * kt, 1e-9, 1 - 1e-9)
    logs = np.zeros((len(kt), 256))
    for k in range(8):
        own = p1[:, (1 << k) - 1 : (2 << k) - 1]
        logs += np.repeat(np.stack([np.log10(1 - own), np.log10(own)], axis=2).reshape(len(kt), 2 << k), 128 >> k, axis=1)
    return on, mix, logs


def _each(table: pa.Table, key: str):
    """The groups of a table that is sorted by ``key``."""
    keys = table.column(key).to_numpy()
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:]):
        yield table.slice(a, b - a)


def _families(table: pa.Table):
    """For every last two bytes: the contexts of three bytes with them, and their rows of byte counts, 256 at most."""
    for part in _each(table, "family"):
        key, n = part.column("key").to_numpy(), part.column("n").to_numpy()
        contexts, at = np.unique(key >> 8, return_inverse=True)
        c = np.zeros((len(contexts), 256))
        c[at, key & 255] = n
        yield contexts, c


def _upward(rows: list) -> pa.RecordBatch:
    context, counts, weighted = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(context, pa.int64()), pa.array([x.tobytes() for x in counts], pa.binary()), pa.array([x.tobytes() for x in weighted], pa.binary())], ["context", "counts", "weighted"])


def _climb(table: pa.Table) -> pa.RecordBatch:
    """Counts and weighted probabilities of contexts of two bytes, with their last byte."""
    rows = []
    for contexts, c in _families(table):
        whole = c.sum(axis=0, keepdims=True)
        rows.append((int(contexts[0]) & 255, whole, _weigh(whole, _block(*_nodes(c)).sum(axis=0))))
    return _upward(rows)


def _matrix(column, width: int) -> np.ndarray:
    """Rows of ``width`` doubles that have come as bytes."""
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(-1, width)


def _climb_further(table: pa.Table) -> pa.RecordBatch:
    """The same for contexts of one byte, from those of two."""
    rows = []
    for part in _each(table, "context"):
        whole = _matrix(part.column("counts").to_pylist(), 256).sum(axis=0, keepdims=True)
        rows.append((part.column("context")[0].as_py(), whole, _weigh(whole, _matrix(part.column("weighted").to_pylist(), 255).sum(axis=0))))
    return _upward(rows)


class Tree:
    """log10 byte probabilities of contexts: ``rows`` those of the most frequent ones of three bytes, ``keys`` (sorted); ``short`` those of every last byte; ``long`` a table (depth, context, n, logs) of all of two and three bytes."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, short: np.ndarray, long: DataFrame):
        self.keys, self.rows, self.short, self.long = keys, rows, short, long

    def resolve(self, codes: DataFrame) -> DataFrame:
        """(key, value): log10 probability of the last byte of each code in (key), in its longest context that training has seen."""
        spark = codes.sparkSession
        short = spark.createDataFrame([(i, x) for i, x in enumerate(self.short.tolist())], "c1 long, l1 array<float>")
        out = codes.select("key", F.shiftright("key", 8).alias("c3"), F.shiftright("key", 8).bitwiseAND(0xFFFF).alias("c2"), F.shiftright("key", 8).bitwiseAND(0xFF).alias("c1"), (F.col("key").bitwiseAND(255) + 1).cast("int").alias("byte"))
        out = out.join(self.long.where("depth = 3").select(F.col("context").alias("c3"), F.col("logs").alias("l3")), "c3", "left")
        out = out.withColumn("v3", F.element_at("l3", F.col("byte"))).drop("l3")
        out = out.join(self.long.where("depth = 2").select(F.col("context").alias("c2"), F.col("logs").alias("l2")), "c2", "left")
        out = out.withColumn("v2", F.element_at("l2", F.col("byte"))).drop("l2").join(F.broadcast(short), "c1")  # 256 rows
        return out.select("key", F.coalesce("v3", "v2", F.element_at("l1", F.col("byte"))).cast("double").alias("value"))


def tree(grams: DataFrame, contexts: int = 12_288, scratch: Scratch | None = None) -> Tree:
    """The whole tree of byte 4-gram counts (key, n); a task holds the counts of one context of two bytes at a time.

    The driver gets the weights of contexts of one byte (256 rows) and the rows
    of ``contexts`` contexts of three.
    """
    spark = grams.sparkSession
    grams = grams.select("key", "n", F.shiftright("key", 8).bitwiseAND(0xFFFF).alias("family"))
    schema = "context long, counts binary, weighted binary"
    ones = map_groups(map_groups(grams, "family", _climb, schema), "context", _climb_further, schema).toPandas()  # 256 rows at most
    c1, w1 = _matrix(ones["counts"], 256), _matrix(ones["weighted"], 255)
    root = c1.sum(axis=0, keepdims=True)
    on, mix, logs = _descend(root, _weigh(root, w1.sum(axis=0)), np.ones((1, 255)), np.zeros((1, 255)))
    short = np.repeat(logs.astype(np.float32), 256, axis=0)
    passed, mixed = np.zeros((256, 255), np.float32), np.zeros((256, 255), np.float32)
    if len(ones):
        at = ones["context"].to_numpy(np.int64)
        passed[at], mixed[at], short[at] = _descend(c1, w1, on, mix)
    shared = spark.sparkContext.broadcast((passed, mixed))  # half a MB

    def down(table: pa.Table) -> pa.RecordBatch:
        depths, contexts, totals, rows = [], [], [], []
        for names, c in _families(table):
            last, whole = slice(int(names[0]) & 255, (int(names[0]) & 255) + 1), c.sum(axis=0, keepdims=True)
            on, mix, own = _descend(whole, _weigh(whole, _block(*_nodes(c)).sum(axis=0)), shared.value[0][last], shared.value[1][last])
            rows += [own.astype(np.float32), _descend(c, None, on, mix)[2].astype(np.float32)]
            depths.append(np.array([2] + [3] * len(c), dtype=np.int8))
            contexts += [names[:1] & 0xFFFF, names]
            totals += [whole.sum(axis=1), c.sum(axis=1)]
        logs = np.concatenate(rows)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate(depths)), pa.array(np.concatenate(contexts)), pa.array(np.concatenate(totals).astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.arange(len(logs) + 1, dtype=np.int32) * 256), pa.array(logs.ravel())),
        ], ["depth", "context", "n", "logs"])

    long = map_groups(grams, "family", down, "depth byte, context long, n long, logs array<float>")
    long = scratch.cut(long) if scratch else long
    most = long.where("depth = 3").select("context", "n").orderBy(F.desc("n"), "context").limit(contexts).select("context")
    top = long.where("depth = 3").join(F.broadcast(most), "context").select("context", "logs").toArrow().sort_by("context")  # bounded by ``contexts``
    rows = np.concatenate([c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in [top.column("logs").combine_chunks()] if len(c)] or [np.zeros(0, np.float32)]).reshape(-1, 256)
    return Tree(top.column("context").to_numpy().astype(np.uint32), rows, short, long)


def _lookup(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted ``keys`` of those values that are there, and which are not."""
    if not len(keys):
        return np.zeros(0, np.int64), np.ones(len(values), bool)
    i = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    hit = keys[i] == values
    return i[hit], ~hit


def score(docs: DataFrame, *, folds: int = 5, held_out: int = 1, contexts: int = 12_288, frequent: int = 200_000) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    ``score`` is the model's log10 probability of the text's bytes, A-Z
    lower-cased, and of its end. ``base_score`` is that of a smoothed unigram
    model over words and an end; its counts are exact over all training
    documents. The ``frequent`` words and the ``contexts`` contexts of three
    bytes that occur most are scored in place and all others joined: the two
    bound what tasks hold and change no result.
    Null texts are empty: an end alone. Repeated rows count and come back each;
    further columns are ignored; an empty table gives an empty result, and
    without training documents all bytes are equally likely.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        held = (fold(F.col("doc_id"), folds) == held_out).alias("held_out")
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held)
        known = scratch.cut(counts(docs.where(~F.col("held_out"))))
        words = known.where("kind = 0").select("key", "n")
        total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        top = words.orderBy(F.desc("n"), "key").limit(frequent).select("key", "n").toArrow().sort_by("key")  # bounded by ``frequent``
        model = tree(known.where("kind = 1").select("key", "n"), contexts, scratch)
        shared = spark.sparkContext.broadcast((top.column("key").to_numpy(), top.column("n").to_numpy(), model.keys, model.rows))
        n_all, v_all = int(total["n"]), int(total["v"])

        def term(c):
            return np.log10((c + 0.5) / (n_all + 0.5 * (v_all + 1)))

        def run(batches):
            keys, n, kept, table = shared.value
            for batch, a, b, texts in _batched(batches, 1, 1 << 20):
                own = texts[a:b]
                w = words_of(own)
                h = span_hashes(w.buf, w.starts, w.ends).view(np.int64)
                h = np.insert(h, w.first[1:], END)
                doc = np.repeat(np.arange(b - a), np.diff(w.first) + 1)
                i = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = keys[i] == h if len(keys) else np.zeros(len(h), bool)
                base = np.bincount(doc[hit], weights=term(n[i[hit]]), minlength=b - a)
                seen = np.bincount(doc[hit], minlength=b - a)
                codes, at = _bytes_of(own)
                found, rare = _lookup(kept, codes >> 8)
                logs = np.zeros(len(codes))
                logs[~rare] = table[found, codes[~rare] & 255]
                logs = np.concatenate([[0], np.cumsum(logs)])
                # what isn't scored here: (document, kind, key), each with its count
                lost = np.repeat(np.arange(b - a), np.diff(at))[rare]
                whose, kind = np.concatenate([doc[~hit], lost]), np.concatenate([np.zeros(int((~hit).sum()), np.int8), np.ones(len(lost), np.int8)])
                key = np.concatenate([h[~hit], codes[rare].astype(np.int64)])
                order = np.lexsort((key, kind, whose))
                whose, kind, key = whose[order], kind[order], key[order]
                new = np.flatnonzero(np.concatenate([[True], (whose[1:] != whose[:-1]) | (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.zeros(0, np.int64)
                places = pa.array(np.searchsorted(whose[new], np.arange(b - a + 1)), pa.int32())
                kinds, rest, times = (pa.ListArray.from_arrays(places, pa.array(x)) for x in (kind[new], key[new], np.diff(np.append(new, len(key)))))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(w.first) + 1), pa.array(seen.astype(np.int64)), pa.array(base),
                    pa.array(logs[at[1:]] - logs[at[:-1]]), pa.array(np.diff(at) - 1), kinds, rest, times,
                ], ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes", "kind", "key", "k"])

        rows = docs.select("doc_id", "text", "held_out").mapInArrow(
            run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, kind array<byte>, key array<long>, k array<long>")
        rows = scratch.cut(rows.withColumn("row", F.monotonically_increasing_id()))
        rare = rows.select("row", F.explode(F.arrays_zip("kind", "key", "k")).alias("x")).select("row", "x.*")
        values = model.resolve(rare.where("kind = 1").select("key").distinct())
        values = words.select(F.lit(0).cast("byte").alias("kind"), "key", "n", F.lit(None).cast("double").alias("value")).unionByName(values.select(F.lit(1).cast("byte").alias("kind"), "key", F.lit(0).cast("long").alias("n"), "value"))
        rare = rare.join(values, ["kind", "key"], "left").withColumn("c", F.coalesce("n", F.lit(0)))
        part = F.when(F.col("kind") == 0, F.col("k") * F.log10((F.col("c") + 0.5) / F.lit(n_all + 0.5 * (v_all + 1))))
        also = F.when((F.col("kind") == 0) & (F.col("c") > 0), F.col("k")).otherwise(0)
        rare = rare.groupBy("row").agg(F.sum(part).alias("more"), F.sum(also).alias("also"), F.sum(F.col("k") * F.col("value")).alias("rest"))
        out = rows.drop("kind", "key", "k").join(rare, "row", "left").withColumn("score", F.col("score") + F.coalesce("rest", F.lit(0.0)))
        return scratch.keep(out.select(
            "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", "n_bytes",
            (-F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte")))
