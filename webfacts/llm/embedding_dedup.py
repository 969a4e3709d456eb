"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation that makes the signs of the rotated vectors balanced, faithful codes
is learned on a bounded sample; a long code from several rotations is cut into
substrings, each the key of one hash table. The tables hold codes, not vectors:
vectors of one label that share a substring are candidates if their whole codes
lie within a Hamming radius, and only candidates' vectors are fetched and
compared, in double precision. A pair counts in the first table that brings it
together, so links are counted without making pairs a table of their own.

Vectors are not centred, as that would change the angles that links are about.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .groups import in_blocks, map_groups
from .store import Scratch

#: Copies of a vector are dealt to so many tasks.
SALTS = 64


def vectors(df: DataFrame) -> DataFrame:
    """Of (vec_id, label, embedding): vec_id, label, dim, key, vec (float64 bytes, the largest component from a half to one); key and vec null where a vector cannot link."""

    def run(batches):
        for batch in batches:
            keys, vecs, dims = [], [], []
            for label, x in zip(batch.column(1).to_pylist(), batch.column(2)):
                v = None
                if label is not None and x.is_valid and x.values.null_count == 0 and len(x.values):
                    v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    v = v if np.isfinite(v).all() and np.any(v) else None
                # times a power of two, which changes no angle, so that no square is too large or too small for a double
                vecs.append(None if v is None else np.ldexp(v, -np.frexp(np.abs(v).max())[1]).tobytes())
                dims.append(0 if v is None else len(v))
                keys.append(None if v is None else hashlib.blake2b((v + 0.0).tobytes(), digest_size=16, person=str(label).encode()[:16]).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "label", "dim", "key", "vec"])

    whole = dict(df.dtypes)["label"] in ("tinyint", "smallint", "int", "bigint")
    label = F.col("label").cast("long") if whole else F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, label long, dim int, key binary, vec binary")


def rotations(sample: np.ndarray, bits: int, rounds: int = 30, seed: int = 3) -> np.ndarray:
    """(dimension, bits) directions: iterative quantisation from as many random starts as ``bits`` needs."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    _, _, axes = np.linalg.svd(x.T @ x)
    v, rng, out = x @ axes.T, np.random.default_rng(seed), []
    while sum(r.shape[1] for r in out) < bits:
        r, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(axes.T @ r)
    return np.concatenate(out, axis=1)[:, :bits]


def table_sizes(rows: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits of a substring, so that a label's vectors spread over buckets of some 32, and tables, so that a pair at ``cosine`` is found with ``recall``."""
    bits = min(24, max(6, math.ceil(math.log2(max(rows, 1) / 32 + 1))))
    met = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - met))


def radius(bits: int, cosine: float) -> int:
    """Bits of a whole code in which two vectors at ``cosine`` differ at most, but for six deviations of a binomial."""
    p = math.acos(cosine) / math.pi
    return math.ceil(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def _tables(heads: DataFrame, turn, bits: int, tables: int) -> DataFrame:
    """(label, dim, at, sub, doc, code), one row per table, of heads (doc, label, dim, vec)."""

    def run(batches):
        for batch in batches:
            doc, label = batch.column("doc"), batch.column("label").to_numpy()
            dims = batch.column("dim").to_numpy()
            code = np.zeros((len(dims), tables), dtype=np.int32)
            vecs = batch.column("vec").to_pylist()
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(vecs[i] for i in own), dtype=np.float64).reshape(len(own), d)
                on = (x @ turn.value[int(d)] >= 0).reshape(len(own), tables, bits)
                code[own] = on @ (1 << np.arange(bits))
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            for t in range(tables):
                node = np.stack([label, dims.astype(np.int64), np.full(len(dims), t), code[:, t].astype(np.int64)], axis=1)
                yield pa.RecordBatch.from_arrays([*(pa.array(node[:, k]) for k in range(4)), doc, codes], ["label", "dim", "at", "sub", "doc", "code"])

    return heads.select("doc", "label", "dim", "vec").mapInArrow(run, "label long, dim long, at long, sub long, doc long, code binary")


def _groups(table: pa.Table):
    """(a, b, code, at, block, within) of each group of a sorted table that has two rows or more."""
    key, at, block = (table.column(c).to_numpy() for c in ("group", "at", "block"))
    within, code = table.column("within").to_numpy(zero_copy_only=False), table.column("code").to_pylist()
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    for a, b in zip(starts, np.append(starts[1:], len(key))):
        if b - a > 1:
            yield a, b, np.frombuffer(b"".join(code[a:b]), dtype=np.int32).reshape(b - a, -1), int(at[a]), block[a:b], bool(within[a])


def _first_here(code: np.ndarray, at: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether table ``at`` is the first that pairs of rows share."""
    return np.concatenate([~(code[i[k : k + 65536], :at] == code[j[k : k + 65536], :at]).any(axis=1) for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])


def _candidates(rows: DataFrame, most: int) -> DataFrame:
    """Those rows (group, at, doc, block, within, code) of a group that have another within ``most`` bits there."""

    def run(table: pa.Table) -> pa.RecordBatch:
        keep = np.zeros(table.num_rows, dtype=bool)
        for a, b, code, at, block, within in _groups(table):
            apart = np.zeros((b - a, b - a), dtype=np.uint16)
            for t in range(code.shape[1]):
                apart += np.bitwise_count(code[:, None, t] ^ code[None, :, t])
            i, j = np.nonzero(np.triu(apart <= most, 1))
            ok = np.full(len(i), True) if within else block[i] != block[j]
            keep[a + i[ok]] = True
            keep[a + j[ok]] = True
        left = table.filter(pa.array(keep)).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in left.columns], left.schema.names)

    names = ["group", "at", "doc", "block", "within", "code"]
    return map_groups(rows.select(*names), "group", run, "group long, at long, doc long, block int, within boolean, code binary")


def _compare(rows: DataFrame, cosine: float) -> DataFrame:
    """(id, n_links, root) of every row (group, at, doc, size, block, within, code, vec) of a group that has links there."""

    def run(table: pa.Table) -> pa.RecordBatch:
        doc, size = table.column("doc").to_numpy(), table.column("size").to_numpy()
        vec, out = table.column("vec").to_pylist(), [(np.zeros(0, np.int64),) * 3]
        for a, b, code, at, block, within in _groups(table):
            x = np.frombuffer(b"".join(vec[a:b]), dtype=np.float64).reshape(b - a, -1)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            i, j = np.nonzero(np.triu(x @ x.T >= cosine, 1))
            ok = np.full(len(i), True) if within else block[i] != block[j]
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            new = _first_here(code, at, i, j)
            n, root, before = np.zeros(b - a, dtype=np.int64), np.arange(b - a), None
            np.add.at(n, i[new], size[a + j[new]])
            np.add.at(n, j[new], size[a + i[new]])
            while before is None or (root != before).any():
                before = root.copy()
                least = np.minimum(root[i], root[j])
                np.minimum.at(root, root[i], least)
                np.minimum.at(root, root[j], least)
                root = root[root]
            k = np.flatnonzero((n > 0) | (root != np.arange(b - a)))
            out.append((doc[a + k], n[k], doc[a + root[k]]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["id", "n_links", "root"])

    return map_groups(rows.select("group", "at", "doc", "size", "block", "within", "code", "vec"), "group", run, "id long, n_links long, root long")


def near_vectors(df: DataFrame, *, cosine: float = 0.93, recall: float = 0.98, sample_rows: int = 4096, block: int = 512) -> DataFrame:
    """One row per row of (vec_id, label, embedding): vec_id, n_links, component_id, kept.

    Rows of one label and dimension are linked at a cosine of ``cosine`` or
    more. Null, empty and zero vectors, those with null or non-finite
    components and those without a label link with nothing; others may be as long
    or as short as doubles can be. Labels that are no whole numbers count by a hash
    of 64 bits of their text. Equal vectors of a
    label are one vertex that counts as often as it occurs. Rows of one vec_id
    are one vertex too. Rotations are learned on at most ``sample_rows``
    vectors, taken by a hash of vec_id; all vectors are indexed. An empty table
    gives an empty result; further columns are ignored.
    """
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.cut(vectors(df))
        valid = rows.where("key is not null and vec_id is not null")
        # equal vectors by label and key; a hot vector is counted in parts first
        salted = valid.groupBy("label", "dim", "key", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
        parts = salted.agg(F.min("vec_id").alias("doc"), F.count("*").alias("size"))
        own = Window.partitionBy("label", "dim", "key")
        parts = scratch.cut(parts.withColumn("doc", F.min("doc").over(own)).withColumn("size", F.sum("size").over(own)), scratch.rows(rows))
        firsts = parts.groupBy("label", "dim", "key").agg(F.min("doc").alias("doc"), F.min("size").alias("size"))
        heads = firsts.join(valid.select(F.col("vec_id").alias("doc"), "key", "vec").dropDuplicates(["doc", "key"]), ["doc", "key"])
        heads = scratch.cut(heads.select("doc", "label", "dim", "size", "vec"), scratch.rows(parts))
        n = heads.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        bits, tables = table_sizes(n, cosine, recall)
        turn, sample = {}, heads.orderBy(F.xxhash64("doc"), "doc").limit(sample_rows).select("dim", "vec").collect()
        for d in [r[0] for r in heads.select("dim").distinct().collect()]:
            fit = [np.frombuffer(r.vec, np.float64) for r in sample if r.dim == d]
            turn[d] = rotations(np.stack(fit) if fit else np.eye(d), bits * tables)
        shared = spark.sparkContext.broadcast(turn)  # a matrix per dimension of vectors
        indexed = scratch.cut(_tables(heads, shared, bits, tables).withColumn("node", F.xxhash64("label", "dim", "at", "sub")).select("node", "at", "doc", "code"))
        sizes = indexed.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        dealt = in_blocks(indexed.join(sizes, "node"), "node", "n", "doc", block)
        wanted = scratch.cut(_candidates(dealt, radius(bits * tables, cosine)))
        scratch.free(indexed)
        found = scratch.cut(_compare(wanted.join(heads.select("doc", "size", "vec"), "doc"), cosine))
        part = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")), scratch, rows=scratch.rows(found)).withColumnRenamed("id", "doc")
        links = found.groupBy(F.col("id").alias("doc")).agg(F.sum("n_links").alias("n"))
        out = parts.join(links, "doc", "left").join(part, "doc", "left").select(
            "label", "dim", "key", "salt", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "doc").alias("component_id"))
        out = valid.select("vec_id", "label", "dim", "key", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt")).join(out, ["label", "dim", "key", "salt"]).select("vec_id", "n_links", "component_id")
        rest = rows.where("key is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return scratch.keep(out.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), scratch.rows(rows))
