"""MinHash near-duplicates by a chosen-path set similarity join.

Every document is the set of its distinct word shingles, summed up by minwise
hashes. A tree starts with all documents in one node; a node picks ``branch``
coordinates by a hash of its path, and a document goes to one child for each,
named by the coordinate and the document's minwise token there. Two documents of
similarity s meet in a given child with probability s, so with two branches a
pair at 0.85 shares a leaf of one tree with probability 0.969 however deep the
tree is; ``trees`` independent trees miss it with probability 0.031 ** trees.
Nodes of at most ``leaf`` documents are compared exhaustively by sketch and
leave the recursion. Larger ones are first compared in blocks, each with the
same few picked documents: what hangs together with a pick there needs no
comparison among itself. If the rest is small, it is compared with the whole
node, otherwise the node branches again. Nodes still large at the last level are
compared in blocks, all of them.

Copies (equal word sequences) are one vertex from the start. Candidates only
name clusters; links are found inside clusters on the full shingle sets of the
texts, in blocks if a cluster is large.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .groups import map_groups, pairs_within
from .store import Scratch, gathered
from .text import blocks, mix, ngram_hashes, span_hashes, texts_of, words_of

#: Coordinates of a sketch, one byte each; the first of them, whole, choose the paths.
COORDINATES, PATHS = 128, 64
#: A class of copies is dealt to so many tasks.
SALTS = 64
_multipliers = np.random.default_rng(8501).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def signatures(df: DataFrame, shingle: int = 5) -> DataFrame:
    """Of (doc_id, text): doc_id, mark (a hash of the text), n_shingles, copy_key (binary, of the word sequence), signature, sketch (binary).

    Null texts and texts without words have n_shingles 0 and null keys.
    """

    def run(batches):
        for batch in batches:
            texts, ids, marks = texts_of(batch.column(1)), batch.column(0), batch.column(2)
            for a, b in blocks(texts):
                w = words_of(texts[a:b])
                h = span_hashes(w.buf, w.starts, w.ends)
                grams, at = ngram_hashes(h, w.first, shingle)
                some = np.flatnonzero(np.diff(at))
                n = np.zeros(b - a, dtype=np.int64)
                keys = [None] * (b - a)
                for d in some:
                    n[d] = len(np.unique(grams[at[d] : at[d + 1]]))
                    keys[d] = hashlib.blake2b(h[w.first[d] : w.first[d + 1]].tobytes(), digest_size=16).digest()
                sig = np.zeros((b - a, COORDINATES), dtype=np.uint32)
                if len(some):
                    for k, m in enumerate(_multipliers):
                        v = grams * m
                        sig[some, k] = np.minimum.reduceat(v, at[some]) >> np.uint64(32)
                mixed = sig * np.uint32(2654435761)
                sketch, sig = (mixed >> np.uint32(24)).astype(np.uint8), sig[:, :PATHS]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, b - a).cast(pa.int64()), marks.slice(a, b - a), pa.array(n), pa.array(keys, pa.binary()),
                    pa.array([x.tobytes() if k else None for x, k in zip(sig, keys)], pa.binary()),
                    pa.array([x.tobytes() if k else None for x, k in zip(sketch, keys)], pa.binary()),
                ], ["doc_id", "mark", "n_shingles", "copy_key", "signature", "sketch"])

    return df.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, "doc_id long, mark long, n_shingles long, copy_key binary, signature binary, sketch binary")


def _branch(df: DataFrame, branch: int, trees: int = 0) -> DataFrame:
    """Children (path, doc) of rows (path, doc, signature); with ``trees``, of (doc, signature) at the roots of that many trees."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column("doc").to_numpy()
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint32).reshape(len(doc), PATHS)
            if trees:
                paths = [np.full(len(doc), mix(np.array([t + 1], dtype=np.uint64))[0]) for t in range(trees)]
            else:
                paths = [batch.column("path").to_numpy().view(np.uint64)]
            for path in paths:
                first = mix(path ^ _GOLD) % np.uint64(PATHS)
                for j in range(branch):  # distinct coordinates, at equal distances round the signature from the first
                    at = (first + np.uint64(j * (PATHS // branch))) % np.uint64(PATHS)
                    token = sig[np.arange(len(doc)), at.astype(np.int64)].astype(np.uint64)
                    child = mix(mix(path + (at + np.uint64(1)) * _GOLD) ^ token)
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(doc)], ["path", "doc"])

    return df.mapInArrow(run, "path long, doc long")


def _allowed(side: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs to be compared: rows of side 0 with every row, others with those of another side."""
    return (side[x] == 0) | (side[y] == 0) | (side[x] != side[y])


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row number that each of n rows hangs together with."""
    root, before = np.arange(n), None
    while len(left) and (before is None or (root != before).any()):
        before = root.copy()
        least = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], least)
        np.minimum.at(root, root[right], least)
        root = np.minimum(root, root[root])
    while (root != root[root]).any():
        root = root[root]
    return root


def _near(key: np.ndarray, size: np.ndarray, sketch: np.ndarray, side: np.ndarray, bounds: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one key that their sides and sizes admit and whose sketches may reach the similarity."""
    least, num, den = bounds
    found = [(np.zeros(0, np.int64),) * 2]
    for left, right in pairs_within(key):
        ok = _allowed(side, left, right) & (den * np.minimum(size[left], size[right]) >= num * np.maximum(size[left], size[right]))
        left, right = left[ok], right[ok]
        same = np.zeros(len(left), dtype=np.int16)
        for i in range(0, len(left), 1 << 14):
            same[i : i + (1 << 14)] = (sketch[left[i : i + (1 << 14)]] == sketch[right[i : i + (1 << 14)]]).sum(axis=1)
        ok = (same / COORDINATES - 1 / 256) / (1 - 1 / 256) >= least
        found.append((left[ok], right[ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns of a table sorted by group and document, and its sketches."""
    table = table.take(pa.array(np.lexsort((table.column("doc").to_numpy(), table.column("group").to_numpy()))))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)
    return [*(table.column(c).to_numpy() for c in names), sketch]


def _compared(rows: DataFrame, bounds: tuple, n: int) -> DataFrame:
    """Edges (u, v) that connect what is near among the rows (group, side, doc, n_shingles, sketch) of a group."""

    def run(table: pa.Table) -> pa.RecordBatch:
        key, side, doc, size, sketch = _columns(table, "group", "side", "doc", "n_shingles")
        root = _roots(len(key), *_near(key, size, sketch, side, bounds))
        far = np.flatnonzero(root != np.arange(len(key)))
        return pa.RecordBatch.from_arrays([pa.array(doc[far]), pa.array(doc[root[far]])], ["u", "v"])

    return map_groups(rows.select("group", "side", "doc", "n_shingles", "sketch"), "group", run, "u long, v long", n)


def _labelled(rows: DataFrame, bounds: tuple, n: int) -> DataFrame:
    """(path, doc, label) of rows (group, path, doc, pick, n_shingles, sketch): a document is connected with its label.

    In every block of a node stand the same picks, whose clusters name the
    labels; what hangs together with no pick has a label of its block. A row
    without path connects two labels.
    """

    def run(table: pa.Table) -> pa.RecordBatch:
        key, path, doc, pick, size, sketch = _columns(table, "group", "path", "doc", "pick", "n_shingles")
        pick, n = pick.astype(bool), len(key)
        left, right = _near(key, size, sketch, np.zeros(n, np.int8), bounds)
        both = pick[left] & pick[right]
        root, own = _roots(n, left, right), _roots(n, left[both], right[both])
        best = np.full(n, n)
        np.minimum.at(best, root[pick], own[pick])
        label = np.where(best[root] < n, best[root], root)
        rows, more = np.flatnonzero(~pick), np.flatnonzero(pick & (own != label))
        paths = pa.concat_arrays([pa.array(path[rows]), pa.nulls(len(more), pa.int64())])
        return pa.RecordBatch.from_arrays([
            paths, pa.array(np.concatenate([doc[rows], doc[own[more]]])), pa.array(np.concatenate([doc[label[rows]], doc[label[more]]]))], ["path", "doc", "label"])

    return map_groups(rows.select("group", "path", "doc", "pick", "n_shingles", "sketch"), "group", run, "path long, doc long, label long", n, 2_000)


def _parts(n: Column, most: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / most)).cast("int")


def _with_picks(rows: DataFrame, node: str, n: str, parts: Column, picks: int) -> DataFrame:
    """Adds ``group`` and ``pick``: a node's rows are dealt to blocks, and some ``picks`` of them go to all of its blocks besides."""
    chosen = F.pmod(F.xxhash64(F.lit(5), node, "doc"), F.lit(1 << 30)) < (F.lit(picks * float(1 << 30)) / F.col(n))
    at = F.array(F.struct(F.pmod(F.xxhash64("doc"), "g").cast("int").alias("k"), F.lit(False).alias("pick")))
    copies = F.when((F.col("g") > 1) & chosen, F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda k: F.struct(k.alias("k"), F.lit(True).alias("pick"))))
    rows = rows.withColumn("g", parts).withColumn("at", F.explode(F.concat(at, F.coalesce(copies, F.array().cast("array<struct<k:int,pick:boolean>>")))))
    return rows.withColumn("group", F.xxhash64(node, "at.k")).withColumn("pick", F.col("at.pick")).drop("at", "g")


def _minor_in_blocks(rows: DataFrame, node: str, parts: Column) -> DataFrame:
    """Adds ``group`` and ``side``: a node's minor rows go to all of its blocks, the others are dealt to them."""
    at = F.when(F.col("minor"), F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc"), "g").cast("int")))
    rows = rows.withColumn("g", parts).withColumn("at", F.explode(at)).withColumn("group", F.xxhash64(node, "at"))
    return rows.withColumn("side", F.when(F.col("minor"), 0).otherwise(1)).drop("at", "g")


def _pairs_of_blocks(rows: DataFrame, node: str, parts: Column) -> DataFrame:
    """Adds ``group`` and ``side``: every two blocks of a node are a group, so that each pair of its rows meets once."""
    block = F.pmod(F.xxhash64(F.lit(77), "doc"), "g").cast("int")
    rows = rows.withColumn("g", parts).withColumn("b", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.withColumn("group", F.xxhash64(node, F.least("b", "o"), F.greatest("b", "o")))
    return rows.withColumn("side", F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2)).drop("b", "o", "g")


def _minor(rows: DataFrame, node: str, part: str) -> DataFrame:
    """Rows of nodes of several parts, with ``n`` and ``m``, the sizes of the node and of its largest part, and ``minor``: not of that."""
    largest = rows.groupBy(node, part).agg(F.count("*").alias("m")).groupBy(node).agg(F.max(F.struct("m", part)).alias("top"), F.sum("m").alias("n"))
    largest = largest.where("top.m < n").select(node, "n", "top.m", F.col(f"top.{part}").alias("_major"))
    return rows.join(largest, node).withColumn("minor", F.col(part) != F.col("_major")).drop("_major")


def proposals(heads: DataFrame, scratch: Scratch, num: int, den: int, trees: int, branch: int, leaf: int, levels: int, block: int, picks: int = 32) -> DataFrame:
    """Edges (u, v) that connect heads (doc, n_shingles, signature, sketch) which the chosen-path trees find near.

    Two documents whose similarity may reach num / den and that meet in a node
    hang together over edges.
    """
    bounds = (num / den - 5 * (num / den * (1 - num / den) / COORDINATES) ** 0.5, num, den)
    sketches, active = heads.select("doc", "n_shingles", "sketch"), heads.select("doc", "signature")
    todo, edges, deal = [], [], ["group", "side", "doc"]
    for level in range(levels):
        children = scratch.cut(_branch(active, branch, 0 if level else trees))
        n = scratch.rows(children)
        nodes = scratch.cut(children.join(children.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "path"), n)
        scratch.free(children)
        n = scratch.rows(nodes)
        todo.append(nodes.where(F.col("n") <= leaf).select(F.col("path").alias("group"), F.lit(0).alias("side"), "doc"))
        labels = _with_picks(nodes.where(F.col("n") > leaf), "path", "n", _parts(F.col("n"), block), picks)
        labels = scratch.cut(_labelled(labels.join(sketches, "doc"), bounds, 2 * n), 2 * n)
        n = scratch.rows(labels)
        if not n:
            break
        edges.append(labels.where("doc <> label").select(F.col("doc").alias("u"), F.col("label").alias("v")))
        rest = scratch.cut(_minor(labels.where("path is not null"), "path", "label").select("path", "doc", "n", "m", "minor"), n)
        n = scratch.rows(rest)
        if not n:
            break
        done = F.col("n") - F.col("m") <= leaf
        todo.append(_minor_in_blocks(rest.where(done), "path", _parts(F.col("n"), block)).select(*deal))
        if level == levels - 1:
            todo.append(_pairs_of_blocks(rest.where(~done), "path", _parts(F.col("n"), block)).select(*deal))
        active = gathered(rest.where(~done).select("path", "doc").join(heads.select("doc", "signature"), "doc"), n)
    rows = todo[0]
    for x in todo[1:]:
        rows = rows.union(x)
    rows = scratch.cut(rows)
    found = _compared(rows.join(sketches, "doc"), bounds, scratch.rows(rows))
    for x in edges:
        found = found.union(x)
    return found


def _shingle_sets(texts: list, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one after the other, and where each text's begin."""
    w = words_of(texts)
    grams, at = ngram_hashes(span_hashes(w.buf, w.starts, w.ends), w.first, shingle)
    own = [np.unique(grams[x:y]) for x, y in zip(at[:-1], at[1:])]
    return np.concatenate([*own, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


def _exact(rows: DataFrame, shingle: int, num: int, den: int, n: int) -> DataFrame:
    """Links (u, v) between rows (group, side, doc, part, text) of a group, on full shingle sets.

    Pairs of one part are known already, and so are those that links found
    before connect; so as many links come back as it takes to connect a group's
    documents.
    """

    def run(table: pa.Table) -> pa.RecordBatch:
        key, side, doc, part = (table.column(c).to_numpy() for c in ("group", "side", "doc", "part"))
        texts, us, vs = texts_of(table.column("text")), [], []
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        for x, y in zip(starts, np.append(starts[1:], len(key))):
            if y - x < 2 or (part[x:y] == part[x]).all():
                continue
            ids, at = _shingle_sets(texts[x:y], shingle)
            _, ids = np.unique(ids, return_inverse=True)
            size, own, root, si = np.diff(at), doc[x:y], part[x:y].copy(), side[x:y]
            mark = np.zeros(int(ids.max()) + 1, dtype=bool)
            for i in range(y - x - 1):
                todo = (root != root[i]) & ((si == 0) | (si[i] == 0) | (si != si[i])) & (den * np.minimum(size, size[i]) >= num * np.maximum(size, size[i]))
                todo[: i + 1] = False
                if not todo.any():
                    continue
                mark[ids[at[i] : at[i + 1]]] = True
                both = np.add.reduceat(mark[ids], at[:-1], dtype=np.int64)
                mark[ids[at[i] : at[i + 1]]] = False
                for j in np.flatnonzero(todo & (den * both >= num * (size + size[i] - both))):
                    if root[j] != root[i]:
                        us.append(int(own[i]))
                        vs.append(int(own[j]))
                        root[(root == root[i]) | (root == root[j])] = min(root[i], root[j])
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return map_groups(rows.select("group", "side", "doc", "part", "text"), "group", run, "u long, v long", parts=min(10_000, 1 + n // 500))


def linked(heads: DataFrame, docs: DataFrame, scratch: Scratch, *, shingle: int, num: int, den: int, trees: int, branch: int, leaf: int, levels: int, block: int, weight: int = 2_000_000, picks: int = 8) -> DataFrame:
    """Confirmed links (u, v) that connect all documents of one class.

    A block of a cluster has some ``block`` documents, fewer if they are long:
    some ``weight`` shingles. heads: (doc, doc_id, mark, n_shingles, signature,
    sketch); docs: (doc_id, text).
    """
    edges = scratch.cut(proposals(heads, scratch, num, den, trees, branch, leaf, levels, 2 * block))
    cluster = components(edges, scratch, rows=scratch.rows(edges))
    cluster = cluster.withColumnRenamed("id", "doc").join(heads.select("doc", "doc_id", "mark", "n_shingles"), "doc")
    sizes = cluster.groupBy("component_id").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    rows = scratch.cut(cluster.join(sizes, "component_id"), 2 * scratch.rows(edges))
    n = scratch.rows(rows)
    parts = F.greatest(_parts(F.col("n"), block), _parts(F.col("w"), weight))
    # the texts of clusters, once each, whichever of equal rows of the input they come from
    texts, wanted = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")), rows.select("doc", "doc_id", "mark").hint("merge")
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["mark"] == wanted["mark"])).select("doc", "text")
    texts = scratch.cut(texts)
    texts = texts if scratch.rows(texts) == n else texts.dropDuplicates(["doc"])  # more where rows of the input repeat

    def exact(dealt: DataFrame) -> DataFrame:
        dealt = scratch.cut(dealt)
        both = dealt.select("doc", "group", "side", "part").hint("merge").join(texts, "doc")
        return scratch.cut(_exact(both, shingle, num, den, scratch.rows(dealt)))

    links = exact(_with_picks(rows, "component_id", "n", parts, picks).withColumn("side", F.lit(0)).withColumn("part", F.col("doc")))
    # what blocks of one cluster have in common, but for what is known to be one part
    large = scratch.cut(rows.where(parts > 1), n)
    n = scratch.rows(large)
    if not n:
        return links
    known = links.join(large.select(F.col("doc").alias("u")), "u", "left_semi")
    known = components(known, scratch, rows=scratch.rows(links)).select(F.col("id").alias("doc"), F.col("component_id").alias("part"))
    rows = large.drop("n").join(known, "doc", "left").withColumn("part", F.coalesce("part", "doc"))
    rows = scratch.cut(_minor(rows, "component_id", "part"), n)
    if not scratch.rows(rows):
        return links
    few = F.col("n") - F.col("m") <= leaf
    names = ["group", "side", "doc", "part"]
    dealt = _minor_in_blocks(rows.where(few), "component_id", parts).select(*names).union(_pairs_of_blocks(rows.where(~few), "component_id", parts).select(*names))
    return links.union(exact(dealt))


def _classes(rows: DataFrame) -> DataFrame:
    """(copy_key, salt, head, least) of rows (row, doc_id, copy_key, salt): the class's row of the smallest doc_id, and that doc_id.

    A class has one row a salt, so that no task works through all copies of a text.
    """
    first = F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("head")
    parts = rows.where("copy_key is not null").groupBy("copy_key", "salt").agg(first, F.min("doc_id").alias("least"))
    own = Window.partitionBy("copy_key")
    head = F.coalesce(F.min_by("head", "least").over(own), F.min("head").over(own))
    return parts.select("copy_key", "salt", head.alias("head"), F.min("least").over(own).alias("least"))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, num: int = 85, den: int = 100, trees: int = 4, branch: int = 2, leaf: int = 2048, levels: int = 8, block: int = 256) -> DataFrame:
    """Classes of near-duplicates of (doc_id, text): doc_id, n_shingles, component_id, kept, mark, stays.

    Documents are linked when den * |intersection| >= num * |union| of their
    sets of distinct word shingles; component_id is the smallest doc_id
    reachable over links and ``kept`` marks it. ``stays`` marks one row of each
    class, one of those that are kept; ``mark`` is a hash of the text. Null
    texts and texts without words have no shingles and link with nothing; texts
    shorter than a shingle are one shingle, their whole word sequence. Each row
    is a document: repeated rows are copies, and different texts of one doc_id
    belong each to its own class. A null doc_id is never the smallest of a
    class; a class of such rows alone has a null component_id and none kept,
    but one that stays. Further columns of the input are ignored. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        rows = signatures(docs, shingle).withColumn("row", F.monotonically_increasing_id())
        rows = scratch.cut(rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")))
        n = scratch.rows(rows)
        classes = scratch.cut(_classes(rows), n)
        heads = classes.where(F.col("salt") == F.pmod(F.xxhash64("head"), F.lit(SALTS))).select("head", "least")
        heads = rows.join(heads, F.col("row") == F.col("head")).select(F.col("head").alias("doc"), "least", "doc_id", "mark", "n_shingles", "signature", "sketch")
        heads = scratch.cut(heads, n)
        links = linked(heads, docs, scratch, shingle=shingle, num=num, den=den, trees=trees, branch=branch, leaf=leaf, levels=levels, block=block)
        part = components(links, scratch, rows=n).withColumnRenamed("id", "head").join(heads.select(F.col("doc").alias("head"), "least"), "head")
        part = scratch.cut(part, n)
        tops = part.groupBy("component_id").agg(F.coalesce(F.min_by("head", "least"), F.min("head")).alias("first"), F.min("least").alias("component"))
        part = part.select("head", "component_id").join(tops, "component_id").select("head", "first", "component")
        classes = classes.join(part, "head", "left")
        classes = classes.select("copy_key", "salt", F.coalesce("component", "least").alias("component_id"), F.coalesce("first", "head").alias("first"))
        out = rows.select("doc_id", "n_shingles", "mark", "row", "copy_key", "salt").join(classes, ["copy_key", "salt"], "left")
        out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
        return scratch.keep(out.select(
            "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
            "mark", (F.col("first").isNull() | (F.col("row") == F.col("first"))).alias("stays")), n)
