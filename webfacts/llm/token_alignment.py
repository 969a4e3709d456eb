"""Alignment of two tokenizers' tokens by the bytes that they cover.

Texts are cut into chunks that no token of either side crosses. A task encodes and
aligns each chunk once, by arrays over all new chunks of a block of texts: tokens of
both sides overlap where one's first and last byte lie between ends of the other's,
and ends that both share cut a chunk into groups. A text's groups and links are
those of its chunks.

How many documents hold a pair of ids linked is counted over the corpus by Spark.
The pairs found in most documents, a bounded number of them, go back to their
documents by a broadcast; all others by a shuffle, where none is hot any more.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import encoder
from .store import Scratch
from .text import blocks, texts_of

#: Bytes of text in a block.
BLOCK = 3 << 20
#: A text's row of tokens and links: the different pairs that overlap (A's id in the high half), and how often.
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
#: Pairs that are broadcast, at 24 bytes each.
HOT_PAIRS = 50_000

_tables: dict[str, tuple] = {}
_memos: dict[tuple[str, str], _Memo] = {}


def _byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(other)}


def first_tokenizer(vocabulary: str):
    """(encode, bytes of each id) of a byte-level tokenizers file."""
    if vocabulary not in _tables:
        import public_tokenizers
        from tokenizers import Tokenizer

        byte = _byte_level()
        vocab = Tokenizer.from_file(public_tokenizers.path(vocabulary)).get_vocab(with_added_tokens=False)
        table = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            table[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        _tables[vocabulary] = encoder(vocabulary), table, np.array([len(x) for x in table], dtype=np.int64)
    return _tables[vocabulary]


def second_tokenizer(model: str):
    """(encode, bytes of each id) of a sentencepiece model, whose encoding puts a blank before a text."""
    if model not in _tables:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
        if any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size())):
            raise ValueError("a piece that goes on after a blank: texts can't be encoded in parts")
        table = [piece(i) for i in range(sp.get_piece_size())]
        _tables[model] = sp, table, np.array([len(x) for x in table], dtype=np.int64)
    return _tables[model]


def chunks(text: str) -> list[str]:
    """Parts of a text, parted by single blanks, that neither tokenizer joins: each boundary has no white space before the blank and none after it.

    A byte-level pre-tokenizer takes a blank with what follows, and no piece of the
    other vocabulary has a blank behind another character (``second_tokenizer``
    sees to that), so a text's tokens are those of its parts, each with its blank.
    """
    parts = text.split(" ")
    if all(x and not x[0].isspace() and not x[-1].isspace() for x in parts):
        return parts
    out = [parts[0]]
    for x in parts[1:]:
        if out[-1] and not out[-1][-1].isspace() and x and not x[0].isspace():
            out.append(x)
        else:
            out[-1] += " " + x
    return out


# white space beside a blank or at an end of a text: its parts by blanks aren't all chunks
_ODD = re.compile(r" \s|\s |\A\s|\s\Z")


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start[i]`` and the numbers after it, ``count[i]`` of them, one run after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class _Ragged:
    """Growing lists of numbers, many to be read at once."""

    def __init__(self, kind):
        self.flat, self.stop, self.used, self.n = np.zeros(1 << 12, kind), np.zeros(1 << 12, np.int64), 0, 0

    def extend(self, values: np.ndarray, count: np.ndarray) -> None:
        """Adds lists that stand one after the other."""
        if self.used + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(values)), self.flat.dtype)])
        if self.n + len(count) >= len(self.stop):
            self.stop = np.concatenate([self.stop, np.zeros(max(len(self.stop), len(count)), np.int64)])
        self.flat[self.used : self.used + len(values)] = values
        self.stop[self.n + 1 : self.n + 1 + len(count)] = self.used + np.cumsum(count)
        self.used, self.n = self.used + len(values), self.n + len(count)

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        return self.stop[numbers + 1] - self.stop[numbers]

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers one after the other, and how long each is."""
        count = self.sizes(numbers)
        return self.flat[_runs(self.stop[numbers], count)], count


class _Vocabulary:
    """The bytes of tokens by their ids, one after the other."""

    def __init__(self, table: list[bytes], size: np.ndarray):
        self.flat, self.size, self.start = np.frombuffer(b"".join(table), dtype=np.uint8), size, np.cumsum(size) - size

    def agrees(self, ids: np.ndarray, count: np.ndarray, raw: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the bytes of each list's tokens are those of its part of ``raw``."""
        size = self.size[ids]
        upto, ends = np.concatenate([[0], np.cumsum(size)]), np.cumsum(count)
        own = upto[ends] - upto[ends - count]
        ok, at = own == length, np.cumsum(length) - length
        said = self.flat[_runs(self.start[ids], size)]
        differs = np.concatenate([[0], np.cumsum(said[_runs((np.cumsum(own) - own)[ok], own[ok])] != raw[_runs(at[ok], length[ok])])])
        last = np.cumsum(length[ok])
        ok[ok] = differs[last] == differs[last - length[ok]]
        return ok


class _Memo:
    """Tokens of chunks met so far by both tokenizers, their links and groups; emptied once it holds some ``most`` characters, 50 and more for each chunk."""

    def __init__(self, first: str, second: str, most: int = 25_000_000):
        (self.encode, table_a, size_a), (self.sp, table_b, size_b) = first_tokenizer(first), second_tokenizer(second)
        self.bytes_a, self.bytes_b = _Vocabulary(table_a, size_a), _Vocabulary(table_b, size_b)
        self.wide, self.most = len(table_b), most
        self.clear()

    def clear(self) -> None:
        self.number, self.a, self.b, self.ok, self.held = {}, _Ragged(np.int32), _Ragged(np.int32), bytearray(), 0
        self.links, self.groups, self.said = _Ragged(np.int64), array("q"), []

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks of all texts by their numbers, and how many each text has; a text that is empty has none."""
        if self.held > self.most:
            self.clear()
        split, new, known = [], {}, self.number
        for text in texts:
            parts = (chunks(text) if _ODD.search(text) else text.split(" ")) if text else []
            new.update(dict.fromkeys([x for x in parts if x not in known]))
            split.append(parts)
        if new:
            self._learn(list(new))
        flat = array("q")
        for parts in split:
            flat.extend(map(known.__getitem__, parts))
        return np.array(flat, dtype=np.int64), np.array([len(x) for x in split], dtype=np.int64)

    def _first_ids(self, new: list[str], joined: int, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of new chunks and how many each has; the first ``joined`` are encoded as one text if its tokens end with them."""
        ids, count = [self.encode("".join([" " + x for x in new[:joined]]))], []
        ends, upto = np.cumsum(self.bytes_a.size[ids[0]]), np.cumsum(length[:joined])
        stop = np.searchsorted(ends, upto, "right")
        if len(ends) == (stop[-1] if joined else 0) and np.array_equal(ends[stop - 1], upto):
            count += np.diff(stop, prepend=0).tolist()
        else:
            ids, joined = [], 0
        ids += [self.encode(" " + x) for x in new[joined:]]
        count += map(len, ids[len(ids) - (len(new) - joined) :])
        return np.concatenate(ids).astype(np.int64), np.array(count, dtype=np.int64)

    def _learn(self, new: list[str]) -> None:
        outer = [x for x in new if x[:1].isspace() or x[-1:].isspace()]  # of a text's ends
        if outer:
            own = set(outer)
            new = [x for x in new if x not in own] + outer
        raw = [(" " + x).encode() for x in new]
        length, whole = np.array([len(x) for x in raw], dtype=np.int64), np.frombuffer(b"".join(raw), dtype=np.uint8)
        a, n_a = self._first_ids(new, len(new) - len(outer), length)
        lists = self.sp.encode(new, num_threads=1)
        b, n_b = np.fromiter(chain.from_iterable(lists), dtype=np.int64), np.array([len(x) for x in lists], dtype=np.int64)
        ok = self.bytes_a.agrees(a, n_a, whole, length) & self.bytes_b.agrees(b, n_b, whole, length)
        self.a.extend(a, n_a)
        self.b.extend(b, n_b)
        self._align(a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)], np.where(ok, length, 0))
        self.ok += ok.tobytes()
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.held += sum(map(len, new)) + 50 * len(new)

    def _align(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> None:
        """Links and groups of chunks, of which these are all tokens one after the other; ends count from the first chunk's start, and none is crossed."""
        size, end_b = self.bytes_a.size[a], np.cumsum(self.bytes_b.size[b])
        end_a, upto = np.cumsum(size), np.concatenate([[0], np.cumsum(length)])
        low, high = np.searchsorted(end_b, end_a - size, "right"), np.searchsorted(end_b, end_a, "left")
        count = high - low + 1
        before = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(end_a, upto, "right")]
        self.links.extend(np.repeat(a, count) * self.wide + b[_runs(low, count)], np.diff(before))
        shared = np.flatnonzero(end_b[high] == end_a)
        cut_a, cut_b, ids_a, ids_b = (shared + 1).tolist(), (high[shared] + 1).tolist(), list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups = [f"{ids_a[i] if j - i == 1 else ','.join(ids_a[i:j])}|{ids_b[k] if m - k == 1 else ','.join(ids_b[k:m])}" for i, j, k, m in zip([0, *cut_a], cut_a, [0, *cut_b], cut_b)]
        stop = np.searchsorted(end_a[shared], upto, "right")
        self.groups.frombytes(np.diff(stop).astype(np.int64).tobytes())
        stop = stop.tolist()
        self.said += [groups[i].encode() if j - i == 1 else ";".join(groups[i:j]).encode() for i, j in zip(stop, stop[1:])]


def aligned(docs: DataFrame, first: str, second: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of (doc_id, text): see ``ALIGNED``.

    A text has no tokens if it is null or empty, or if its tokens' bytes aren't a blank and the text.
    """
    names = [x.split()[0] for x in ALIGNED.split(", ")]

    def run(batches):
        memo = _memos.get((first, second)) or _memos.setdefault((first, second), _Memo(first, second))  # tasks of a worker share it
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            raw = texts_of(batch.column(1))
            for start, stop in blocks(raw, BLOCK):
                n = stop - start
                number, count = memo.numbers([str(x, "utf-8") for x in raw[start:stop]])
                text = np.repeat(np.arange(n), count)
                bad = np.zeros(n, dtype=bool)
                bad[text[np.frombuffer(memo.ok, dtype=np.uint8)[number] == 0]] = True
                number, text = number[~bad[text]], text[~bad[text]]
                total = lambda x: pa.array(np.bincount(text, weights=x, minlength=n).astype(np.int64))  # noqa: B023, E731
                links, per = memo.links.take(number)
                wide = memo.bytes_a.size.size * memo.wide
                key = np.sort(np.repeat(text, per) * wide + links)
                place = np.flatnonzero(np.diff(key, prepend=-1))
                times = np.diff(place, append=len(key)).astype(np.int32)
                pair, ends = key[place] % wide, np.searchsorted(key[place], np.arange(n + 1) * wide)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))  # noqa: B023, E731
                upto = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).tolist()
                said = map(memo.said.__getitem__, number.tolist())
                digest = [hashlib.sha256(b";".join([next(said) for _ in range(j - i)])).hexdigest() if j > i else "" for i, j in zip(upto, upto[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(at, at + n)), batch.column(0).slice(start, n), total(memo.a.sizes(number)), total(memo.b.sizes(number)), total(np.frombuffer(memo.groups, dtype=np.int64)[number]), total(per),
                    pa.array(digest, pa.string()), lists((pair // memo.wide << 32) | pair % memo.wide), lists(times),
                ], names)
                at += n

    return docs.select("doc_id", "text").mapInArrow(run, ALIGNED)


def align(docs: DataFrame, *, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model", hot: int = HOT_PAIRS) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (longs), groups_sha256.

    Texts that are null or empty, or that a tokenizer changes (by normalising, or
    a U+2581 that it takes for a blank), have no tokens: zeros and an empty string.
    Rows of one or of no doc_id are documents each, and count each. Of an A id's
    pairs, all that the most documents hold are its best. Further columns are
    ignored; an empty table gives an empty result.
    """
    with Scratch(docs.sparkSession) as scratch:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        rows = scratch.cut(aligned(docs, first, second))
        counts = scratch.cut(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")))
        own = F.shiftright("pair", 32)
        most = counts.groupBy(own.alias("a")).agg(F.max("docs").alias("most"))
        facts = scratch.cut(counts.withColumn("a", own).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))
        often = scratch.cut(facts.orderBy(F.desc("docs"), "pair").limit(hot), hot)
        each = rows.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
        near = each.join(F.broadcast(often), "pair")
        rare = facts.join(F.broadcast(often.select("pair")), "pair", "left_anti")
        far = each.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(rare, "pair")
        sums = lambda df: df.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
        both = sums(near.select("row", "times", "docs", "best").union(far.select("row", "times", "docs", "best")))
        out = rows.drop("pairs", "times").join(both, "row", "left")
        longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        return scratch.keep(out.select("doc_id", *longs, "groups_sha256"))
