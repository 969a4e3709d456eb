"""Words and hashes of Arrow text columns, as numpy arrays over blocks of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 20

_rng = np.random.default_rng(20240131)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_byte = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_byte_folded = _byte.copy()
_byte_folded[ord("A") : ord("Z") + 1] = _byte[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.full(4096, _BASE, dtype=np.uint64)
_STEP[0] = 1
POWERS = np.multiply.accumulate(_STEP)
_FAR = np.multiply(POWERS[-1:], _BASE)[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finisher)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def texts_of(column: pa.Array) -> list[memoryview]:
    """UTF-8 of each row without copies; null gives an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return []
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(data) if data is not None else memoryview(b"")
    ok = column.is_valid().to_numpy(zero_copy_only=False)
    return [data[a:b] if v else data[:0] for a, b, v in zip(at, at[1:], ok)]


def blocks(texts: list[memoryview], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents with about ``most`` bytes together."""
    a = size = 0
    for b, x in enumerate(texts):
        if b > a and size + len(x) > most:
            yield a, b
            a, size = b, 0
        size += len(x) + 1
    if a < len(texts):
        yield a, len(texts)


@dataclass
class Words:
    """Words of a block: ``first[i]:first[i + 1]`` are document i's."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    doc_at: np.ndarray


def words_of(texts: list[memoryview]) -> Words:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D; documents are parted by one blank."""
    buf = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    doc_at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=doc_at[1:])
    space = SPACE[buf]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buf) and not space[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    return Words(buf, starts, ends, np.searchsorted(starts, doc_at), doc_at)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes (A-Z counted as a-z if ``fold``); spans are ascending and not empty."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    table, lens, out = _byte_folded if fold else _byte, ends - starts, []
    a = 0
    while a < len(starts):  # some 2**18 bytes at a time, to bound what is held
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + (1 << 18))))
        n = lens[a:b]
        at = np.cumsum(n) - n
        pos = np.arange(int(n.sum())) - np.repeat(at, n)
        val = table[buf[np.repeat(starts[a:b], n) + pos]]
        if n.max() > len(POWERS):
            far = np.full(int(n.max()) // len(POWERS) + 1, _FAR, dtype=np.uint64)
            far[0] = 1
            val *= np.multiply.accumulate(far)[pos // len(POWERS)]
            pos %= len(POWERS)
        val *= POWERS[pos]
        out.append(np.add.reduceat(val, at))
        a = b
    return mix(np.concatenate(out))


def ngram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a document, and each document's first run (one more entry than documents).

    A document of 1 to n - 1 words gives its whole sequence as one run.
    """
    count = np.diff(first)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.zeros(len(runs) + 1, dtype=np.int64)
    np.cumsum(runs, out=at[1:])
    if not at[-1]:
        return np.zeros(0, dtype=np.uint64), at
    start = np.repeat(first[:-1], runs) + np.arange(at[-1]) - np.repeat(at[:-1], runs)
    padded = np.concatenate([words, np.zeros(n, dtype=np.uint64)])
    out = padded[start] * POWERS[1]
    for k in range(1, n):
        out += padded[start + k] * POWERS[k + 1]
    for d in np.flatnonzero((count > 0) & (count < n)):  # short: only its own words, and how many
        own = words[first[d] : first[d + 1]]
        out[at[d]] = np.uint64(len(own)) + (own * POWERS[1 : len(own) + 1]).sum(dtype=np.uint64)
    return mix(out), at


def kept(df: DataFrame, *new: str) -> list[Column]:
    """The columns of a table but those that new ones replace, whatever their case and the signs in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in new]
