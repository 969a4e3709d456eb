"""Quality rules with host verdicts.

Rules run on whole texts in one pass. Failures are counted by host, each host's
failure rate is shrunk towards all hosts' by a beta prior fitted to their rates
(method of moments), and the verdict on the host goes back to its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .text import SPACE, blocks, mix, ngram_hashes, span_hashes, texts_of, words_of

_SYMBOLS = np.zeros(256, dtype=np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_POINTS = np.array([0 if SPACE[b] or 0x80 <= b < 0xC0 else 1 for b in range(256)], dtype=np.int64)
_BLANKS = b" \t\r\v\f"


def _dup_lines(text: memoryview) -> int:
    lines = [x for x in bytes(text).split(b"\n") if x.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def _repeated(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each document, the words that lie in a 3-word window found twice or more in it."""
    n = len(first) - 1
    long = np.diff(first) >= 3
    grams, at = ngram_hashes(words, first, 3)
    doc = np.repeat(np.arange(n), np.diff(at))
    keep = long[doc]
    start = np.repeat(first[:-1], np.diff(at)) + np.arange(len(grams)) - np.repeat(at[:-1], np.diff(at))
    grams, doc, start = grams[keep], doc[keep], start[keep]
    keys = mix(grams ^ mix(doc.astype(np.uint64) + np.uint64(1)))  # equal windows of different documents differ
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    marked = np.zeros(len(words) + 1, dtype=np.int64)
    for k in range(3):
        marked[start[again] + k] = 1
    total = np.concatenate([[0], np.cumsum(marked)])
    return total[first[1:]] - total[first[:-1]]


def features(docs: DataFrame, host: str = "source") -> DataFrame:
    """Of (doc_id, text, host): doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(2))
            for a, b in blocks(texts):
                w = words_of(texts[a:b])
                n = np.diff(w.first)
                sums = []
                for table in (_POINTS, _SYMBOLS):
                    total = np.concatenate([[0], np.cumsum(table[w.buf])])
                    sums.append(total[w.doc_at[1:]] - total[w.doc_at[:-1]])
                rep = _repeated(span_hashes(w.buf, w.starts, w.ends, fold=False), w.first)
                dup = np.array([_dup_lines(x) for x in texts[a:b]], dtype=np.int64)
                failed = (n < 50) | (100 * rep > 50 * n)
                own = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)]
                yield pa.RecordBatch.from_arrays(
                    [*own, *map(pa.array, (n.astype(np.int64), *sums, dup, rep, failed))],
                    ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")


def host_verdicts(rows: DataFrame) -> DataFrame:
    """(host, host_rows, host_failed, host_rate) of rows (host, failed); host_rate is the posterior mean.

    The prior is a beta one, by moments: m is the mean of all rows, and of the
    variance of hosts' rates (weighted by rows) the part that chance alone gives
    rates of so few rows, hosts / rows of m (1 - m), is taken off. What is left,
    as a share r of m (1 - m), makes a strength of 1 / r - 1 rows. With one host,
    or rates that differ no more than by chance, it is at its bound of 1000
    rows; the other bound is 1.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_rows"), F.sum(F.col("failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_rows")
    moments = hosts.agg(
        (F.sum("host_failed") / F.sum("host_rows")).alias("m"), (F.count("*") / F.sum("host_rows")).alias("chance"),
        (F.sum(F.col("host_rows") * rate * rate) / F.sum("host_rows")).alias("second"))
    spread, all_ = F.col("second") - F.col("m") * F.col("m"), F.greatest(F.col("m") * (1 - F.col("m")), F.lit(1e-9))
    share = F.greatest((spread / all_ - F.col("chance")) / F.greatest(1 - F.col("chance"), F.lit(1e-9)), F.lit(1e-9))
    moments = moments.select("m", F.least(F.greatest(1 / share - 1, F.lit(1.0)), F.lit(1000.0)).alias("strength"))
    # one row of moments, whatever the input
    return hosts.crossJoin(F.broadcast(moments)).select(
        "host", "host_rows", "host_failed", ((F.col("host_failed") + F.col("m") * F.col("strength")) / (F.col("host_rows") + F.col("strength"))).alias("host_rate"))


def judge(docs: DataFrame, *, host: str = "source", host_limit: float = 0.6, symbols: float = 0.1, dup_lines: int = 5) -> DataFrame:
    """One row per row of (doc_id, text, host): the features, failed, host_rate, kept.

    A document fails by the base rules (under 50 words, or over half of them in
    repeated windows), by more than ``symbols`` symbols a word character, or by
    at least ``dup_lines`` repeated lines. It is kept if it passes and its
    host's shrunk failure rate is under ``host_limit``. Null text: no words, so
    it fails. Documents without a host share one. Repeated rows count and come
    back each; an empty table gives an empty result.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = features(docs, host)
        own = F.col("base_failed") | (F.col("n_symbols") > symbols * F.col("word_chars")) | (F.col("n_dup_lines") >= dup_lines)
        rows = scratch.keep(rows.withColumn("failed", own))
        verdicts = host_verdicts(rows).withColumnRenamed("host", "_host")
        out = rows.join(verdicts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
        return out.withColumn("kept", ~F.col("failed") & (F.col("host_rate") < host_limit))
