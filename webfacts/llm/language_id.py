"""Language identification by interpolated Kneser-Ney character trigram models.

Gram counts of a bounded sample of each language's labelled documents become,
for each order, a sorted array of 64-bit gram codes with one row of
log-probabilities per gram, one column per language; a text gets the language of
the lowest cross-entropy per character. How far calibration documents of each
language stray from its mean sets the limit beyond which a text is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import Scratch
from .text import blocks, kept, texts_of

_SPACE = 32
#: Labelled rows of a language are counted by so many ranges of a hash, so that its first rows are found without sorting all of them.
BUCKETS = 4096
# Bits a character that documents differ by whatever their length, and that one character differs by (the limit is never tighter than with the first of each).
_STYLES, _NOISES = np.geomspace(0.4, 3.2, 25), np.geomspace(3.0, 24.0, 25)
_letters: np.ndarray | None = None


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, mod n; 0 for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def grams_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the last 1, 2 and 3 characters at each place of all texts, and each text's first place (one more entry).

    Characters are lower-cased; runs of anything but letters are one blank.
    """
    parts = [" " + str(x, "utf-8", "replace").lower() for x in texts]
    c = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), dtype=np.uint32).copy()
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    letter = letters()[c]
    c[~letter] = _SPACE
    start = np.zeros(len(c) + 1, dtype=bool)
    start[at[:-1]] = True
    start = start[:-1]
    keep = letter | start
    keep[1:] |= letter[:-1]
    first = np.concatenate([[0], np.cumsum(keep)])[at]
    c, start = c[keep].astype(np.uint64), start[keep]
    b, a = np.full(len(c), _SPACE, dtype=np.uint64), np.full(len(c), _SPACE, dtype=np.uint64)
    b[1:], a[2:] = c[:-1], c[:-2]
    b[start] = _SPACE
    a[start] = _SPACE
    a[1:][start[:-1]] = _SPACE
    two = (b << np.uint64(21)) | c
    use = ~start  # the blank before a text is context only
    first = np.concatenate([[0], np.cumsum(use)])[first]
    return c[use], two[use], ((a << np.uint64(42)) | two)[use], first


@dataclass
class Model:
    langs: list[str]
    keys: list[np.ndarray]  # sorted codes of orders 1, 2, 3
    logs: list[np.ndarray]  # log2 P of each, a column a language
    backs: list[np.ndarray]  # log2 of the weight left to shorter contexts, for orders 1 and 2 as contexts
    none: np.ndarray  # log2 P of a character never seen
    mean: np.ndarray
    limit: np.ndarray  # how many deviations above the mean a text may lie
    style: np.ndarray  # deviation of a document's bits a character that its length doesn't lessen
    noise: np.ndarray  # deviation of one character's bits, which does average out

    def far(self, lang: np.ndarray, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether texts of ``n`` characters lie beyond the limits of their languages (by number)."""
        return bits - self.mean[lang] > self.limit[lang] * np.sqrt(self.style[lang] ** 2 + self.noise[lang] ** 2 / np.maximum(n, 1))

    def score(self, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
        """log2 P of each place, a column a language."""
        out = np.empty((len(three), len(self.langs)), dtype=np.float32)
        i, hit = _find(self.keys[2], three)
        out[hit] = self.logs[2][i[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            out[miss] = self._back(1, three[miss] >> np.uint64(21)) + self._two(one[miss], two[miss])
        return out

    def _back(self, order: int, context: np.ndarray) -> np.ndarray:
        i, hit = _find(self.keys[order], context)
        return np.where(hit[:, None], self.backs[order][i], 0)

    def _two(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        i, hit = _find(self.keys[1], two)
        j, known = _find(self.keys[0], one)
        low = self._back(0, two >> np.uint64(21)) + np.where(known[:, None], self.logs[0][j], self.none)
        return np.where(hit[:, None], self.logs[1][i], low)


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return i, keys[i] == x


def kneser_ney(lang: np.ndarray, code: np.ndarray, count: np.ndarray, langs: list[str], discount: float = 0.75, alphabet: int = 1 << 12) -> Model:
    """A model of trigram counts (language number, code, count)."""
    mask = np.uint64((1 << 21) - 1)
    k3 = np.unique(code)
    k2 = np.unique(np.concatenate([k3 & np.uint64((1 << 42) - 1), k3 >> np.uint64(21)]))
    k1 = np.unique(np.concatenate([k2 & mask, k2 >> np.uint64(21)]))
    n = len(langs)
    c3 = np.zeros((len(k3), n))
    c3[np.searchsorted(k3, code), lang] = count
    seen = (c3 > 0).astype(float)

    def summed(keys: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), n))
        np.add.at(out, np.searchsorted(keys, at), values)
        return out

    def level(c: np.ndarray, context: np.ndarray, keys: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, kinds = summed(keys, context, c), summed(keys, context, (c > 0).astype(float))
        back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        at = np.searchsorted(keys, context)
        return np.maximum(c - discount, 0) / np.maximum(total[at], 1) + back[at] * low, back

    n2 = summed(k2, k3 & np.uint64((1 << 42) - 1), seen)  # how many characters stand before each bigram
    n1 = summed(k1, k2 & mask, (n2 > 0).astype(float))
    total = np.maximum(n1.sum(axis=0), 1)
    spare = discount * (n1 > 0).sum(axis=0) / total + 1e-9
    p1 = np.maximum(n1 - discount, 0) / total + spare / alphabet
    p2, back1 = level(n2, k2 >> np.uint64(21), k1, p1[np.searchsorted(k1, k2 & mask)])
    p3, back2 = level(c3, k3 >> np.uint64(21), k2, p2[np.searchsorted(k2, k3 & np.uint64((1 << 42) - 1))])
    log = lambda x: np.log2(np.maximum(x, 1e-30)).astype(np.float32)
    return Model(langs, [k1, k2, k3], [log(p1), log(p2), log(p3)], [log(back1), log(back2)], log(spare / alphabet), np.zeros(n), np.full(n, np.inf), np.full(n, _STYLES[0]), np.full(n, _NOISES[0]))


def _entropy(model: Model, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits a character by language, scored places and whether there is a letter, of each text."""
    one, two, three, first = grams_of(texts)
    total = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(model.score(one, two, three), axis=0, dtype=np.float64)])
    letter = np.concatenate([[0], np.cumsum(one != _SPACE)])
    n = np.diff(first)
    return -(total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)[:, None], n, letter[first[1:]] > letter[first[:-1]]


def deviations(off: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(style, noise) such that ``off`` of texts of ``n`` characters scatters by sqrt(style ** 2 + noise ** 2 / n).

    The likeliest pair of a grid under Student's t with 3 degrees of freedom, by
    which single mislabelled documents weigh little.
    """
    var = _STYLES[:, None, None] ** 2 + _NOISES[None, :, None] ** 2 / n
    cost = (0.5 * np.log(var) + 2 * np.log1p(off**2 / var / 3)).sum(axis=2)
    i, j = np.unravel_index(cost.argmin(), cost.shape)
    return float(_STYLES[i]), float(_NOISES[j])


def calibrate(model: Model, lang: np.ndarray, bits: np.ndarray, n: np.ndarray, least: int, slack: float, quantile: float = 0.9) -> None:
    """Sets mean, deviations and limits of a model by documents (language number, bits a character, characters).

    The mean is a median and the limit ``slack`` times a quantile of the
    deviations, so that no single document sets either. A language of fewer
    than ``least`` documents has the deviations of all languages together about
    its own mean, and one without any the highest mean of all.
    """
    known = np.unique(lang)
    if not len(known):
        return
    for k in known:
        model.mean[k] = np.median(bits[lang == k])
    model.mean[np.setdiff1d(np.arange(len(model.langs)), known)] = model.mean[known].max()
    off = bits - model.mean[lang]
    order = np.argsort(n, kind="stable")
    few = order[:: -(-len(order) // 4000)]  # all lengths alike; the fit of many languages together needs no more

    def fit(off: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
        style, noise = deviations(off, n)
        return style, noise, slack * max(float(np.quantile(off / np.sqrt(style**2 + noise**2 / n), quantile)), 1.5)

    together = fit(off[few], n[few])
    for k in range(len(model.langs)):
        own = lang == k
        model.style[k], model.noise[k], model.limit[k] = fit(off[own], n[own]) if own.sum() >= least else together


def labelled_sample(rows: DataFrame, per_lang: int, least: int) -> DataFrame:
    """(lang, text, calibrates) of the first ``per_lang`` rows of each language of (doc_id, lang, text), by a hash of doc_id.

    A fifth of a language's rows calibrates, but at least ``least`` or else half
    of them. All rows are counted, by language and range of the hash; only those
    up to the range where ``per_lang`` is reached are sorted.
    """
    h = F.xxhash64("doc_id")
    rows = rows.select("doc_id", "lang", "text", h.alias("h"), F.pmod(F.shiftright(h, 40), F.lit(BUCKETS)).alias("bucket"))
    by = Window.partitionBy("lang").orderBy("bucket")
    sizes = rows.groupBy("lang", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(by) - F.col("n"))
    last = sizes.where(F.col("before") < per_lang).groupBy("lang").agg(F.max("bucket").alias("last"), F.least(F.sum("n"), F.lit(per_lang)).alias("n"))
    first = rows.join(F.broadcast(last), "lang").where("bucket <= last")  # a row a language
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("bucket", "h", "doc_id", "text"))).where(F.col("nth") <= per_lang)
    own = F.least(F.floor(F.col("n") / 2), F.greatest(F.floor(F.col("n") / 5), F.lit(least)))
    # spread evenly over the rows: where nth * own / n reaches the next whole number
    return first.select("lang", "text", (F.floor(F.col("nth") * own / F.col("n")) > F.floor((F.col("nth") - 1) * own / F.col("n"))).alias("calibrates"))


def train(docs: DataFrame, *, per_lang: int = 1000, least: int = 20, folds: int = 3, held_out: int = 1, slack: float = 3.0) -> Model | None:
    """A model of every language that is labelled outside the held-out fold, of at most ``per_lang`` documents each.

    See ``labelled_sample`` for which documents train and calibrate it, and
    ``calibrate`` for the limits. None if no labelled document has a letter.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    with Scratch(docs.sparkSession) as scratch:
        return _trained(scratch.cut(labelled_sample(rows.select("doc_id", "lang", "text"), per_lang, least)), least, slack)


def _trained(sample: DataFrame, least: int, slack: float) -> Model | None:
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())

    def count(batches):
        for batch in batches:
            own, texts, cal = batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist()
            for lang in sorted(set(own)):
                mine = [x for x, y, z in zip(texts, own, cal) if y == lang and not z]
                for a, b in blocks(mine):
                    code, n = np.unique(grams_of(mine[a:b])[2], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], ["lang", "code", "n"])

    counts = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return None
    model = kneser_ney(np.searchsorted(langs, counts["lang"].to_numpy(str)), counts["code"].to_numpy().view(np.uint64), counts["n"].to_numpy(), langs)

    def measure(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in blocks(texts):
                bits, n, ok = _entropy(model, texts[a:b])
                own = np.searchsorted(langs, np.array(batch.column(0).slice(a, b - a).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(own[ok]), pa.array(bits[np.arange(b - a), own][ok]), pa.array(n[ok])], ["lang", "bits", "n"])

    seen = sample.where("calibrates").mapInArrow(measure, "lang long, bits double, n long").toPandas()
    calibrate(model, seen["lang"].to_numpy(), seen["bits"].to_numpy(), seen["n"].to_numpy(), least, slack)
    return model


def identify(docs: DataFrame, *, folds: int = 3, held_out: int = 1, **options) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, lang, ...) with held_out, lang_pred, lang_score, bits, rejected.

    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter,
    or if nothing is labelled; such texts and those beyond their language's
    limit are ``rejected``. ``lang_score`` is the share of the best language
    among all when each counts 2 ** -(bits * min(characters, 64)). Ties go to
    the first language by name. Texts of any length are scored whole. Repeated rows come back each; input columns of
    the same names as the new ones, in any case, are replaced; an empty table stays empty.
    """
    model = train(docs, folds=folds, held_out=held_out, **options)
    held = fold(F.col("doc_id"), folds) == held_out
    names = ["lang_pred", "lang_score", "bits", "rejected"]
    own = kept(docs, *names, "held_out")
    if model is None:
        return docs.select(*own, held.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(None).cast("double").alias("bits"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the grams of a bounded sample of each language
    rows = docs.select(*own, held.alias("held_out"))
    text_at, given = rows.columns.index("text"), rows.schema
    rows = rows.toDF(*map(str, range(len(given))))  # names that need no quoting, for the Arrow stage

    def run(batches):
        model = shared.value
        names_of = np.array([*model.langs, "und"], dtype=object)
        for batch in batches:
            texts = texts_of(batch.column(text_at))
            for a, b in blocks(texts):
                bits, n, ok = _entropy(model, texts[a:b])
                best = bits.argmin(axis=1)
                low = bits[np.arange(b - a), best]
                share = 1 / np.exp2(-(bits - low[:, None]) * np.minimum(n, 64)[:, None]).sum(axis=1)
                far = model.far(best, low, n)
                best[~ok] = len(model.langs)
                share[~ok] = 0
                new = [pa.array(names_of[best], pa.string()), pa.array(share), pa.array(low, mask=~ok), pa.array(far | ~ok)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *new], [*given.names, *names])

    schema = StructType([*given.fields, *StructType.fromDDL("lang_pred string, lang_score double, bits double, rejected boolean").fields])
    return rows.mapInArrow(run, schema)
