"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces are dealt to blocks of bounded size, and each block to several islands,
groups of their own to Spark. On an island a population of packings of the
block evolves: crossover injects whole well-filled bins of one parent into the
other, bins with pieces that are then double are dissolved, and displaced pieces
are put back best-fit by descending length. Between two spells the islands of a
block exchange their elites round a ring, through a written table; at last the
block takes the best packing of its islands. Between rounds, full bins are final
and the pieces of the others go to new blocks; after some rounds, all bins over
half are final, and the few pieces of the others go on until they are one block.
"""

from __future__ import annotations

import base64
import random
import re
import zlib
from array import array
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import map_groups
from .store import Scratch
from .text import texts_of

_encoders: dict[str, object] = {}


# before the last of several blanks that something follows; the blanks are those of Unicode, as the pattern has them
_BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LAST_BLANK = re.compile(f"(?<={_BLANK})(?={_BLANK}(?!{_BLANK})(?s:.))")


def _ids(encode, text: str) -> list[int]:
    """Ids by a pattern that ends with all blanks (``\\s+``) in place of one that first leaves the last of them to what follows.

    That one looks ahead, which makes matching slow. Parts that begin with such a
    last blank have the same matches by both, and most texts are one part.
    """
    if not _LAST_BLANK.search(text):
        return encode(text)
    return [i for part in _LAST_BLANK.split(text) for i in encode(part)]


def encoder(vocabulary: str):
    """A function from a text to its ids as a numpy array, of a tokenizers file; by its rank file beside it, if there is one, which is faster.

    Strings of special tokens in a text are ordinary text.
    """
    if vocabulary not in _encoders:
        import public_tokenizers

        try:
            import tiktoken

            path = public_tokenizers.path(vocabulary.removesuffix(".json") + ".tiktoken")
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            own, ahead = public_tokenizers.PATTERN, r"|\s+(?!\S)|\s+"
            parted = own.endswith(ahead)
            if parted:
                own = own.removesuffix(ahead) + r"|\s+"
            own = tiktoken.Encoding("own", pat_str=own, mergeable_ranks=ranks, special_tokens={})
            _encoders[vocabulary] = lambda x: np.array(array("I", _ids(own.encode_ordinary, x) if parted else own.encode_ordinary(x)))
        except (ImportError, FileNotFoundError):
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(public_tokenizers.path(vocabulary))
            whole.encode_special_tokens = True
            _encoders[vocabulary] = lambda x: np.array(whole.encode(x, add_special_tokens=False).ids, dtype=np.uint32)
    return _encoders[vocabulary]


def pieces(docs: DataFrame, *, vocabulary: str, end: int, capacity: int) -> DataFrame:
    """Of (doc_id, text): doc_id, piece, start, length, ids_crc32; a longer document's first piece takes what full ones leave."""

    def run(batches):
        encode, last = encoder(vocabulary), end.to_bytes(4, "little")
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids = encode(str(text, "utf-8")).astype("<u4", copy=False).tobytes() + last
                n = len(ids) // 4
                a, b, piece = 0, n % capacity or min(capacity, n), 0
                while a < n:
                    out.append((doc, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                    a, b, piece = b, b + capacity, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 5, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Bins:
    """A packing in the making: bins by their free space, for best fit in constant time."""

    def __init__(self, capacity: int, bins: list[list[int]] = (), free: list[int] = ()):
        self.capacity, self.bins, self.free, self.open, self.mask = capacity, list(bins), list(free), [[] for _ in range(capacity + 1)], 0
        for k, left in enumerate(self.free):
            self.open[left].append(k)
        for left in set(self.free):
            self.mask |= 1 << left

    def put(self, items: list[int], length: list[int]) -> _Bins:
        """Best fit of one piece after the other, in the order given."""
        bins, free, open_, mask = self.bins, self.free, self.open, self.mask
        for i in items:
            n = length[i]
            fit = mask >> n
            if fit:
                left = n + (fit & -fit).bit_length() - 1
                k = open_[left].pop()
                if not open_[left]:
                    mask ^= 1 << left
                bins[k].append(i)
                left -= n
                free[k] = left
            else:
                k, left = len(bins), self.capacity - n
                bins.append([i])
                free.append(left)
            open_[left].append(k)
            mask |= 1 << left
        self.mask = mask
        return self

    def worth(self) -> tuple[int, float]:
        """Less is better: the number of bins, then how evenly they are filled."""
        return len(self.bins), -sum([((self.capacity - x) / self.capacity) ** 2 for x in self.free])


def _descending(items: list[int], length: list[int]) -> list[int]:
    return sorted(items, key=lambda i: (-length[i], i))


def _packing(bins: list[list[int]], length: list[int], capacity: int) -> _Bins:
    return _Bins(capacity, bins, [capacity - sum([length[i] for i in x]) for x in bins])


def best_fit(length: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, best-fit by descending length."""
    return _Bins(capacity).put(_descending(list(range(len(length))), length), length).bins


def least_bins(length: list[int], capacity: int) -> int:
    """A number that no packing goes below: pieces over half a bin each need their own, and small ones what room is left.

    For every t, pieces over capacity - t leave no room for those of t or more.
    """
    x = np.sort(np.asarray(length, dtype=np.int64))
    before = np.concatenate([[0], np.cumsum(x)])
    t = np.concatenate([[0], np.unique(x[2 * x <= capacity])])
    half, top, small = np.searchsorted(x, capacity // 2, "right"), np.searchsorted(x, capacity - t, "right"), np.searchsorted(x, t)
    top = np.maximum(top, half)  # pieces from ``half`` to ``top`` share their bins with small ones
    room = (top - half) * capacity - (before[top] - before[half])
    return int(np.max(len(x) - half + np.maximum(0, -(-(before[half] - before[np.minimum(small, half)] - room) // capacity))))


def _fuller(bins: list[list[int]], free: list[int], loose: list[int], length: list[int]) -> list[int]:
    """Exchanges pieces of bins with longer loose ones that still fit, the closest fit first; what is loose then.

    Each exchange makes a bin fuller and the loose pieces shorter, so it ends.
    """
    short = [k for k, left in enumerate(free) if left]
    item = [i for k in short for i in bins[k]]
    ends = np.cumsum([0, *[len(bins[k]) for k in short]])
    home, bounds = np.repeat(np.arange(len(short)), np.diff(ends)).tolist(), ends.tolist()
    size = np.array([length[i] for i in item], dtype=np.int64)
    most = size + np.repeat(np.array([free[k] for k in short], dtype=np.int64), np.diff(ends))  # the longest piece that could take its place
    place = np.arange(len(item))
    rank = (most << 44) | (size << 24) | place
    queue, out, top = sorted([(length[i], i) for i in loose]), [], int(most.max(initial=0))  # exchanges make ``most`` no larger
    while queue:
        n, i = queue.pop()
        if n > top:
            out.append(i)
            continue
        fits = rank[(size < n) & (most >= n)]
        if not len(fits):
            out.append(i)
            continue
        at = int(fits.min()) & 0xFFFFFF
        given, own = item[at], short[home[at]]
        bins[own][bins[own].index(given)] = i
        free[own] -= n - length[given]
        item[at], size[at] = i, n
        all_ = slice(bounds[home[at]], bounds[home[at] + 1])
        most[all_] = size[all_] + free[own]
        rank[all_] = (most[all_] << 44) | (size[all_] << 24) | place[all_]
        insort(queue, (length[given], given))
    return out


def cross(a: _Bins, b: _Bins, length: list[int], rng: random.Random) -> _Bins:
    """The second parent with whole well-filled bins of the first; what is then double or displaced is put back best-fit.

    Some of the emptiest bins are dissolved too. Before they are put back,
    displaced pieces are exchanged with shorter ones where that fills a bin.
    """
    few = a.capacity - 0.99 * a.capacity
    full = [k for k, left in enumerate(a.free) if left <= few] or sorted(range(len(a.bins)), key=a.free.__getitem__)[: max(1, len(a.bins) // 4)]
    given = rng.sample(full, rng.randint(1, max(1, len(full) // 2)))
    inside = {i for k in given for i in a.bins[k]}
    stay, free, loose = [list(a.bins[k]) for k in given], [a.free[k] for k in given], []
    for x, left in zip(b.bins, b.free):
        if inside.isdisjoint(x):
            stay.append(list(x))
            free.append(left)
        else:
            loose += [i for i in x if i not in inside]
    order = sorted(range(len(stay)), key=free.__getitem__)
    gone = max(0, len(order) - rng.randint(1, 4))
    for k in order[gone:]:
        loose += stay[k]
    stay, free = [stay[k] for k in order[:gone]], [free[k] for k in order[:gone]]
    loose = _fuller(stay, free, loose, length)
    if rng.random() < 0.5:
        loose = _descending(loose, length)
    else:  # displaced pieces in another order
        rng.shuffle(loose)
    return _Bins(a.capacity, stay, free).put(loose, length)


def evolve(length: list[int], capacity: int, *, elites: list[list[list[int]]] = (), population: int = 6, generations: int | None = None, seed: int = 0) -> list[list[int]]:
    """The best packing of a population that starts with ``elites``, or else with best fit by descending length, and best fit in random orders.

    It ends where a packing has no more bins than the lengths admit (``least_bins``).
    Unless ``generations`` is given, they are as many as put back some 24,000 pieces, six at least.
    """
    generations = max(6, 24_000 // max(1, len(length))) if generations is None else generations
    rng, every = random.Random(seed), list(range(len(length)))
    pop = [_packing(x, length, capacity) for x in elites or [best_fit(length, capacity)]]
    least = least_bins(length, capacity)
    while len(pop) < population and min(len(x.bins) for x in pop) > least:
        rng.shuffle(every)
        pop.append(_Bins(capacity).put(every, length))
    pop = [(x.worth(), x) for x in pop]
    for _ in range(generations):
        pop.sort(key=lambda x: x[0])
        if pop[0][0][0] <= least or len(pop) < 3:
            break
        # both orders of a pair, each in place of a worse one
        one, other = pop[0][1], rng.choice(pop[1:])[1]
        for k, child in ((-1, cross(one, other, length, rng)), (-2, cross(other, one, length, rng))):
            pop[k] = min((child.worth(), child), pop[k], key=lambda x: x[0])
    return min(pop, key=lambda x: x[0])[1].bins


def _bins_of(numbers: list[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(numbers):
        bins.setdefault(k, []).append(i)
    return list(bins.values())


def _spell(rows: DataFrame, capacity: int, islands: int, blocks: int, spell: int, options: dict) -> DataFrame:
    """(block, island, item, length, bin, bins, worth) of (block, island, item, length, own, guest): each island's elite after some generations.

    ``own`` and ``guest`` number the bins of the island's elite so far and of its neighbour's, null in the first spell.
    """

    def run(table: pa.Table) -> pa.RecordBatch:
        key, item, length = (table.column(c).to_numpy() for c in ("group", "item", "length"))
        before = [np.asarray(table.column(c).fill_null(-1)) for c in ("own", "guest")]
        out = [(np.zeros(0, np.int64),) * 6 + (np.zeros(0),)]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        for a, b in zip(starts, np.append(starts[1:], len(key))):
            order = a + np.argsort(item[a:b])
            own = length[order].tolist()
            elites = [_bins_of(x[order].tolist()) for x in before if len(x) and x[a] >= 0]
            bins = evolve(own, capacity, elites=elites, seed=int(key[a]) * 31 + spell, **options)
            number = np.zeros(b - a, dtype=np.int64)
            for k, members in enumerate(bins):
                number[members] = k
            count, even = _packing(bins, own, capacity).worth()
            same = np.ones(b - a, dtype=np.int64)
            out.append((same * (key[a] // islands), same * (key[a] % islands), item[order], length[order], number, same * count, same * even))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["block", "island", "item", "length", "bin", "bins", "worth"])

    rows = rows.select((F.col("block") * islands + F.col("island")).alias("group"), "item", "length", "own", "guest")
    schema = "block long, island long, item long, length long, bin long, bins long, worth double"
    return map_groups(rows, "group", run, schema, parts=min(blocks * islands, 10_000))


def _blocks(items: DataFrame, scratch: Scratch, capacity: int, blocks: int, turn: int, islands: int, spells: int, options: dict) -> DataFrame:
    """(item, length, bin, used, place) of (item, length): the best packing of each block's islands."""
    none = F.lit(None).cast("long")
    rows = items.withColumn("block", F.pmod(F.xxhash64(F.lit(turn), "item"), F.lit(blocks)).cast("long")).withColumn("island", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(islands - 1).cast("long"))))
    state = None
    for spell in range(spells):
        if state is None:
            now = rows.withColumn("own", none).withColumn("guest", none)
        else:  # each island gets the elite of the one before it in the ring
            guests = state.select(F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "item", F.col("bin").alias("guest"))
            now = state.withColumnRenamed("bin", "own").join(guests, ["item", "island"])
        before, state = state, scratch.cut(_spell(now, capacity, islands, blocks, spell, options))
        scratch.free(before)
    best = state.groupBy("block").agg(F.min(F.struct("bins", "worth", "island")).alias("best")).select("block", "best.island")
    state = state.join(best, ["block", "island"])
    own = Window.partitionBy("block", "bin")
    before = F.sum("length").over(own.orderBy("item").rowsBetween(Window.unboundedPreceding, -1))
    return state.select("item", "length", (F.lit(turn << 56) + F.col("block") * (1 << 20) + F.col("bin")).alias("bin"), F.sum("length").over(own).alias("used"), F.coalesce(before, F.lit(0)).alias("place"))


def pack(docs: DataFrame, *, vocabulary: str = "byte_bpe_50k.json", end: int = 2, capacity: int = 1024, island_rows: int = 4000, rounds: int = 3, islands: int = 3, spells: int = 2, **options) -> DataFrame:
    """One row per piece of (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A block has some ``island_rows`` pieces and is packed by ``islands`` islands
    in ``spells`` spells; for ``rounds`` rounds only full bins settle, then those
    over half. Further options are those of ``evolve``.
    A document is its ids and ``end``; a null or empty text is ``end`` alone.
    Only documents of more than ``capacity`` ids are cut. Repeated rows are
    packed each; further columns are ignored; an empty table gives an empty
    result. Pieces lie in their sequence from offset 0 without gaps.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        rows = scratch.cut(pieces(rows, vocabulary=vocabulary, end=end, capacity=capacity))
        rows = scratch.cut(rows.withColumn("item", F.monotonically_increasing_id()))
        left, done = rows.where(F.col("length") < capacity).select("item", "length"), []
        turn = 0
        while True:
            turn += 1
            n = left.count() if turn > 1 else scratch.rows(rows)
            # light bins hold fewer pieces than ``capacity``, so their number shrinks while blocks are larger
            block = island_rows if turn < rounds else max(island_rows, 2 * capacity)
            packed = scratch.cut(_blocks(left, scratch, capacity, max(1, -(-n // block)), turn, islands, spells, options), n)
            if n <= block:
                done.append(packed)
                break
            settled = F.col("used") == capacity if turn < rounds else 2 * F.col("used") > capacity
            done.append(packed.where(settled))
            left = packed.where(~settled).select("item", "length")
        placed = done[0]
        for x in done[1:]:
            placed = placed.union(x)
        small = rows.where(F.col("length") < capacity).join(placed.select("item", F.col("bin").alias("sequence_id"), F.col("place").alias("offset")), "item")
        whole = rows.where(F.col("length") == capacity).withColumn("sequence_id", F.col("item")).withColumn("offset", F.lit(0).cast("long"))
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        return scratch.keep(small.select(*names).union(whole.select(*names)))
