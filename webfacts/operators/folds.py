"""Folds over the rows of a key in order, for keys of any length: runs are folded apart, then put together.

A log is dealt by ranges of key, order and value, so that a long key lies in many
tasks. What a run of rows does to any state is summed up in a few numbers; only
these summaries of a key come together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a run.
RUN = 10_000
#: Rows after which a run's state is one of few, whatever it was before: 0.7 ** 64 of all integers of 32 bits is under one.
HEAD = 64
#: A run's number is that of its task and its place there; each level of the tree drops so many bits.
BITS, LEVELS = 11, 5
#: Beyond these a factor makes no difference to a delay between its bounds.
LEAST, MOST = 1e-100, 1e100


def _runs(log: DataFrame, key: str, order: str, value: Column, summed: Callable[[list], tuple], kinds: dict[str, pa.DataType], most: int) -> DataFrame:
    """(key, run, *kinds): a row for each run of at most ``most`` rows of a key, in order, summed up by ``summed``."""
    rows = log.select(F.col(key).alias("_key"), F.col(order).alias("_order"), value.alias("_value"))
    rows = rows.repartitionByRange("_key", "_order", "_value").sortWithinPartitions("_key", "_order", "_value")
    # the first place of a task's rows numbers the task
    rows = rows.select("_key", "_value", F.monotonically_increasing_id().alias("_at"))
    kind, spelled = rows.schema["_key"].dataType.simpleString(), {pa.int32(): "int", pa.float64(): "double", pa.list_(pa.int32()): "array<int>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, values, at, schema = None, [], None, None
        for batch in batches:
            done, schema = [], batch.schema
            for k, x, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if values and (k != key or len(values) == most):
                    done.append((key, at, *summed(values)))
                    values = []
                if not values:
                    key, at = k, place
                values.append(x)
            yield table(done, schema)
        if values:
            yield table([(key, at, *summed(values))], schema)

    def table(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        types = [schema.field(0).type, pa.int64(), *kinds.values()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done) if done else [()] * len(types), types)], ["_key", "run", *kinds])

    return rows.mapInArrow(run, f"_key {kind}, run long, " + ", ".join(f"{c} {spelled[k]}" for c, k in kinds.items()))


def smoothed(average: int | None, latency: int | None) -> int | None:
    """The next average: the latency itself after 0, which counts as unset; else whole parts of 0.7 old + 0.3 new; null once anything is null."""
    return latency if average == 0 else None if average is None or latency is None else math.floor(average * 0.7 + latency * 0.3)


def reached(head: list[int | None]) -> set[int | None]:
    """States that a run may be in after its first HEAD rows, and perhaps some more, whatever it began with.

    A step keeps the order of states other than 0, so all of them stay between the
    least and the greatest one, which come nearer by three tenths each time.
    """
    points, span = {0, None}, (-(2**31), 2**31 - 1)
    for x in head:
        new = {smoothed(a, x) for a in points}
        if span is not None:
            if x is None:
                span, _ = None, new.add(None)
            else:
                if span[0] <= 0 <= span[1]:
                    new.add(x)
                span = tuple(math.floor(a * 0.7 + x * 0.3) for a in span)
                if span[1] - span[0] <= HEAD:
                    new.update(range(span[0], span[1] + 1))
                    span = None
        points = new
    return points


def _through(states: list, values: list) -> list:
    """What each of some states is after all values; states that meet go on as one."""
    now, of = states, list(range(len(states)))
    for n, x in enumerate(values):
        if len(now) == 1:
            one = now[0]
            for y in values[n:]:
                one = smoothed(one, y)
            now = [one]
            break
        now = [smoothed(a, x) for a in now]
        if len(different := list(dict.fromkeys(now))) < len(now):
            place = {a: i for i, a in enumerate(different)}
            of, now = [place[now[i]] for i in of], different
    return [now[i] for i in of]


def _effect(values: list) -> tuple[list, list, list]:
    """A run as its first rows, the states that these can lead to, and where the other rows take each of them."""
    head, tail = values[:HEAD], values[HEAD:]
    if not tail:
        return head, [], []
    states = list(reached(head))
    return head, states, _through(states, tail)


def latency_average(log: DataFrame, key: str, latency: str, order: str, run: int = RUN) -> DataFrame:
    """(key, avg_latency): the first latency as it is, then whole parts of 0.7 old + 0.3 new; 0 counts as unset.

    A null latency makes the average null. Rows of one place come by latency. A
    run of ``run`` rows becomes its first 64 rows and a table of the few states
    after them, for the other rows forget where they began but for some units; a
    key's runs then come together in order, one at a time. An empty log gives an
    empty result.
    """
    ints = pa.list_(pa.int32())
    effects = _runs(log, key, order, F.col(latency).cast("int"), _effect, {"head": ints, "states": ints, "results": ints}, max(run, HEAD))
    effects = effects.repartition("_key").sortWithinPartitions("_key", "run")
    kind = effects.schema["_key"].dataType.simpleString()

    def fold(batches):
        began, last, average, schema = False, None, 0, None
        for batch in batches:
            done, schema = [], batch.schema
            for k, head, states, results in zip(*(batch.column(c).to_pylist() for c in ("_key", "head", "states", "results"))):
                if began and k != last:
                    done.append((last, average))
                if not began or k != last:
                    began, last, average = True, k, 0
                for x in head:
                    average = smoothed(average, x)
                if states:
                    average = results[states.index(average)]
            yield table(done, schema)
        if began:
            yield table([(last, average)], schema)

    def table(done, schema):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], schema.field(0).type), pa.array([x[1] for x in done], pa.int32())], [key, "avg_latency"])

    return effects.mapInArrow(fold, f"`{key}` {kind}, avg_latency int")


def adaptive_delay(log: DataFrame, key: str, status: str, order: str, default: float, most: float = 30.0, run: int = RUN) -> DataFrame:
    """(key, delay): 429 and 503 double the delay up to ``most``, 200 lets it decay by a tenth to the default.

    A run of steps is one map x -> greatest(lo, least(hi, k * x)), and so are two
    of them after each other. Runs of at most ``run`` rows become one map each;
    maps of neighbouring runs of a key are composed level by level, at most 2,048
    at a time, until a key has one. Rows of one place come by status. Products of k
    may differ from single steps in the last bits. An empty log gives an empty result.
    """

    def effect(values: list) -> tuple[float, float, float]:
        k, lo, hi = 1.0, -math.inf, math.inf
        for x in values:
            if x in (429, 503):
                k, lo, hi = min(k * 2, MOST), min(lo * 2, most), min(hi * 2, most)
            elif x == 200:
                k, lo, hi = max(k * 0.9, LEAST), max(lo * 0.9, default), max(hi * 0.9, default)
        return k, lo, hi

    maps = _runs(log, key, order, F.col(status), effect, {"k": pa.float64(), "lo": pa.float64(), "hi": pa.float64()}, run)
    same = F.struct(F.lit(1.0).alias("k"), F.lit(-math.inf).alias("lo"), F.lit(math.inf).alias("hi"))

    def then(m: Column, x: Column) -> Column:
        bound = lambda d: F.greatest(x["lo"], F.least(x["hi"], x["k"] * d))
        return F.struct(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), m["k"] * x["k"])).alias("k"), bound(m["lo"]).alias("lo"), bound(m["hi"]).alias("hi"))

    for _ in range(LEVELS):
        maps = maps.groupBy("_key", F.shiftright("run", BITS).alias("run")).agg(F.array_sort(F.collect_list(F.struct(F.col("run").alias("at"), "k", "lo", "hi"))).alias("maps"))
        maps = maps.select("_key", "run", F.aggregate("maps", same, then).alias("m")).select("_key", "run", "m.*")
    delay = F.greatest("lo", F.least("hi", F.col("k") * float(default)))
    return maps.select(F.col("_key").alias(key), delay.alias("delay"))
