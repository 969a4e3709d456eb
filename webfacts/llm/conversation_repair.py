"""Repair of conversations by the cheapest edits, a dynamic program over all conversations at once.

A conversation must read, by the initials of its roles, ``(s?(ua)+)?``. Its state is
what has been read so far: nothing, a system turn, a user turn, an assistant turn.
Conversations of like length lie in one tensor, turn by state by conversation; costs
to the end are computed turn after turn from the last one, for all of them together,
and are kept; then edits are traced from the first turn, again for all together.

The programme reads one byte a turn. Texts pass once more in order, after their
conversation's edits, for the hash of what is repaired. SHA-256 can't be computed in
parts, so a conversation's turns pass through one task, one after the other, of which
no more than a byte a turn is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = ["user", "assistant"]
#: States: nothing, after system, after user, after assistant. Where a turn of initial s, u, a leads (-1: nowhere), and the role that is due.
NEXT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
DUE = np.array([2, 2, 3, 2])
FINAL = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
FAR = np.int64(1) << 50
#: A turn's byte is its initial (s, u, a, other) and four times its fault (none, blank, duplicate, truncated).
NONE, BLANK, DUPLICATE, CUT = range(4)
#: Turns of one tensor, padding included.
CELLS = 1 << 20


def damaged(rows: DataFrame, key: Column) -> DataFrame:
    """(conv_id, turn, role, text, hit) with faults put in by ``key``, a number of each row: modulo 20, 0 drops it, 1 empties it, 2 takes its end marks, 3 repeats it, 4 makes it the user's."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    hit = F.pmod(key, F.lit(20)).cast("int")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), hit.alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("role", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")))


def turn_key() -> Column:
    """CRC-32 of ``conv_id:turn``, a blank for what is null."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary"))


def flagged(rows: DataFrame) -> DataFrame:
    """Adds ``digest`` (of the text), ``again`` (role and text stood earlier in the conversation) and ``code``, a turn's byte."""
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    w = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("again", F.row_number().over(w) > 1)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(blank, BLANK).when(F.col("again"), DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(NONE)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return rows.withColumn("code", (code + 4 * fault).cast("int"))


def plan(codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs and edits of conversations: ``codes`` is turn by conversation, ``length`` their number of turns (rows beyond it are padding).

    Edits are letters in slots, three for each turn (two insertions before it and
    its own) and two at the end; 0 is none. Of equally cheap edits the letters
    are the least in ASCII.
    """
    turns, n = codes.shape
    costs = np.empty((turns + 1, 4, n), dtype=np.int64)
    costs[turns] = FINAL[:, None]
    initial, fault = codes & 3, codes >> 2
    gone, extra = (fault == BLANK) | (fault == DUPLICATE), np.where(fault == CUT, TRUNCATED, 0)
    stop, every = np.where(gone, FAR, 0), np.arange(n)

    def own(t: int, q: int | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What deleting, keeping and reroling turn t in state q cost to the end."""
        after, to = costs[t + 1], NEXT[q, initial[t]]
        at = np.broadcast_to(q, n)
        keep = np.where(to < 0, FAR, after[to, every]) + KEEP + extra[t] + stop[t]
        return after[at, every] + DELETE, keep, after[DUE[at], every] + REROLE + extra[t] + stop[t]

    for t in range(turns - 1, -1, -1):
        least = np.stack([np.minimum.reduce(own(t, q)) for q in range(4)])
        once = np.minimum(least, INSERT + least[DUE])
        twice = np.minimum(once, INSERT + once[DUE])
        costs[t] = np.where(t < length, twice, costs[t + 1])
    edits = np.zeros((3 * turns + 2, n), dtype=np.uint8)
    state = np.zeros(n, dtype=np.int64)
    for t in range(turns + 1):
        rest = t < length if t < turns else np.zeros(n, dtype=bool)
        for slot in range(2):
            now = costs[t, state, every]
            put = INSERT + costs[t, DUE[state], every] == now
            if t < turns:
                put &= rest & (own(t, state)[0] != now)  # a deletion comes first
            else:
                put &= now > 0
            edits[3 * t + slot, put] = ord("I")
            state = np.where(put, DUE[state], state)
        if t < turns:
            now = costs[t, state, every]
            delete, keep, _ = own(t, state)
            kind = np.where(delete == now, ord("D"), np.where(keep == now, ord("K"), ord("R")))
            edits[3 * t + 2, rest] = kind[rest]
            to = np.where(kind == ord("D"), state, np.where(kind == ord("K"), NEXT[state, initial[t]], DUE[state]))
            state = np.where(rest, to, state)
    return costs[0, 0], edits


def _plans(whole: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int, str]]:
    """blank, duplicate, truncated, illegal, cost, audit of each conversation's codes, those of like length together."""
    out: list = [None] * len(whole)
    length = np.array([len(x) for x in whole], dtype=np.int64)
    order = np.argsort(length, kind="stable")
    a = 0
    while a < len(order):
        wide = 1 << max(0, int(length[order[a]] - 1)).bit_length()  # lengths up to the next power of two
        b = int(np.searchsorted(length[order], wide, side="right"))
        b = min(b, a + max(1, CELLS // wide))
        mine = order[a:b]
        codes = np.zeros((int(length[mine].max()), len(mine)), dtype=np.int64)
        for k, i in enumerate(mine):
            codes[: len(whole[i]), k] = whole[i]
        cost, edits = plan(codes, length[mine])
        inside = np.arange(len(codes))[:, None] < length[mine]
        fault = np.where(inside, codes >> 2, NONE)
        initial = codes & 3
        pair = np.where(inside[1:], 4 * initial[:-1] + initial[1:], 1)
        bad = ~np.isin(pair, (1, 4 * 1 + 2, 4 * 2 + 1))
        for k, i in enumerate(mine):
            own = edits[:, k]
            out[i] = (*(int((fault[:, k] == f).sum()) for f in (BLANK, DUPLICATE, CUT)), int(bad[:, k].sum()), int(cost[k]), own[own > 0].tobytes().decode())
        a = b
    return iter(out)


_PLAN = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _planned(rows: DataFrame) -> DataFrame:
    """(conv_id, counts, cost, audit) of (conv_id, code) rows in order; only the bytes of a conversation are held."""

    def run(batches):
        ids, whole, held = [], [], 0
        last, began, parts = None, False, []
        schema = None

        def close():
            ids.append(last)
            whole.append(np.concatenate(parts))

        def out():
            kinds = [pa.int64()] * 5 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), *(pa.array(x, k) for x, k in zip(zip(*_plans(whole)) if whole else [()] * 6, kinds))], [schema.field(0).name, *(x.split()[0] for x in _PLAN.split(", "))])

        for batch in batches:
            schema = batch.schema
            keys, codes = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.uint8)
            a = 0
            while a < len(keys):
                b = a + 1
                while b < len(keys) and keys[b] == keys[a]:
                    b += 1
                if began and keys[a] != last:
                    close()
                    held, parts = held + len(whole[-1]), []
                    if held > CELLS:
                        yield out()
                        ids, whole, held = [], [], 0
                began, last = True, keys[a]
                parts.append(codes[a:b])
                a = b
        if began:
            close()
            yield out()

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, {_PLAN}")


class _Repair:
    """The hash of one conversation's repaired turns, as its edits and then its turns come by."""

    def __init__(self, audit: str):
        self.edits, self.at, self.state, self.sum, self.first = audit, 0, 0, hashlib.sha256(), True

    def _add(self, role: str, text: bytes) -> None:
        self.sum.update(b"" if self.first else b"\n")
        self.first = False
        self.sum.update(role.encode() + b":")
        self.sum.update(text)

    def inserted(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self._add(ROLES[self.state == 2], b"")
            self.state, self.at = int(DUE[self.state]), self.at + 1

    def turn(self, code: int, role: str, text: bytes) -> None:
        self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self._add(role, text)
            self.state = int(NEXT[self.state, code & 3])
        elif edit == "R":
            self._add(ROLES[self.state == 2], text)
            self.state = int(DUE[self.state])


def repair(conversations: DataFrame, *, key: Column | None = None, damage: bool = False) -> DataFrame:
    """One row per conv_id of (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.

    Turns stand by ``turn``, nulls first; turns of one number by role and then by
    a digest of the text, and equal rows next to each other. A null text or role is
    one blank. A null conv_id is a conversation like others. A role of another or
    of no initial fits nowhere, so its turn is reroled or deleted. Repeated rows are
    duplicates. ``damage`` first puts in faults by ``key`` (a CRC-32 of conv_id and
    turn, if none is given); a conversation that loses all its turns, counts zeros
    and has the hash of nothing. Further columns are ignored; an empty table gives
    an empty result.
    """
    with Scratch(conversations.sparkSession) as scratch:
        rows = damaged(conversations, (turn_key() if key is None else key) if damage else F.lit(19))
        there = F.when(F.col("hit") != 0, F.col("turn"))
        span = F.max(there) - F.min(there) + 1 - F.count_distinct(there)
        ids = rows.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
        left = rows.where("hit <> 0").withColumn("_n", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        left = scratch.cut(flagged(left).select("conv_id", "turn", "role", "text", "digest", "again", "code"))
        order = [F.col("turn").asc_nulls_first(), "role", "digest", "again"]
        slim = left.select("conv_id", "turn", "role", "digest", "again", "code").repartition("conv_id").sortWithinPartitions("conv_id", *order)
        plans = scratch.cut(_planned(slim.select("conv_id", "code")))

        none = {"turn": "long", "role": "string", "digest": "binary", "again": "boolean", "code": "int", "text": "string", "gaps": "long"} | {x.split()[0]: x.split()[1] for x in _PLAN.split(", ")}
        wide = lambda df, phase: df.select("conv_id", F.lit(phase).alias("phase"), *[c if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in none.items()])
        stream = wide(ids, 0).union(wide(plans, 1)).union(wide(left, 2))
        stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "phase", *order)
        return scratch.keep(_hashed(stream))


_OUT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _hashed(stream: DataFrame) -> DataFrame:
    """The result of each conversation's rows: its gaps, its plan, its turns."""

    def run(batches):
        now, one, schema = None, None, None

        def close():
            one.inserted()
            done.append((*now, one.sum.hexdigest()))

        for batch in batches:
            done, schema = [], batch.schema
            cols = {c: batch.column(c).to_pylist() for c in ("conv_id", "phase", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "code", "role")}
            for i, text in enumerate(texts(batch.column("text"))):
                phase = cols["phase"][i]
                if phase == 0:
                    if now:
                        close()
                    now, one = [cols["conv_id"][i], cols["gaps"][i], 0, 0, 0, 0, 0, ""], _Repair("")
                elif phase == 1:
                    now[2:] = [cols[c][i] for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")]
                    one = _Repair(now[7])
                else:
                    one.turn(cols["code"][i], cols["role"][i], text)
            yield result(done, schema)
        if now:
            done = []
            close()
            yield result(done, schema)

    def texts(column):
        from .text import texts_of

        return texts_of(column)

    def result(done, schema):
        kinds = [schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done) if done else [()] * 9, kinds)], ["conv_id", *_OUT])

    kind = stream.schema["conv_id"].dataType.simpleString()
    return stream.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
