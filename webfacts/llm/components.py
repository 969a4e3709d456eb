"""Connected components of an edge table by alternating star contractions (MapReduce "large star, small star")."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, gathered

#: Edges that one task works on; a table of fewer needs no shuffle.
PER_TASK = 50_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each vertex's larger (or not larger) neighbours to the smallest of its neighbourhood.

    The minimum is an aggregate with map-side partials and joined back, so that
    a vertex with very many neighbours does not gather them in one task.
    """
    up, down, own = F.struct(F.col("v").alias("u"), F.col("u").alias("v")), F.struct("u", "v"), F.struct("u", F.col("u").alias("v"))
    if large:
        rows = edges.select(F.inline(F.array(up, down)))
        least = rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        rows = rows.join(least, "u").where("v > u")
    else:
        rows = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).select(F.inline(F.array(down, own)))
        rows = rows.join(rows.groupBy("u").agg(F.min("v").alias("m")), "u")
    return rows.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(id, component_id) of every vertex on an edge (u, v); component_id is the smallest id reachable.

    An empty edge table gives an empty result; self-loops and repeated or
    reversed edges change nothing. ``rows`` bounds the number of edges. Edges stay in written tables from round to
    round; the driver sees only their number and how many vertices point to one
    that points on, or to two.
    """
    edges = scratch.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows)
    for _ in range(rounds):
        dealt = gathered(edges, n := scratch.rows(edges), PER_TASK)
        ends = dealt.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            break
        before, edges = edges, scratch.cut(gathered(_star(_star(dealt, True), False), n, PER_TASK))
        scratch.free(before)
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
