"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

Leaves of a tree (domain, language, source) supply tokens. A budget flows from
the root down: each node's goes to its children by their weights, and what a
child cannot supply goes to its siblings, again by weight, before anything is
missing further up, since a node is never given more than its leaves can
supply. A leaf then takes documents in a seeded order, epoch after epoch, until
its budget is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Scratch

LEVELS = ["domain", "language", "source_name"]
#: Target weights of the registered query and the pipeline (level, name, weight); every other node weighs 1.
TARGETS = [("domain", "d0", 3.0), ("domain", "d1", 2.0), ("language", "en", 2.0), ("language", "de", 1.5), ("source_name", "src1", 0.5), ("source_name", "src2", 4.0)]
_PLAN = "_mixing_plan_"


def tokens_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text and one end."""
    return (F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1).cast("long")


def _shared(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to nodes (parent..., name, weight, supply, above): ``above`` shared by weight, none over its supply.

    Children in the order of supply / weight fill up first; with the budget and
    weights of those before them taken off, a child is full if its fair share
    of the rest exceeds its supply. Once one is not, none after it is.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("supply") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    nodes = nodes.withColumn("_taken", F.coalesce(F.sum("supply").over(before), F.lit(0.0))).withColumn("_gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    nodes = nodes.withColumn("_rate", (F.col("above") - F.col("_taken")) / (F.sum("weight").over(whole) - F.col("_gone")))
    nodes = nodes.withColumn("_full", F.col("_rate") * F.col("weight") >= F.col("supply"))
    level = F.max(F.when(~F.col("_full"), F.struct(-(F.col("supply") / F.col("weight")), F.col("_rate").alias("rate")))).over(whole)["rate"]
    budget = F.when(F.col("_full"), F.col("supply")).otherwise(F.least(F.col("supply"), level * F.col("weight")))
    return nodes.withColumn("budget", budget).drop("_taken", "_gone", "_rate", "_full")


def budgets(leaves: DataFrame, total: Column, weights: DataFrame | None = None) -> DataFrame:
    """(domain, language, source_name, budget) of leaves (those, supply).

    ``weights`` has rows (level, name, weight): the weight of every node of that
    level and name, 1 where there is none. Null names are nodes of their own.
    """
    tree = leaves.select(*[F.coalesce(F.col(c), F.lit("\u0000")).alias(c) for c in LEVELS], F.col("supply").cast("double").alias("supply"))
    above = tree.agg(F.least(total.cast("double"), F.sum("supply")).alias("above"))
    for depth, name in enumerate(LEVELS):
        parent = LEVELS[:depth]
        nodes = tree.groupBy(*parent, name).agg(F.sum("supply").alias("supply"))
        if weights is None:
            nodes = nodes.withColumn("weight", F.lit(1.0))
        else:
            own = weights.where(F.col("level") == name).select(F.col("name").alias(name), F.col("weight").cast("double").alias("weight"))
            nodes = nodes.join(own, name, "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1e-9)))
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(above))  # one row: the total
        above = _shared(nodes, parent, name).select(*parent, name, F.col("budget").alias("above"))
    return above.select(*[F.when(F.col(c) != "\u0000", F.col(c)).alias(c) for c in LEVELS], F.col("above").alias("budget"))


def targets(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """(level, name, weight) of the target weights, ``TARGETS`` if no others are given."""
    given = [F.struct(F.lit(level).alias("level"), F.lit(name).alias("name"), F.lit(float(weight)).alias("weight")) for level, name, weight in (TARGETS if rows is None else rows)]
    return spark.range(1).select(F.inline(F.array(*given).cast("array<struct<level:string,name:string,weight:double>>")))


def domain_of(source: Column) -> Column:
    """``d`` and the number at a source's end modulo 4, or the source itself where it ends in no number."""
    number = F.regexp_extract(source, r"(\d+)$", 1)
    return F.when(number != "", F.concat(F.lit("d"), F.pmod(number.try_cast("bigint"), F.lit(4)).cast("string"))).otherwise(source)


def _order(seed: int, epoch: Column, key: Column) -> Column:
    """A row's place in the order of an epoch: 60 bits of a hash of seed, epoch and row."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), epoch, key)), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, *, share: float = 0.5, weights: DataFrame | None = None, domain: Column | None = None, epochs: int = 1, seed: int = 7, per_bucket: int = 2_000) -> DataFrame:
    """Rows of documents (doc_id, text, lang, source, ...) with domain, n_tokens, epoch, leaf_budget.

    The budget is ``share`` of the corpus's tokens, at most ``epochs`` times all
    of them. A leaf of supply S gives up to ``epochs`` S: its documents in the
    order of a hash of seed, epoch and row, until the budget is reached; the
    document that crosses it is taken. Rows with one hash, such as repeated
    rows, go together. Null texts count one token; null languages, sources and
    domains are nodes of their own. An empty table gives an empty result. Texts
    of any length count whole. Input columns of the same names as the new ones
    are replaced; any others, whatever their names, stay.
    """
    with Scratch(docs.sparkSession) as scratch:
        docs = docs.drop("domain", "n_tokens", "epoch", "leaf_budget")
        domain = domain_of(F.col("source")) if domain is None else domain
        leaf = [domain.alias("domain"), F.col("lang").alias("language"), F.col("source").alias("source_name")]
        key = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
        rows = scratch.cut(docs.select(*leaf, key.alias("key"), tokens_of(F.col("text")).alias("n_tokens")))
        n = scratch.rows(rows)
        leaves = scratch.cut(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("own"), F.count("*").alias("n")), n)
        total = leaves.agg((F.coalesce(F.sum("own"), F.lit(0)) * share).alias("t")).first()["t"]
        planned = scratch.cut(budgets(leaves.withColumn("supply", F.col("own") * epochs), F.lit(float(total)), weights), scratch.rows(leaves))
        leaves = _joined(leaves, planned, LEVELS)
        # whole epochs first, then the prefix of one more
        leaves = leaves.withColumn("whole", F.floor(F.col("budget") / F.col("own")).cast("int")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("own"))
        leaves = scratch.cut(leaves, scratch.rows(planned))
        # tokens by bucket of the order show in which bucket the prefix ends; only that one is sorted
        width = F.ceil(F.lit(float(1 << 60)) / F.greatest(F.lit(1), F.ceil(F.col("n") / per_bucket)))
        placed = _joined(rows, leaves, LEVELS).withColumn("order", _order(seed, F.col("whole"), F.col("key")))
        placed = placed.withColumn("bucket", F.floor(F.col("order") / width).cast("long"))
        sums = placed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
        before = F.coalesce(F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") >= F.col("rest")))
        last = _joined(placed.drop("rest"), sums.select(*LEVELS, F.col("bucket").alias("b"), "before", "rest"), LEVELS).where("bucket = b")
        run = F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "bucket").orderBy("order").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        cut = last.withColumn("upto", F.col("before") + run).where("upto >= rest").groupBy(*LEVELS).agg(F.min("order").alias("cut"))
        plan = _joined(leaves, cut, LEVELS, "left").select(*LEVELS, F.col("budget").alias("leaf_budget"), "whole", "rest", "cut")
        plan = scratch.keep(plan.select(*[F.col(c).alias(f"{_PLAN}{c}") for c in plan.columns]), scratch.rows(leaves))
    plans = {c.removeprefix(_PLAN): F.col(c) for c in plan.columns}
    marked = docs.select("*", domain.alias("domain"), tokens_of(F.col("text")).alias("n_tokens"), key.alias(f"{_PLAN}key"))
    both = marked.join(plan, F.col("domain").eqNullSafe(plans["domain"]) & F.col("lang").eqNullSafe(plans["language"]) & F.col("source").eqNullSafe(plans["source_name"]))
    partly = (plans["rest"] > 0) & (_order(seed, plans["whole"], F.col(f"{_PLAN}key")) <= F.coalesce(plans["cut"], F.lit(2**63 - 1)))
    n = plans["whole"] + F.when(partly, 1).otherwise(0)
    out = both.where(n > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.select(*[f"`{c}`" for c in docs.columns], "domain", "n_tokens", "epoch", plans["leaf_budget"].alias("leaf_budget"))


def _joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which nulls of the keys are equal."""
    b = b.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in b.columns if c in keys or c not in a.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(b, on, how).drop(*[f"_{k}" for k in keys])
