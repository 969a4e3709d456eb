"""Keyed records: keep the best, the latest, the first; upserts; transitions and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in an order that should be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def best_by_score(df: DataFrame, key: str = "domain", score: str = "score", pos: str = "pos") -> DataFrame:
    """The row of the highest score per key; a null score is 0 and the first of equals wins."""
    return first_by(df, [key], F.coalesce(F.col(score), F.lit(0)).desc(), F.col(pos).asc())


def merged_contacts(contacts: DataFrame, pages: int = 30) -> DataFrame:
    """Contacts (email, profile_url, name, page, pos) of the first pages, each once: by the first of the three that isn't blank, the earliest one stays."""
    blank = [F.nullif(F.col(c), F.lit("")) for c in ("email", "profile_url", "name")]
    rows = contacts.where(F.col("page") <= pages).withColumn("_key", F.coalesce(*blank)).withColumn("email", blank[0]).withColumn("profile_url", blank[1])
    return first_by(rows, ["_key"], F.col("page").asc(), F.col("pos").asc()).drop("_key")


def upsert(df: DataFrame, keys: list[str], required: str = "url", order: str = "seq") -> DataFrame:
    """Last write wins per key; rows without the required column never collapse."""
    keyed = first_by(df.where(F.col(required).isNotNull()), keys, F.col(order).desc())
    return keyed.unionByName(df.where(F.col(required).isNull()))


def transitions(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Rows whose value differs from the key's row before, with ``old``; a null is a value of its own."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("old", before).where(~F.col("old").eqNullSafe(F.col(value)))


def running_failures(df: DataFrame, key: str, failed: str, *order: str) -> DataFrame:
    """Adds ``streak``: failures in a row up to each row, 0 on a success."""
    w = Window.partitionBy(key).orderBy(*order)
    run = df.withColumn("_run", F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w))
    streak = F.sum(F.when(F.col(failed), 1).otherwise(0)).over(Window.partitionBy(key, "_run").orderBy(*order))
    return run.withColumn("streak", streak.cast("long")).drop("_run")


def tenant_scope(df: DataFrame, user: int | None, column: str = "user_id") -> DataFrame:
    """All rows for an administrator (None), else the user's own."""
    return df if user is None else df.where(F.col(column) == user)
