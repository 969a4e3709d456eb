"""The corpus pipeline: documents that are identified, good, unlike each other, mixed to weights, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webfacts.llm.language_id import identify
from webfacts.llm.minhash import near_duplicates
from webfacts.llm.mixing import mix, targets
from webfacts.llm.packing import pack
from webfacts.llm.quality_classifier import classify
from webfacts.llm.store import Scratch
from webfacts.llm.text import kept

#: No SQL expresses the trained models of the first two stages.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; rejected ones go, and with them null and blank texts and those without a letter.

    Repeated rows fare alike, and a text of any length is judged whole.
    """
    return identify(docs).where("not rejected").select(*kept(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; blank ones have the score of no words at all, and repeated rows fare alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).where("predicted = 1").select(*kept(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, that of its smallest doc_id.

    Rows without words or of a null doc_id are rows like others: blank ones
    stay, and a class of null doc_ids keeps one. Repeated rows (equal doc_id and
    text) are one class, so one of them stays; blank ones do so too.
    """
    stays = near_duplicates(docs).where("stays").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    return with_rows(docs, stays)


def with_rows(docs: DataFrame, stays: DataFrame) -> DataFrame:
    """One row of docs for each (_id, _mark), a doc_id and a hash of a text; only repeated rows are shuffled whole."""
    marked = docs.withColumn("_own", F.xxhash64(F.col("text").cast("string")))
    own = F.col("doc_id").cast("long")
    times = marked.groupBy(own.alias("_id"), F.col("_own").alias("_mark")).agg((F.count("*") > 1).alias("_again"))
    stays = stays.distinct().withColumnRenamed("_id", "_d").withColumnRenamed("_mark", "_m")
    stays = stays.join(times, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_m") == F.col("_mark"))).select("_id", "_mark", "_again").hint("merge")
    both = marked.join(stays, own.eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_mark")))
    once = both.where("not _again").select(*kept(docs))
    again = both.where("_again").dropDuplicates(["_id", "_mark"]).select(*kept(docs))
    return once.unionByName(again)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens to target weights over domains, languages and sources.

    One epoch, as a text should not come back once near-duplicates are gone. A
    leaf gives its documents in a seeded order until its budget is reached;
    repeated rows go together.
    """
    return mix(docs, share=0.8, weights=targets(spark)).select(*kept(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens, by the packing operator's columns; repeated rows are packed each."""
    return pack(docs)


STAGES = [("language_id", language_id), ("quality", quality), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each reads what the one before it has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.cut(stage(spark, docs, sf_dir))
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir))
