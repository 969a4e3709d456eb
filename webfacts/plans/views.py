"""The tables of the platform as projections of the tables at hand, for Spark and, in the same words, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls

AS_OF = "2024-01-31 00:00:00"

_STATUS = "CASE WHEN event_type IN ('purchase', 'click', 'view') THEN 'completed' WHEN event_type = 'signup' THEN 'pending' WHEN event_type = 'error' THEN 'failed' END"
_CODE = "CASE WHEN event_type = 'error' THEN 429 WHEN event_type = 'signup' THEN 503 ELSE 200 END"
_JOBS = f"SELECT event_id AS id, user_id, concat('site', CAST(user_id % 50 AS STRING), '.example.com') AS domain, {_STATUS} AS status, {_CODE} AS status_code, ts AS created_at, value AS latency FROM events"
_TYPES = "CASE doc_id % 6 WHEN 0 THEN 'page' WHEN 1 THEN 'article' WHEN 2 THEN 'contact' WHEN 3 THEN 'tech_stack' WHEN 4 THEN 'resource' ELSE 'pricing' END"
_RECORDS = f"SELECT d.doc_id AS id, source AS domain, {_TYPES.replace('doc_id', 'd.doc_id')} AS data_type, lang, quality, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
_HITS = "SELECT concat('d', CAST(o_custkey AS STRING)) AS domain, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS score, o_orderkey AS pos FROM orders"

#: The same projections as common table expressions of an oracle.
WITH = f"WITH v_jobs AS ({_JOBS}), v_records AS ({_RECORDS}), v_hits AS ({_HITS}) "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "user_id", "concat('site', CAST(user_id % 50 AS STRING), '.example.com') AS domain", f"{_STATUS} AS status", f"{_CODE} AS status_code", "ts AS created_at", "value AS latency")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").selectExpr("doc_id AS id", "source AS domain", f"{_TYPES} AS data_type", "lang", "quality", "n_chars")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("concat('d', CAST(o_custkey AS STRING)) AS domain", "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS score", "o_orderkey AS pos")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.extract_domain(F.col("url")).alias("domain"), urls.classify_url(F.col("url")).alias("data_type"))
