"""Changes to tables as new tables: sparse updates, toggles, soft and cascading deletes, and what a reader may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of the metadata of a record type with their kinds; ! must be there, ? may be null; other types pass.
FIELDS = {
    "blog_url": {"blog_landing_url": "string!", "article_urls": "list", "total_articles": "number"},
    "article": {"author": "string?", "categories": "list", "word_count": "number", "excerpt": "string?", "content": "string?"},
    "contact": {"first_name": "string?", "last_name": "string?", "job_title": "string?", "email": "string?", "phone": "string?", "linkedin_url": "string?", "source": "string"},
    "tech_stack": {"platform": "string?", "js_libraries": "list", "analytics": "list", "marketing_tools": "list", "frameworks": "list"},
    "resource": {"resource_type": "string", "description": "string?", "gated": "boolean", "download_url": "string?"},
}
_KINDS = {"string": "^STRING$", "list": r"^ARRAY<(STRING|VOID)>$", "number": "^BIGINT$", "boolean": "^BOOLEAN$"}


def patched(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the non-null values of changes (key, some of the columns), of which a key has one at most; keys without a row are ignored."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    value = lambda c: F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c)
    return rows.join(new, key, "left").select(*[value(c) for c in rows.columns])


def toggled(rows: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows with the flag turned round where their key is among the keys; a null flag stays null."""
    hit = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, key, "left").withColumn(flag, F.when(F.col("_hit"), ~F.col(flag)).otherwise(F.col(flag))).select(*rows.columns)


def soft_deleted(rows: DataFrame, keys: DataFrame, key: str, flag: str = "is_active") -> DataFrame:
    """Rows, inactive where their key is among the keys."""
    return patched(rows, keys.select(key).distinct().withColumn(flag, F.lit(False)), key)


def cascaded(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Children whose parent's key is not among those gone; a null key has no parent and stays."""
    return children.join(gone.select(key), key, "left_anti").select(*children.columns)


def masked(secret: Column, shown: int = 8) -> Column:
    """A secret's last characters behind stars; null for none."""
    return F.when(F.length(secret) > 0, F.concat(F.lit("****"), F.right(secret, F.lit(shown))))


def firings(executions: DataFrame, key: str = "signal_id", at: str = "fired_at") -> DataFrame:
    """(signal_id, fire_count, last_fired_at), derived from the log instead of counted up in place."""
    return executions.groupBy(key).agg(F.count("*").alias("fire_count"), F.max(at).alias("last_fired_at"))


def retries(jobs: DataFrame, parameters: list[str], at: Column) -> DataFrame:
    """A new pending job for each failed one, with its parameters and, as ``retry_of``, its id."""
    return jobs.where("status = 'failed'").select(F.col("id").alias("retry_of"), *parameters, F.lit("pending").alias("status"), at.alias("created_at"))


def is_object(metadata: Column) -> Column:
    """Whether JSON is an object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(metadata)).startswith("OBJECT"), F.lit(False))


def is_valid(data_type: Column, metadata: Column) -> Column:
    """Whether metadata (JSON) is an object whose fields are of the kinds that its type gives them; fields that it doesn't name may be anything."""
    whole, ok = F.try_parse_json(metadata), is_object(metadata)
    for kind, fields in FIELDS.items():
        for name, rule in fields.items():
            own = F.schema_of_variant(F.try_variant_get(whole, f"$.{name}", "variant"))
            good = own.rlike(_KINDS[rule.rstrip("!?")]) | (own == "VOID" if rule.endswith("?") else F.lit(False))
            ok = ok & ((data_type != kind) | F.coalesce(good, F.lit(not rule.endswith("!"))))
    return ok
