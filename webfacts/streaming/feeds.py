"""Streams over fetch logs and facts: look-back windows, keyed reputations, upserting sinks, changes, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import signals
from ..operators.records import first_by, transitions, upsert


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files of a folder as a stream, with ``ts`` as an instant, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, key: str, *, length: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, key, n) of sliding windows; rows later than ``late`` are dropped."""
    seen = stream.withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w"), key).agg(F.count("*").alias("n"))
    return seen.select(F.col("w.start").alias("window_start"), key, "n")


def domain_reputation(stream: DataFrame, ok: Column) -> DataFrame:
    """(domain, total, successes, last_at): running totals per domain, for update or complete mode."""
    return stream.groupBy("domain").agg(F.count("*").alias("total"), F.count_if(ok).alias("successes"), F.max("ts").alias("last_at"))


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str = "seq", buckets: int = 64, keep: int | None = None):
    """A query that merges each batch into a table of Parquet files, dealt to buckets by a hash of the keys; ``current`` reads the newest.

    A batch rewrites only the buckets that it touches. Which version of each
    bucket counts after a batch is a table of its own, written last, so a batch
    that is run again starts from what counted before it, and a restart neither
    loses nor doubles rows. With ``keep`` the tables after the last ``keep``
    batches can be read, and what only older ones need is removed (see ``expire``).
    """
    if keep is not None and keep < 2:
        raise ValueError("a batch that is run again needs the table before it: keep at least 2")

    def merge(batch: DataFrame, batch_id: int) -> None:
        _replaced(batch, batch_id, path, keys, buckets, lambda rows: upsert(rows, keys, required=keys[0], order=order))
        if keep is not None:
            expire(batch.sparkSession, path, batch_id, keep)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _touched(batch: DataFrame, batch_id: int, path: str) -> tuple[list[int], dict[int, int], DataFrame | None]:
    """The buckets of a bucketed batch, the versions that count before it, and what these hold of its buckets."""
    spark = batch.sparkSession
    before = _versions(spark, path, batch_id - 1) if batch_id else {}
    touched = sorted(r[0] for r in batch.select("_bucket").distinct().collect())  # at most ``buckets`` numbers
    old = [f"{path}/data/v={before[k]:08d}/_bucket={k}" for k in touched if k in before]
    return touched, before, spark.read.schema(batch.schema).option("basePath", f"{path}/data").parquet(*old).select(*batch.columns) if old else None


def _replaced(batch: DataFrame, batch_id: int, path: str, keys: list[str], buckets: int, merged) -> None:
    """Writes anew the buckets that a batch touches, as ``merged`` makes of the rows there and the batch's, and then the versions that count."""
    batch = _bucketed(batch, keys, buckets)
    touched, before, old = _touched(batch, batch_id, path)
    rows = merged(batch if old is None else old.unionByName(batch))
    rows.repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/v={batch_id:08d}")
    now = batch.sparkSession.createDataFrame(sorted({**before, **dict.fromkeys(touched, batch_id)}.items()), "bucket int, version long")
    now.coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/b={batch_id:08d}")


def _versions(spark: SparkSession, path: str, batch_id: int) -> dict[int, int]:
    return {r.bucket: r.version for r in spark.read.parquet(f"{path}/versions/b={batch_id:08d}").collect()}


def current(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The table after a batch that had rows, or that came after one."""
    files = [f"{path}/data/v={v:08d}/_bucket={k}" for k, v in sorted(_versions(spark, path, batch_id).items())]
    return spark.read.option("basePath", f"{path}/data").parquet(*files).drop("_bucket", "v")


def expire(spark: SparkSession, path: str, batch_id: int, keep: int = 10) -> int:
    """Removes what none of the tables after the last ``keep`` batches up to ``batch_id`` needs; returns how many versions of buckets went.

    The lists of versions go first, so a reader that comes too late for an old table
    gets an error and never a part of it, and a run that is cut off leaves only
    versions that the next one removes. Those of batches after ``batch_id``, which
    another may be writing, stay.
    """
    if keep < 2:
        raise ValueError("a batch that is run again needs the table before it: keep at least 2")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    number = lambda name: int(name.split("=")[1])
    lists = {number(x.getPath().getName()): x.getPath() for x in files.globStatus(hadoop(f"{path}/versions/b=*"))}
    held = set()
    for n, where in lists.items():
        if n <= batch_id - keep:
            files.delete(where, True)
        else:
            held |= {(v, k) for k, v in _versions(spark, path, n).items()}
    gone = 0
    for x in files.globStatus(hadoop(f"{path}/data/v=*/_bucket=*")):
        version, bucket = number(x.getPath().getParent().getName()), number(x.getPath().getName())
        if version <= batch_id and (version, bucket) not in held:
            gone += files.delete(x.getPath(), True)
    return gone


def first_seen(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows whose keys no earlier row within ``late`` had; state older than that goes."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def inserts(stream: DataFrame) -> DataFrame:
    """(key, value) of a stream of new facts (id, job_id, domain, data_type, url): what listeners get of each."""
    return stream.select(F.col("id").cast("string").alias("key"), F.to_json(F.struct("id", "job_id", "domain", "data_type", "url")).alias("value"))


def micro_batches(stream: DataFrame, checkpoint: str, step, every: str | None = None):
    """A query that runs ``step`` (batch, number) on what has come, once for all there is, or ``every`` so often."""
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger)


def change_step(path: str, key: str, value: str, order: str, buckets: int = 64):
    """A step (batch, number) that writes a batch's changes of a value, (key, order, old, value), to ``path``/changes.

    A row is a change where its value differs from the key's row before it, by
    ``order``, in this batch or in an earlier one; null is a value of its own, and
    before a key's first row stands null. The last row of each key is a table of
    buckets, of which a batch reads and writes those that it touches. A batch that
    is run again writes the same again. Rows must not come in a later batch than
    rows after them; a null key is a key.
    """

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.col(order).alias("_o"), F.lit(True).alias("_new"))
        bucketed = _bucketed(rows, ["_k"], buckets)
        _, _, old = _touched(bucketed, number, f"{path}/last")
        known = bucketed if old is None else old.withColumn("_new", F.lit(False)).unionByName(bucketed)
        changed = transitions(known, "_k", "_v", "_o", "_new").where("_new")
        changed.select(F.col("_k").alias(key), F.col("_o").alias(order), "old", F.col("_v").alias(value)).write.mode("overwrite").parquet(f"{path}/changes/b={number:08d}")
        _replaced(rows, number, f"{path}/last", ["_k"], buckets, lambda both: first_by(both, ["_k"], F.col("_o").desc(), F.col("_new").desc()))

    return step


def change_feed(stream: DataFrame, path: str, checkpoint: str, key: str, value: str, order: str, every: str | None = None):
    """A query that writes the changes of a value (see ``change_step``); ``changes`` reads them."""
    return micro_batches(stream, checkpoint, change_step(path, key, value, order), every)


def changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/changes").drop("b")


def alert_step(rules: DataFrame, path: str, window: str = "hour", days: int = 7):
    """A step (batch, number) that evaluates signals over the facts so far and writes alerts: (signal_id, window_start, kind, match_count, trigger), each signal once a window.

    The time of evaluation is that of the newest fact so far, so a batch that is
    run again finds the same facts, the same time and the same alerts, and writes
    them over its own. Alerts of earlier batches of the same window stand. Facts lie
    by the day of their ``scraped_at``; a batch reads those of the look-back alone.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("day", F.to_date("scraped_at")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/facts/b={number:08d}")
        facts = spark.read.schema(batch.withColumn("day", F.to_date("scraped_at")).withColumn("b", F.lit(0)).schema).option("basePath", f"{path}/facts").parquet(*[f"{path}/facts/b={n:08d}" for n in range(number + 1)])
        as_of = facts.agg(F.max("scraped_at")).first()[0]
        schema = "signal_id int, kind string, match_count long, trigger string, window_start timestamp"
        if as_of is None:
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/alerts/b={number:08d}")
            return
        at = F.lit(as_of).cast(batch.schema["scraped_at"].dataType)
        # a fact of just this time counts, as in an evaluation a moment later
        recent = facts.where(F.col("day") >= F.date_sub(F.to_date(at), days + 1))
        found = signals.evaluate(rules, recent, at + F.expr("INTERVAL 1 MICROSECOND"))
        found = found.select(F.col("signal_id").cast("int").alias("signal_id"), "kind", F.col("match_count").cast("long").alias("match_count"), "trigger", F.date_trunc(window, at).cast("timestamp").alias("window_start"))
        if number:
            earlier = spark.read.schema(schema).parquet(*[f"{path}/alerts/b={n:08d}" for n in range(number)])
            found = found.join(earlier.select("signal_id", "window_start"), ["signal_id", "window_start"], "left_anti")
        found.write.mode("overwrite").parquet(f"{path}/alerts/b={number:08d}")

    return step


def alert_feed(stream: DataFrame, rules: DataFrame, path: str, checkpoint: str, every: str | None = None, **options):
    """A query that evaluates signals with each batch of facts (see ``alert_step``); ``alerts`` reads what has fired."""
    return micro_batches(stream, checkpoint, alert_step(rules, path, **options), every)


def alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/alerts").drop("b")
