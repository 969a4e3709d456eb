"""Scratch tables in the folder that the driver and all executors share.

Iterative operators cut their lineage by writing a table there and reading it
again, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows that one task of a small table works on; more partitions than that takes are put together.
PER_TASK = 20_000

_left: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder of a local session, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="webfacts-")
    return _own[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended, and the folder goes with it
        pass


@atexit.register
def _clear() -> None:
    while _left:
        _delete(*_left.pop())


def gathered(df: DataFrame, rows: int | None, per_task: int = PER_TASK) -> DataFrame:
    """``df`` in no more partitions than its number of rows needs, if that is known (or a bound of it)."""
    return df if rows is None else df.coalesce(max(1, -(-rows // per_task)))


class Scratch:
    """Written tables of one operator: ``cut`` for those that go at its end, ``keep`` for what its result reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for _, path, _ in self.tables:
            _delete(self.spark, path)

    def _write(self, df: DataFrame) -> str:
        path = f"{shared_dir(self.spark)}/scratch-{uuid.uuid4().hex}"
        df.write.parquet(path, compression="zstd")
        return path

    def cut(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """The table as written and read again, in files by ``rows``, a bound of its number of rows."""
        seen = Observation()
        path = self._write(gathered(df, rows).observe(seen, F.count(F.lit(1)).alias("rows")))
        self.tables.append((out := self.spark.read.schema(df.schema).parquet(path), path, seen.get["rows"]))
        return out

    def rows(self, table: DataFrame) -> int:
        """How many rows a cut table has, counted as it was written."""
        return next(n for x, _, n in self.tables if x is table)

    def free(self, *done: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for table, path, _ in self.tables:
            if any(table is x for x in done):
                _delete(self.spark, path)
        self.tables = [x for x in self.tables if not any(x[0] is y for y in done)]

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """A table that stays until the driver's process ends, as lazily read results need it."""
        _left.append((self.spark, path := self._write(gathered(df, rows))))
        return self.spark.read.schema(df.schema).parquet(path)
