"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the small side of a join that may be sent to every executor.
SENT_ROWS = 20_000
#: Has Spark remove a query's shuffle files when it has ended.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of stored tables, by session.
_PATHS: dict[str, list[str]] = {}


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """The frame, written and read back: its lineage ends here, and what reads it several times computes it once.

    The shuffle files behind it go at once; nothing will read them again. The table stays until ``clear``.
    """
    from ..sources.store import shared_folder

    spark = df.sparkSession
    path, before = shared_folder(spark, name), spark.conf.get(_CLEAN_UP, "false")
    _PATHS.setdefault(_session(spark), []).append(path)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def _session(spark: SparkSession) -> str:
    return str(spark._jsparkSession.sessionUUID())


def clear(spark: SparkSession) -> int:
    """Deletes what this session has stored, once its results have been read; how many tables."""
    paths = _PATHS.pop(_session(spark), [])
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def sent(df: DataFrame) -> DataFrame:
    """A stored frame, marked for broadcast if it is small; a larger one is joined by shuffling."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df
