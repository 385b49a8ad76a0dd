"""What the operators of this subpackage share: scratch tables, reading inputs, text helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many rows and bytes of text are broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: Folders of scratch tables made since the last ``clear``, by session.
_ROOTS: dict[str, list[str]] = {}

#: ASCII white space as the contracts define it: 0x20 and 0x09 to 0x0D.
SPACE = r"\x20\x09-\x0D"


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall back to the
    machine's own temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = f"{tempfile.gettempdir()}/checkpoints"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables an operator writes to the shared folder to cut lineage.

    A lost executor costs at most the tasks since the last table. ``drop`` frees tables that no
    returned frame reads any more, ``keep`` all but those that one does; ``clear`` frees the rest
    once the caller has read the result.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.made: set[str] = set()
        _ROOTS.setdefault(_session(spark), []).append(self.root)

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def table(self, df: DataFrame, label: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(label))
        self.made.add(label)
        self.free()
        return self.read(label, df)

    def free(self) -> None:
        """Lets Spark remove the shuffle files of frames that nothing refers to any more: what the
        table replaced needn't take disk until the driver happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def read(self, label: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(label))

    def drop(self, *labels: str) -> None:
        for label in labels:
            _delete(self.spark, self.path(label))
            self.made.discard(label)

    def keep(self, *labels: str) -> None:
        self.drop(*(self.made - set(labels)))


def _session(spark: SparkSession) -> str:
    return str(spark._jsparkSession.sessionUUID())


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> int:
    """Frees the tables that this session's operators still hold, once their results have been read; how many folders."""
    left = _ROOTS.pop(_session(spark), [])
    for root in left:
        _delete(spark, root)
    return len(left)


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(row, root): the smallest row of each connected component, by alternating large and small stars.

    Every round joins each row's neighbours to the smallest of them; the number of rounds grows with
    the logarithm of the longest path.
    """
    now = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{label}-0")
    k = 0
    while True:
        # Done when every row has one link and none leads to a row that has a link itself.
        state = now.agg(F.count("*").alias("n"), F.count_distinct("a").alias("rows")).first()
        if state.n == state.rows and now.join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            return now.select(F.col("a").alias("row"), F.col("b").alias("root"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), f"{label}-low-{k}")
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = scratch.table(large, f"{label}-large-{k}")
        least = scratch.table(large.groupBy("a").agg(F.min("b").alias("low")), f"{label}-least-{k}")
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(small.select("a", F.col("low").alias("b")))
        now = scratch.table(small.filter("a <> b").distinct(), f"{label}-{k + 1}")
        scratch.drop(f"{label}-{k}", f"{label}-low-{k}", f"{label}-large-{k}", f"{label}-least-{k}")
        k += 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, text: str | None = None) -> DataFrame:
    """Marks a stored table for broadcast if its rows, and the bytes of its ``text`` column, are within the bounds."""
    got = df.agg(F.count("*").alias("rows"), (F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if text else F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if got.rows <= BROADCAST_ROWS and got.bytes <= BROADCAST_BYTES else df


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``: the contracts' way to deal out folds."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def batches(schema: pa.Schema, rows: Iterable[tuple], size: int = 4096, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows and about ``max_bytes`` of strings from row tuples."""
    kept: list[tuple] = []
    held = 0
    for row in rows:
        kept.append(row)
        held += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(kept) >= size or held >= max_bytes:
            yield to_batch(schema, kept)
            kept, held = [], 0
    if kept:
        yield to_batch(schema, kept)


def to_batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
