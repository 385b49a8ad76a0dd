"""Exact dedup by skew-safe combining.

Three stages, each comparing whole normalised texts and not only their digests:

1. *local*: every input partition merges its own equal texts, so a hot text leaves a partition once,
   or as often as the bounded table of held texts fills up;
2. *salted*: classes whose digest appeared more than once merge within a salt;
3. *global*: the salts' winners merge, at most ``salts`` rows for one text.

What a class learns of its winner comes back by digest and salt, without texts; only texts that
differ under one digest are told apart by content there, too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batches, read, text_or_empty

#: ASCII white space, deleted before texts are compared.
BLANKS = b" \t\n\x0b\x0c\r"
SALTS = 16
#: Bytes of distinct texts that a task holds at a time in the local stage.
LOCAL_BYTES = 64 << 20

_SCHEMA = pa.schema(
    [
        ("row", pa.int64()),  # null in a class record
        ("class", pa.int64()),
        ("id", pa.string()),
        ("n_chars", pa.int64()),
        ("digest", pa.binary()),
        ("text", pa.binary()),  # null in a row record
        ("n", pa.int64()),
    ]
)
_DDL = "row long, class long, id string, n_chars long, digest binary, text binary, n long"


def _local(limit: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Row records as they come; one record with the text for each class held, whenever they fill the limit."""
        base = TaskContext.get().partitionId() << 33

        def records() -> Iterator[tuple]:
            classes: dict[bytes, list[list]] = {}
            n = made = held = 0

            def flush() -> Iterator[tuple]:
                for digest, same in classes.items():
                    for class_, norm, count in same:
                        yield None, class_, None, None, digest, norm, count
                classes.clear()

            for batch in it:
                for id_, text, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    norm = text.encode().translate(None, BLANKS)
                    digest = hashlib.sha256(norm).digest()
                    same = classes.setdefault(digest, [])
                    for known in same:
                        if known[1] == norm:
                            known[2] += 1
                            break
                    else:
                        known = [base + made, norm, 1]
                        same.append(known)
                        made += 1
                        held += len(norm) + 200
                    yield base + n if row is None else row, known[0], id_, len(text), digest, None, None
                    n += 1
                    if held >= limit:
                        yield from flush()
                        held = 0
            yield from flush()

        yield from batches(_SCHEMA, records())

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, row_col: str | None = None, key_bytes: int = 32) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    With ``row_col``, a column of distinct longs, that column comes first in the result. Texts are
    grouped by the first ``key_bytes`` of their digest and told apart by their content.

    Texts are equal when identical after deleting ASCII white space. The row with the most code
    points stays, then the one with the smallest id.

    Defined results: a null text counts as empty, and empty texts are equal; null ids lose ties
    against any id; of rows repeated with the same id and length exactly one has ``kept``; an empty
    table gives an empty result; columns other than the two named are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact_dedup")
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text"), F.col(row_col).alias("row") if row_col else F.lit(None).cast("long").alias("row"))
    local = scratch.table(source.mapInArrow(_local(LOCAL_BYTES), _DDL), "local")
    rows = local.filter(F.col("row").isNotNull()).select("row", "class", F.col("id").cast(id_type).alias("id"), "n_chars", "digest")
    classes = local.filter(F.col("row").isNull()).select("class", F.substring("digest", 1, key_bytes).alias("key"), "text", "n")

    # The winner of each local class; partial aggregation bounds what a hot class sends.
    winner = F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")
    local_best = rows.groupBy("class").agg(winner)
    spread = classes.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    spread = scratch.table(spread, "spread")
    info = classes.select("class", "key", "n").join(spread, "key", "left_semi").join(local_best, "class")
    info = scratch.table(info.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(salts))), "info")
    merging = classes.select("class", "text").join(info.hint("merge"), "class")  # the same plan at every size
    salted = merging.groupBy("key", "salt", "text").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    merged = scratch.table(salted.groupBy("key", "text").agg(F.min("best").alias("best"), F.sum("n").alias("n")), "merged")
    # Digests of several texts: hardly ever any, but then content decides.
    mixed = scratch.table(merged.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key"), "mixed")
    of_key = merged.join(mixed, "key", "left_anti").select("key", "best", F.col("n").alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    by_key = info.select("class", "key", F.col("salt").cast("long").alias("salt")).join(of_key, ["key", "salt"]).select("class", "best", F.col("total").alias("n"))
    by_text = merging.join(mixed, "key", "left_semi").select("class", "key", "text").join(merged, ["key", "text"]).select("class", "best", "n")
    alone = classes.select("class", "key", "n").join(spread, "key", "left_anti").join(local_best, "class").select("class", "best", "n")
    result = alone.unionByName(by_key)
    result = scratch.table(result if mixed.isEmpty() else result.unionByName(by_text), "winners")
    scratch.keep("local", "winners")
    return rows.join(result, "class").select(
        *([F.col("row").alias(row_col)] if row_col else []),
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
w AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
