"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every record draws a number for each shard from a digest of its key and the shard's number, scaled by
the shard's weight, and goes where its number is least. A shard's draws depend on nothing but the key
and that shard: one more shard, or a heavier one, only takes records into itself, and the records of a
shard that goes are dealt over the others in proportion to their weights.

All of it is expressions and DataFrame operations. Placing is a column and moves no data. Slots count a
shard's records without sorting a shard in one task: equal records are one row with a count, a shard's
rows fall into ranges by their hash, and the ranges' running totals tell where each one begins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read

SHARDS = 40
#: Ranges of all shards together in which slots are counted; a shard has at least one.
RANGES = 1 << 16
#: Equal records that one row stands for while slots are dealt.
CHUNK = 1 << 14


def place(key: Column, weights: Sequence[float]) -> Column:
    """The shard, an int from 0, of a key: of the shards with a positive weight the one with the least draw, ties to the first.

    A draw is ``-ln(u) / weight`` with ``u`` between 0 and 1 from the first 52 bits of the MD5 of
    ``key:shard``. A null key is drawn for like an empty string, so all null keys share a shard.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a positive weight")
    name = F.coalesce(key.cast("string"), F.lit(""))
    open_ = F.array(*(F.struct(F.lit(k).alias("shard"), F.lit(float(w)).alias("weight")) for k, w in enumerate(weights) if w > 0))

    def draw(s: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(name, F.lit(":"), s["shard"].cast("string"))), 1, 13), 16, 10).cast("double")
        return F.struct((-F.ln((bits + 0.5) / F.lit(float(1 << 52))) / s["weight"]).alias("draw"), s["shard"].alias("shard"))

    return F.array_min(F.transform(open_, draw))["shard"]


def numbered(rows: DataFrame, group: str, groups: int, slot: str = "slot") -> DataFrame:
    """``rows`` with gapless longs from 0 within each of at most ``groups`` groups; equal rows get consecutive ones.

    Rows are ordered by the MD5 of their columns' strings, then by the columns; a column that can't be
    ordered (a map) can't be numbered.
    """
    columns = rows.columns
    ranges = max(1, RANGES // max(1, groups))
    counted = rows.groupBy(*columns).agg(F.count("*").alias("__n"))
    counted = counted.withColumn("__digest", F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in columns))))
    counted = counted.withColumn("__range", F.floor(F.conv(F.substring("__digest", 1, 8), 16, 10).cast("long") * ranges / F.lit(float(1 << 32))))
    totals = counted.groupBy(group, "__range").agg(F.sum("__n").alias("__total"))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(group).alias("__group"), F.col("__range").alias("__of"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(group, "__range").orderBy("__digest", *columns).rowsBetween(Window.unboundedPreceding, -1)
    at = counted.withColumn("__at", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    at = at.join(starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__of")))
    at = at.withColumn("__from", F.col("__start") + F.col("__at"))
    # A row that stands for very many is dealt over the tasks in chunks.
    step = F.lit(CHUNK).cast("long")
    chunks = at.select(*columns, "__n", "__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, step)).alias("__chunk"))
    chunks = chunks.repartition(group, "__from", "__chunk")
    last = F.least(F.col("__n"), F.col("__chunk") + step) - 1
    return chunks.select(*columns, F.explode(F.sequence(F.col("__from") + F.col("__chunk"), F.col("__from") + last)).alias(slot))


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 16. The law is ``key``: id and weights decide. ``grown_shard``
    is the shard under the weights ``grown``, by default with one more shard of the mean weight.

    Defined results: a null text has no bytes; null ids share the shard of the empty string; rows that
    repeat an id share its shard, with slots of their own; equal texts under different ids are dealt
    apart, since ids decide; an empty table gives an empty result; other columns are not read.
    """
    grown = grown or [*weights, sum(weights) / len(weights)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    placed = docs.select(
        F.col(id_col), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        place(F.col(id_col), weights).alias("shard"), place(F.col(id_col), grown).alias("grown_shard"),
    )
    placed = Scratch(docs.sparkSession, "sharding").table(placed, "placed")  # few bytes a row: texts are read once
    return numbered(placed, "shard", len(weights)).select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], files: int = 1, id_col: str = "doc_id") -> None:
    """Writes whole rows as Parquet into a folder ``shard=K`` for each shard that has any, in ``files`` files each.

    A shard's rows are dealt to its files by a hash of the whole row, so a key that most rows share is
    spread over its shard's files.
    """
    taken = {c.lower() for c in docs.columns}
    if "shard" in taken:
        raise ValueError("the column shard is taken")
    placed = docs.withColumn("shard", place(F.col(id_col), weights)).withColumn("__file", F.pmod(F.xxhash64(*docs.columns), F.lit(files)))
    placed.repartition(len(weights) * files, "shard", "__file").drop("__file").write.partitionBy("shard").parquet(path)


def op11_sharding(spark, sf_dir):
    return assign(read(spark, sf_dir, "documents"), [1.0] * SHARDS)


#: CRC-32 in SQL, as DuckDB has no such function: the table of a byte's remainders, and a text's bytes taken through it.
_CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""
_CRC = "xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295)"
SQL = f"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS name, coalesce(text, '') AS text FROM documents),
bytes AS (SELECT r, doc_id, strlen(text) + 16 AS size, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM d),
summed AS (SELECT r, doc_id, size, {_CRC} AS text_crc32 FROM bytes, crc_table),
drawn AS (
  SELECT r, s.shard, -ln((CAST('0x' || substr(md5(name || ':' || s.shard::VARCHAR), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS draw
  FROM d, range({SHARDS + 1}) s(shard)),
placed AS (SELECT r, arg_min(shard, draw) FILTER (shard < {SHARDS}) AS shard, arg_min(shard, draw) AS grown_shard FROM drawn GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws(':', doc_id::VARCHAR, size::VARCHAR, text_crc32::VARCHAR, shard::VARCHAR, grown_shard::VARCHAR)), doc_id) - 1 AS slot, grown_shard
FROM summed JOIN placed USING (r)
"""
