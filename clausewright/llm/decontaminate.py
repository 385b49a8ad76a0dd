"""Benchmark decontamination by size-partitioned MinHash containment search, in SQL functions only.

A test item is the set of its five-word shingles (a shorter item is one shingle of all its words). An
item of ``s`` shingles that is at least ``t`` contained in a document lacks at most ``s - ceil(t * s)``
of them there, so of any ``s - ceil(t * s) + 1`` of its shingles the document holds one. The smallest
hashes of an item are those shingles: its MinHash sketch.

Items and documents are partitioned by size, in powers of two. The largest hash that the sketches of
an item partition reach bounds what a document needs to keep of its own hashes, and a document
partition only has to heed the item partitions that fit into its size. The hashes below its
partition's bound are a document's MinHash signature; a document without a hash of an item's sketch
can't contain the item. The pairs that remain are verified by comparing the shingles themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read, small, text_or_empty

SHINGLE = 5
THRESHOLD = 0.8
#: Size partitions: powers of two up to the largest size of an array.
PARTITIONS = 32


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once: a lambda's variable is bound, a merged projection isn't."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(tokens: Column, size: int = SHINGLE) -> Column:
    """The shingles of ``size`` words of an array of words, as text."""
    none = F.expr("array()").cast("array<string>")
    return _let(tokens, lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(size))))).otherwise(none))


def _hashed(word_hashes: Column, size: int) -> Column:
    """The shingles of ``size`` words of an array of words' hashes, as 64-bit hashes."""
    none = F.expr("array()").cast("array<bigint>")
    each = F.transform(F.sequence(F.lit(0), F.size(word_hashes) - size), lambda i: F.xxhash64(*(F.get(word_hashes, i + k) for k in range(size))))
    return F.when(F.size(word_hashes) >= size, each).otherwise(none)


def _hash(shingle: Column, size: Column) -> Column:
    """The same hash as ``_hashed`` gives, from a shingle's text."""
    parts = F.split(shingle, " ")
    out = F.lit(None).cast("long")
    for n in range(1, SHINGLE + 1):
        out = F.when(size == n, F.xxhash64(*(F.xxhash64(F.get(parts, F.lit(k))) for k in range(n)))).otherwise(out)
    return out


def signature_bounds(sketches: DataFrame, threshold: float) -> list[int | None]:
    """For each size partition of documents the largest hash they must keep, none if no item fits into them.

    What reaches the driver is a row for each power of two among the items' sizes.
    """
    by_size = sketches.groupBy(F.floor(F.log2("n_shingles")).alias("partition")).agg(F.min("n_shingles").alias("least"), F.max("h").alias("bound")).collect()
    fits = lambda q: [r.bound for r in by_size if math.ceil(r.least * threshold - 1e-9) < 1 << (q + 1)]
    return [max(fits(q), default=None) for q in range(PARTITIONS)]


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, row_col: str | None = None) -> DataFrame:
    """id, item, n_shared, n_shingles, containment for each item at least ``threshold`` contained in a document.

    With ``row_col``, a column of distinct longs, that column comes first in the result.

    Defined results: null texts count as empty; an item of one to four words is one shingle, found in
    documents that hold these words in a row; an item without words is never found; every row of
    ``docs`` and of ``items`` is by itself, whatever its id, null and repeated ids included; empty
    tables give an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    texts = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    texts = texts if row_col else scratch.table(texts, "texts")
    listed = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), text_or_empty(item_text_col).alias("text"))
    listed = scratch.table(listed.select("item", "item_id", words(F.col("text")).alias("words")).withColumn("k", F.least(F.size("words"), F.lit(SHINGLE))).filter("k > 0"), "items")
    sizes_used = sorted(r.k for r in listed.select("k").distinct().collect())  # five numbers at most

    each = [listed.filter(F.col("k") == k).select("item", "k", F.explode(shingles(F.col("words"), k)).alias("shingle")) for k in sizes_used] or [listed.select("item", "k", F.lit("").alias("shingle"))]
    parts = each[0]
    for more in each[1:]:
        parts = parts.unionByName(more)
    parts = scratch.table(parts.distinct().withColumn("h", _hash(F.col("shingle"), F.col("k"))), "item_shingles")
    sizes = scratch.table(parts.groupBy("item", "k").agg(F.count("*").alias("n_shingles")), "sizes")
    needed = (F.col("n_shingles") - F.ceil(F.col("n_shingles") * threshold - 1e-9) + 1).cast("int")
    sketch = parts.join(sizes, ["item", "k"]).groupBy("item", "k", "n_shingles").agg(F.array_sort(F.collect_set("h")).alias("hashes"))
    sketch = scratch.table(sketch.select("item", "k", "n_shingles", F.explode(F.slice("hashes", F.lit(1), needed)).alias("h")), "sketch")

    bounds = signature_bounds(sketch.filter(F.col("k") == SHINGLE), threshold)
    bound = F.array(*(F.lit(b).cast("long") for b in bounds))

    def signature(w: Column) -> Column:
        kept = []
        for k in sizes_used:
            hashes = _hashed(w, k)
            if k == SHINGLE:
                hashes = _let(hashes, lambda all_: _let(F.get(bound, F.floor(F.log2(F.size(all_))).cast("int")), lambda top: F.filter(all_, lambda h: h <= top)))
            kept.append(hashes)
        return F.concat(*kept) if kept else F.expr("array()").cast("array<bigint>")

    signed = texts.select("row", F.explode(_let(F.transform(words(F.col("text")), lambda x: F.xxhash64(x)), signature)).alias("h"))
    candidates = scratch.table(signed.join(small(sketch.select("item", "h")), "h").select("row", "item").distinct(), "candidates")

    # Verification reads the texts of candidate documents only.
    asked = scratch.table(candidates.select("row").distinct(), "asked")
    suspect = texts.join(small(asked), "row", "left_semi").select("row", words(F.col("text")).alias("words"))
    present = suspect.select("row", F.explode(F.concat(*(shingles(F.col("words"), k) for k in sizes_used)) if sizes_used else F.array(F.lit(""))).alias("shingle"))
    shared = present.join(small(parts.select("item", "shingle"), "shingle"), "shingle").groupBy("row", "item").agg(F.count_distinct("shingle").alias("n_shared"))
    found = shared.join(candidates, ["row", "item"], "left_semi").join(small(sizes.select("item", "n_shingles")), "item")
    found = scratch.table(found.filter(F.col("n_shared") >= F.col("n_shingles") * threshold - 1e-9), "found")
    found = found.join(small(listed.select("item", "item_id")), "item")
    if not row_col:
        found = found.join(texts.join(small(scratch.table(found.select("row").distinct(), "hit")), "row", "left_semi").select("row", "id"), "row")
    return found.select(
        *([F.col("row").alias(row_col)] if row_col else [F.col("id").alias(id_col)]),
        F.col("item_id").alias(item_col), "n_shared", "n_shingles", F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment"),
    )


def op8_decontamination(spark, sf_dir):
    return find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
k AS (SELECT DISTINCT least({SHINGLE}, len(w)) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT r, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, k WHERE len(w) >= k),
bs AS (SELECT DISTINCT i, unnest(list_transform(range(1, len(w) - least({SHINGLE}, len(w)) + 2), lambda j: array_to_string(w[j:j + least({SHINGLE}, len(w)) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT i, count(*) AS n_shingles FROM bs GROUP BY i),
c AS (SELECT r, i, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY r, i)
SELECT doc_id, item_id, n_shared, n_shingles, round(n_shared::DOUBLE / n_shingles, 6) AS containment
FROM c JOIN n USING (i) JOIN d USING (r) JOIN b USING (i) WHERE n_shared >= n_shingles * {THRESHOLD} - 1e-9
"""
