"""Exact order statistics of large groups without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

#: Value ranges a group is cut into; only those that hold a wanted rank are sorted.
RANGES = 1024


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per group: its keys, n, and for each name the value at that 0-based rank.

    Repeated values are counted before anything is ordered. Each group's values fall into
    ``RANGES`` ranges, equal in the logarithm of their distance from zero, so that a few far values
    don't crowd all others into one range; cumulative counts over these tell which range holds a
    rank, and only that range's distinct values are put in order. The counts are stored, so the input is
    read once.
    """
    counted = stored(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c")), "ranks")
    spans = counted.groupBy(*keys).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.sum("__c").alias("n"))
    scaled = lambda c: F.signum(F.col(c).cast("double")) * F.log1p(F.abs(F.col(c).cast("double")))  # noqa: E731  never falls as the value rises
    width = F.when(scaled("__high") > scaled("__low"), (scaled("__v") - scaled("__low")) / (scaled("__high") - scaled("__low"))).otherwise(F.lit(0.0))
    placed = counted.join(spans, keys).withColumn("__r", F.least(F.floor(width * RANGES), F.lit(RANGES - 1)))
    per_range = placed.groupBy(*keys, "__r", "n").agg(F.sum("__c").alias("__c"))
    up_to = Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_range = per_range.withColumn("__to", F.sum("__c").over(up_to)).withColumn("__from", F.col("__to") - F.col("__c"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), f(F.col("n")).cast("long").alias("rank")) for name, f in ranks.items()))
    asked = per_range.select(*keys, "__r", "__from", "__to", F.inline(wanted)).filter((F.col("rank") >= F.col("__from")) & (F.col("rank") < F.col("__to")))
    inside = placed.select(*keys, "__r", "__v", "__c").join(asked, [*keys, "__r"])
    running = Window.partitionBy(*keys, "name").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("__seen", F.col("__from") + F.sum("__c").over(running))
    found = inside.filter(F.col("__seen") > F.col("rank")).groupBy(*keys).agg(*(F.min(F.when(F.col("name") == name, F.col("__v"))).alias(name) for name in ranks))
    return spans.select(*keys, "n").join(found, keys)


def floor_rank(q: float) -> Callable[[Column], Column]:
    return lambda n: F.floor(F.lit(q) * (n - 1))


def quantile_band(df: DataFrame, keys: list[str], value: str, low: float = 0.10, high: float = 0.90) -> DataFrame:
    """keys, n, lo, hi, median: floor-index quantiles and the mean of the two middle values."""
    got = order_statistics(df, keys, value, {"lo": floor_rank(low), "hi": floor_rank(high), "__m1": lambda n: F.floor((n - 1) / 2), "__m2": lambda n: F.floor(n / 2)})
    return got.withColumn("median", (F.col("__m1") + F.col("__m2")) / 2).drop("__m1", "__m2")
