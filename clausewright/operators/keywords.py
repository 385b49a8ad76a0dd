"""Keywords of clusters: class-based TF-IDF, then a choice that avoids saying the same twice.

All texts of a cluster count as one. A word weighs by its share of the cluster's words times the
logarithm of one plus the mean number of words a cluster has over the word's number in all clusters.
Of a cluster's heaviest words maximal marginal relevance takes one after the other: weight, less the
likeness to those taken. Likeness is by the clusters that words stand in: the cosine of their weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stored import sent, stored

WORD = r"[\p{L}]{3,}"


def word_counts(texts: DataFrame, cluster: str, text: str, pattern: str = WORD) -> DataFrame:
    """cluster, word, n: lower-case words that match ``pattern``, counted over whole texts; null clusters count for nothing."""
    each = texts.filter(F.col(cluster).isNotNull()).select(F.col(cluster).alias("cluster"), F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))).alias("word"))
    return each.groupBy("cluster", "word").agg(F.count("*").alias("n")).withColumnRenamed("cluster", cluster)


def weights(counts: DataFrame, cluster: str) -> DataFrame:
    """cluster, word, n, weight."""
    counts = stored(counts.select(F.col(cluster).alias("cluster"), "word", "n"), "counts")
    totals = stored(counts.groupBy("cluster").agg(F.sum("n").alias("words")), "totals")
    mean = totals.agg(F.avg("words").alias("mean")).first().mean or 0.0
    overall = counts.groupBy("word").agg(F.sum("n").alias("all"))
    both = counts.join(sent(totals), "cluster").join(overall, "word")
    return both.select(F.col("cluster").alias(cluster), "word", "n", (F.col("n") / F.col("words") * F.log1p(F.lit(float(mean)) / F.col("all"))).alias("weight"))


def keywords(weighted: DataFrame, cluster: str, k: int = 5, candidates: int = 30, diversity: float = 0.3) -> DataFrame:
    """cluster, place (from 1), word, weight: ``k`` of each cluster's ``candidates`` heaviest words.

    Each place goes to the word with the largest ``(1 - diversity) * weight / heaviest weight - diversity *
    likeness to the most alike word taken``, ties to the first in the alphabet. Places are filled round by
    round for all clusters together; candidates are so few that their pairs are few, too.
    """
    rows = stored(weighted.select(F.col(cluster).alias("cluster"), "word", "weight"), "weights")
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("weight", 12)), "word"))).filter(F.col("at") <= candidates)
    top = stored(ranked.withColumn("relevance", F.col("weight") / F.max("weight").over(Window.partitionBy("cluster"))), "candidates")
    # A word's profile over all clusters tells how alike words are; only candidates' profiles meet.
    profile = stored(rows.join(sent(top.select("word").distinct()), "word"), "profiles")
    size = stored(profile.groupBy("word").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size")), "sizes")
    pairs = top.select("cluster", F.col("word").alias("a")).join(top.select("cluster", F.col("word").alias("b")), "cluster").filter("a <> b")
    of = lambda c: profile.select(F.col("cluster").alias("of"), F.col("word").alias(c), F.col("weight").alias(f"w_{c}"))
    dots = pairs.select("a", "b").distinct().join(of("a"), "a").join(of("b"), ["of", "b"]).groupBy("a", "b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("dot"))
    sized = dots.join(size.select(F.col("word").alias("a"), F.col("size").alias("size_a")), "a").join(size.select(F.col("word").alias("b"), F.col("size").alias("size_b")), "b")
    alike = stored(sized.select("a", "b", (F.col("dot") / (F.col("size_a") * F.col("size_b"))).alias("likeness")), "likeness")
    left = top.select("cluster", "word", "weight", "relevance", F.lit(0.0).alias("nearest"))
    taken = []
    for place in range(1, k + 1):
        left = stored(left, "left")
        score = F.round((1 - diversity) * F.col("relevance") - diversity * F.col("nearest"), 12)
        best = stored(left.groupBy("cluster").agg(F.min(F.struct((-score).alias("s"), "word", "weight")).alias("best")).select("cluster", "best.word", "best.weight"), "best")
        taken.append(best.select("cluster", F.lit(place).alias("place"), "word", "weight"))
        near = best.select("cluster", F.col("word").alias("b")).join(alike, "b").select("cluster", F.col("a").alias("word"), "likeness")
        left = left.join(best.select("cluster", "word"), ["cluster", "word"], "left_anti").join(near, ["cluster", "word"], "left")
        left = left.select("cluster", "word", "weight", "relevance", F.greatest("nearest", F.coalesce("likeness", F.lit(0.0))).alias("nearest"))
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("cluster", cluster)
