"""Associations between items of baskets: pairs by join, itemsets by FP-growth, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Thresholds for all baskets and for rules across clause types.
GLOBAL = {"support": 0.01, "confidence": 0.5, "lift": 1.2, "limit": 1000}
CROSS_CLAUSE = {"support": 0.005, "confidence": 0.4, "lift": 1.3, "limit": 500}
LEAST_BASKETS = 20


def pair_rules(baskets: DataFrame, basket: str = "basket", item: str = "item", groups: tuple[str, ...] = ()) -> DataFrame:
    """groups, antecedent, consequent, n_both, n, support, confidence, lift for ordered pairs of items.

    ``baskets`` is long: one row per basket and item. Pairs meet by basket, so their number is
    bounded by the squares of baskets' distinct items, not of the rows.
    """
    g = list(groups)
    rows = baskets.select(*g, F.col(basket).alias("basket"), F.col(item).alias("item")).filter("item is not null").distinct()
    n = rows.groupBy(*g).agg(F.count_distinct("basket").alias("n"))
    single = rows.groupBy(*g, "item").agg(F.count("*").alias("n_item"))
    left, right = rows.withColumnRenamed("item", "antecedent"), rows.withColumnRenamed("item", "consequent")
    both = left.join(right, [*g, "basket"]).filter("antecedent <> consequent").groupBy(*g, "antecedent", "consequent").agg(F.count("*").alias("n_both"))
    both = both.join(single.withColumnsRenamed({"item": "antecedent", "n_item": "n_a"}), [*g, "antecedent"]).join(single.withColumnsRenamed({"item": "consequent", "n_item": "n_c"}), [*g, "consequent"])
    both = both.join(n, g) if g else both.crossJoin(n)  # without groups n is one row
    return both.select(
        *g, "antecedent", "consequent", "n_both", "n", (F.col("n_both") / F.col("n")).alias("support"), (F.col("n_both") / F.col("n_a")).alias("confidence"),
        (F.col("n_both") * F.col("n") / (F.col("n_a") * F.col("n_c"))).alias("lift"),
    )


def itemset_rules(baskets: DataFrame, basket: str, item: str, support: float, confidence: float) -> DataFrame:
    """Rules with several antecedents by FP-growth; empty below ``LEAST_BASKETS`` baskets, where it would blow up."""
    from pyspark.ml.fpm import FPGrowth

    lists = baskets.filter(F.col(item).isNotNull()).groupBy(basket).agg(F.sort_array(F.collect_set(item)).alias("items"))
    if lists.limit(LEAST_BASKETS).count() < LEAST_BASKETS:
        return baskets.sparkSession.createDataFrame([], "antecedent array<string>, consequent array<string>, confidence double, lift double, support double")
    return FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(lists).associationRules


def contrastive(per_group: DataFrame, overall: DataFrame, groups: list[str], least: float = 2.0, globally_below: float = 1.5, ratio: float = 2.0) -> DataFrame:
    """Rules stronger within a group than overall; a pair unknown overall has lift 0 there."""
    known = overall.select("antecedent", "consequent", F.col("lift").alias("global_lift"))
    both = per_group.select(*groups, "antecedent", "consequent", F.col("lift").alias("cluster_lift")).join(known, ["antecedent", "consequent"], "left")
    both = both.withColumn("global_lift", F.coalesce("global_lift", F.lit(0.0))).withColumn("exact", F.col("cluster_lift") / F.greatest("global_lift", F.lit(0.01)))
    kept = both.filter((F.col("cluster_lift") > least) & ((F.col("global_lift") < globally_below) | (F.col("exact") > ratio)))
    return kept.withColumn("lift_ratio", F.round("exact", 2)).drop("exact")


def strong(rules: DataFrame, support: float, confidence: float, lift: float, limit: int) -> DataFrame:
    """Rules above all three thresholds, at most ``limit``: the highest lift first, ties by names."""
    kept = rules.filter((F.col("support") >= support) & (F.col("confidence") >= confidence) & (F.col("lift") >= lift))
    return kept.orderBy(F.desc("lift"), "antecedent", "consequent").limit(limit)


def cross_clause(rules: DataFrame, types: DataFrame, **thresholds) -> DataFrame:
    """Rules whose consequent has a clause type that the antecedent has not. ``types``: item, clause_type."""
    kinds = types.groupBy("item").agg(F.collect_set("clause_type").alias("types"))
    kept = rules.join(kinds.withColumnsRenamed({"item": "antecedent", "types": "ta"}), "antecedent").join(kinds.withColumnsRenamed({"item": "consequent", "types": "tc"}), "consequent")
    kept = strong(kept.filter(F.size(F.array_except("tc", "ta")) > 0).withColumnsRenamed({"ta": "antecedent_clauses", "tc": "consequent_clauses"}), **(CROSS_CLAUSE | thresholds))
    return kept.withColumn("rule_id", F.concat(F.lit("XC"), F.substring(F.sha2(F.concat_ws("|", "antecedent", "consequent"), 256), 1, 8)))


def cross_clause_sets(rules: DataFrame, types: DataFrame, **thresholds) -> DataFrame:
    """``cross_clause`` for rules of several items, as ``itemset_rules`` gives them: arrays of items."""
    kinds = types.select("item", "clause_type").distinct()
    made = rules.withColumn("rule_id", F.concat(F.lit("XC"), F.substring(F.sha2(F.concat_ws("|", F.array_join(F.array_sort("antecedent"), ","), F.array_join(F.array_sort("consequent"), ",")), 256), 1, 8)))
    side = lambda name, out: made.select("rule_id", F.explode(name).alias("item")).join(kinds, "item").groupBy("rule_id").agg(F.sort_array(F.collect_set("clause_type")).alias(out))
    both = made.join(side("antecedent", "antecedent_clauses"), "rule_id").join(side("consequent", "consequent_clauses"), "rule_id")
    return strong(both.filter(F.size(F.array_except("consequent_clauses", "antecedent_clauses")) > 0), **(CROSS_CLAUSE | thresholds))


def cluster_names(shares: DataFrame, overall: DataFrame, cluster: str, item: str, least: float = 0.3, k: int = 3) -> DataFrame:
    """cluster, name: the items most over-represented in a cluster, joined; ties by item."""
    both = shares.filter(F.col("share") >= least).join(overall.withColumnRenamed("share", "g"), item, "left")
    both = both.withColumn("ratio", F.col("share") / F.coalesce("g", F.lit(0.01)))
    top = both.withColumn("place", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(F.round("ratio", 9)), item))).filter(F.col("place") <= k)
    return top.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", item))), lambda x: x[item]), " + ").alias("name"))


def cooccurrence(baskets: DataFrame, basket: str, item: str) -> DataFrame:
    """a, b, n_both, jaccard for unordered pairs of items."""
    rows = baskets.select(F.col(basket).alias("basket"), F.col(item).alias("item")).filter("item is not null").distinct()
    single = rows.groupBy("item").agg(F.count("*").alias("n"))
    both = rows.withColumnRenamed("item", "a").join(rows.withColumnRenamed("item", "b"), "basket").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n_both"))
    both = both.join(single.withColumnsRenamed({"item": "a", "n": "na"}), "a").join(single.withColumnsRenamed({"item": "b", "n": "nb"}), "b")
    return both.select("a", "b", "n_both", (F.col("n_both") / (F.col("na") + F.col("nb") - F.col("n_both"))).alias("jaccard"))
