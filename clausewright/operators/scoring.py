"""Scores documents by what they lack or have beyond expectation, and reports on the portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import order_statistics
from ..functions.stored import sent, stored
from .itemsets import contents, held, pairs_of, shares_of

# Weights, multipliers and tiers of the deviation score.
WEIGHTS = {"missing_arm_consequent": 3.0, "missing_expected": 2.0, "unexpected_clause": 1.5, "rare_combination": 1.0}
MULTIPLIERS = {"prevalence_gap": 2.0, "confidence": 1.5, "lift": 0.5}
HIGH, MEDIUM = 5.0, 2.5


def tier(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").when(score > 0, "low").otherwise("none")


def missing_expected(present: DataFrame, expected: DataFrame, document: str, group: str, label: str) -> DataFrame:
    """One flag per document and expected label it lacks. ``expected``: group, label, share."""
    documents = present.select(document, group).distinct()
    wanted = documents.join(expected.select(group, label, "share"), group)
    return wanted.join(present.select(document, label).distinct(), [document, label], "left_anti")


def unexpected(present: DataFrame, shares: DataFrame, document: str, group: str, label: str, rare: float = 0.2) -> DataFrame:
    """One flag per document and label it has although few of its group's documents do.

    ``shares``: group, label, share. The rarer the label, the larger ``prevalence_gap``.
    """
    few = shares.filter(F.col("share") < rare).select(group, label, (1 - F.col("share")).alias("prevalence_gap"))
    return present.select(document, group, label).distinct().join(few, [group, label])


def absent_consequents(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """group, has, label, rule_id, confidence, lift: what contents lack although rules of their group let it be expected.

    ``counts``: group, has; ``rules``: group, rule_id, antecedent and consequent (arrays of labels), confidence,
    lift. A rule speaks where all its antecedents are present; of several that miss the same label the one
    with the highest lift, then confidence, then the first id is named.
    """
    rules = stored(rules.select("group", "rule_id", "antecedent", "consequent", "confidence", "lift"), "rules")
    speaking = held(counts, rules.select("group", F.col("rule_id").alias("set_id"), F.col("antecedent").alias("items")))
    due = speaking.withColumnRenamed("set_id", "rule_id").join(sent(rules), ["group", "rule_id"]).select("group", "has", "rule_id", "confidence", "lift", F.explode("consequent").alias("label"))
    best = due.filter(~F.array_contains("has", F.col("label"))).groupBy("group", "has", "label").agg(F.min(F.struct((-F.col("lift")).alias("l"), (-F.col("confidence")).alias("c"), "rule_id")).alias("best"))
    return stored(best.select("group", "has", "label", "best.rule_id", (-F.col("best.c")).alias("confidence"), (-F.col("best.l")).alias("lift")), "absent")


def present_combinations(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """group, has, items, lift: the pairs that contents have. ``pairs``: group, antecedent, consequent, lift; each in either order once."""
    told = stored(pairs.filter("antecedent < consequent").select("group", F.concat_ws("\x1f", "antecedent", "consequent").alias("set_id"), F.array("antecedent", "consequent").alias("items"), "lift"), "pairs")
    return stored(held(counts, told.select("group", "set_id", "items")).join(sent(told), ["group", "set_id"]).select("group", "has", "items", "lift"), "combinations")


def missing_consequents(present: DataFrame, rules: DataFrame, document: str, group: str, label: str) -> DataFrame:
    """``absent_consequents`` of each document: document, group, label, rule_id, confidence, lift."""
    rules = stored(rules.withColumnRenamed(group, "group"), "rules")
    lists = contents(present, group, document, label, rules.select("group", F.explode(F.concat("antecedent", "consequent")).alias("item")))
    flags = lists.join(sent(absent_consequents(lists, rules)), ["group", "has"])
    return flags.select(F.col("basket").alias(document), F.col("group").alias(group), F.col("label").alias(label), "rule_id", "confidence", "lift")


def rare_combinations(present: DataFrame, pairs: DataFrame, document: str, group: str, label: str) -> DataFrame:
    """``present_combinations`` of each document: document, group, items, lift. ``pairs`` as ``pair_rules`` gives them."""
    pairs = stored(pairs.withColumnRenamed(group, "group").select("group", "antecedent", "consequent", "lift"), "pairs")
    lists = contents(present, group, document, label, pairs.select("group", F.explode(F.array("antecedent", "consequent")).alias("item")))
    flags = lists.join(sent(present_combinations(lists, pairs)), ["group", "has"])
    return flags.select(F.col("basket").alias(document), F.col("group").alias(group), "items", "lift")


def content_flags(counts: DataFrame, rules: DataFrame, expected: float, rare: float, pair_lift: float, pair_share: float) -> DataFrame:
    """group, has, kind, about, rule_id, prevalence_gap, confidence, lift: flags of all four kinds, once for each content; stored.

    ``counts``: group, has, n. Expected are labels of at least the share ``expected``, unexpected those below
    ``rare``; combinations are rare whose lift is below ``pair_lift`` though each label has at least ``pair_share``.
    """
    shares = stored(shares_of(counts), "shares")
    none = lambda name, kind="double": F.lit(None).cast(kind).alias(name)
    arm = absent_consequents(counts, rules).select("group", "has", F.lit("missing_arm_consequent").alias("kind"), F.col("label").alias("about"), "rule_id", none("prevalence_gap"), "confidence", "lift")
    due = counts.join(sent(shares.filter(F.col("share") >= expected)).select("group", "item", "share"), "group").filter(~F.array_contains("has", F.col("item")))
    due = due.select("group", "has", F.lit("missing_expected").alias("kind"), F.col("item").alias("about"), none("rule_id", "string"), F.col("share").alias("prevalence_gap"), none("confidence"), none("lift"))
    odd = counts.select("group", "has", F.explode("has").alias("item")).join(sent(shares.filter(F.col("share") < rare)).select("group", "item", "share"), ["group", "item"])
    odd = odd.select("group", "has", F.lit("unexpected_clause").alias("kind"), F.col("item").alias("about"), none("rule_id", "string"), (1 - F.col("share")).alias("prevalence_gap"), none("confidence"), none("lift"))
    usual = shares.filter(F.col("share") >= pair_share).select("group", "item")
    pairs = pairs_of(counts).filter(F.col("lift") < pair_lift)
    for side in ("antecedent", "consequent"):
        pairs = pairs.join(usual.withColumnRenamed("item", side), ["group", side], "left_semi")
    seldom = present_combinations(counts, pairs).select("group", "has", F.lit("rare_combination").alias("kind"), F.array_join("items", "+").alias("about"), none("rule_id", "string"), none("prevalence_gap"), none("confidence"), "lift")
    return stored(arm.unionByName(due).unionByName(odd).unionByName(seldom), "flags")


def deviation_score(flags: DataFrame, document: str | list[str], *more: Column) -> DataFrame:
    """document, score, the aggregates ``more``, tier. ``flags``: document, kind, prevalence_gap, confidence, lift (each may be null).

    A flag adds its kind's weight times one plus the weighted evidence it carries; this formula is
    ours, since the weights are all that is given.
    """
    weight = F.lit(0.0)
    for kind, w in WEIGHTS.items():
        weight = F.when(F.col("kind") == kind, w).otherwise(weight)
    evidence = F.lit(1.0)
    for name, m in MULTIPLIERS.items():
        evidence = evidence + m * F.coalesce(F.col(name), F.lit(0.0))
    got = flags.groupBy(*([document] if isinstance(document, str) else document)).agg(F.sum(weight * evidence).alias("score"), *more)
    return got.withColumn("tier", tier(F.col("score")))


def portfolio_report(scores: DataFrame, group: str) -> DataFrame:
    """group, documents, mean, max and number of high scores."""
    return scores.groupBy(group).agg(F.count("*").alias("documents"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.count_if(F.col("tier") == "high").alias("high"))


def severity_buckets(scores: DataFrame) -> DataFrame:
    return scores.groupBy("tier").agg(F.count("*").alias("n"))


def top_outliers(scores: DataFrame, document: str, share: float = 0.1) -> DataFrame:
    """The documents with the highest scores, ``share`` of all, ties at the border by id (a number).

    The scores are stored once. The border's score and, among its ties, the last id are order statistics
    and come back as two numbers; then the rows are a filter, and nothing is sorted as a whole.
    """
    scores = stored(scores, "scores")
    place = lambda n: n - F.ceil(n * F.lit(share) - 1e-9)
    border = order_statistics(scores.select(F.lit(0).alias("one"), "score"), ["one"], "score", {"border": place}).select("border", F.ceil(F.col("n") * F.lit(share) - 1e-9).alias("wanted")).first()
    if border is None:
        return scores.limit(0)
    room = border.wanted - scores.filter(F.col("score") > border.border).count()
    ties = scores.filter(F.col("score") == border.border).select(F.lit(0).alias("one"), F.col(document).alias("id"))
    last = order_statistics(ties, ["one"], "id", {"last": lambda n: F.least(F.lit(room), n) - 1}).first().last
    return scores.filter((F.col("score") > border.border) | ((F.col("score") == border.border) & (F.col(document) <= last)))


def most_missing(flags: DataFrame, label: str, k: int = 10) -> DataFrame:
    return flags.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(k)


def share_of_total(df: DataFrame, keys: list[str], value: str) -> Column:
    return F.col(value) / F.sum(value).over(Window.partitionBy(*keys))
