"""Frequent itemsets within groups, and which baskets hold which sets, as joins and aggregations.

Pattern growth without a tree: a basket is the list of its frequent items, most frequent first, and
baskets with equal lists are one row with a count. The conditional baskets of an item are what stands
before it in each list; counting their items by group and suffix finds the longer sets, and each round
grows all suffixes of all groups by one item. What is shuffled are counts by group, suffix and item, so
a group or an item that most baskets have is summed up where it is read and is no task of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stored import sent, stored

#: Groups with fewer baskets have no itemsets: a few baskets support anything.
LEAST_BASKETS = 20
#: Baskets that have to hold a set, however small its group: the share asked for rises as a group shrinks.
LEAST_COUNT = 5


def frequent_itemsets(baskets: DataFrame, group: str, basket: str, item: str, support: float, least_baskets: int = LEAST_BASKETS, least_count: int = LEAST_COUNT) -> DataFrame:
    """group, items (sorted), n, baskets: the sets that at least ``support`` of a group's baskets hold.

    ``baskets`` is long, a row per basket and item; a basket belongs to the groups its rows name. Rows
    with a null in any of the three count for nothing. Of a small group's baskets at least ``least_count``
    have to hold a set, which scales the threshold with the sample: ``max(support, least_count / baskets)``.
    """
    rows = baskets.select(F.col(group).alias("group"), F.col(basket).alias("basket"), F.col(item).alias("item")).dropna().distinct()
    sizes = rows.select("group", "basket").distinct().groupBy("group").agg(F.count("*").alias("baskets"))
    limits = stored(sizes.filter(F.col("baskets") >= least_baskets).withColumn("least", F.greatest(F.ceil(F.col("baskets") * F.lit(support) - 1e-9), F.lit(least_count))), "limits")
    enough = lambda counts: counts.join(sent(limits), "group").filter(F.col("n") >= F.col("least"))
    single = stored(enough(rows.groupBy("group", "item").agg(F.count("*").alias("n"))).select("group", "item", "n", "baskets"), "single")
    placed = rows.join(sent(single.select("group", "item", "n")), ["group", "item"])
    lists = placed.groupBy("group", "basket").agg(_ordered())
    return _grow(lists.groupBy("group", "items").agg(F.count("*").alias("n")), single, enough).withColumnRenamed("group", group)


def itemsets_of(counts: DataFrame, support: float, least_baskets: int = LEAST_BASKETS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``frequent_itemsets`` of contents: group, has, n (how many baskets have just these items)."""
    sizes = counts.groupBy("group").agg(F.sum("n").alias("baskets"))
    limits = stored(sizes.filter(F.col("baskets") >= least_baskets).withColumn("least", F.greatest(F.ceil(F.col("baskets") * F.lit(support) - 1e-9), F.lit(least_count))), "limits")
    enough = lambda found: found.join(sent(limits), "group").filter(F.col("n") >= F.col("least"))
    each = counts.select("group", "has", F.col("n").alias("times"), F.explode("has").alias("item"))
    single = stored(enough(each.groupBy("group", "item").agg(F.sum("times").alias("n"))).select("group", "item", "n", "baskets"), "single")
    lists = each.join(sent(single.select("group", "item", "n")), ["group", "item"]).groupBy("group", "has", "times").agg(_ordered())
    return _grow(lists.groupBy("group", "items").agg(F.sum("times").alias("n")), single, enough)


def _ordered() -> Column:
    """A basket's items, most frequent first: the lists before an item are short, and many of them equal."""
    return F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("place"), "item"))), lambda x: x["item"]).alias("items")


def _grow(lists: DataFrame, single: DataFrame, enough: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All frequent sets from ordered lists (group, items, n), the frequent items and what keeps counts that are high enough."""
    found = [single.select("group", F.array("item").alias("items"), "n", "baskets")]
    grown = stored(_conditional(lists.select("group", F.array().cast(lists.schema["items"].dataType).alias("suffix"), "items", "n")), "conditional")
    while True:
        each = grown.select("group", "suffix", F.explode("items").alias("item"), "n").groupBy("group", "suffix", "item").agg(F.sum("n").alias("n"))
        longer = stored(enough(each).select("group", "suffix", "item", "n", "baskets"), "longer")
        if longer.isEmpty():
            break
        found.append(longer.select("group", F.array_sort(F.concat(F.array("item"), "suffix")).alias("items"), "n", "baskets"))
        grown = stored(_conditional(grown, longer.select("group", "suffix", "item")), "conditional")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _conditional(lists: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """For each item of each list, or those ``among`` them, what stands before it, under the suffix with that item."""
    each = lists.select("group", "suffix", "items", "n", F.posexplode("items").alias("at", "item")).filter("at > 0")
    if among is not None:
        each = each.join(sent(among), ["group", "suffix", "item"])
    each = each.select("group", F.concat(F.array("item"), "suffix").alias("suffix"), F.slice("items", F.lit(1), F.col("at")).alias("items"), "n")
    return each.groupBy("group", "suffix", "items").agg(F.sum("n").alias("n"))


def rules_of(itemsets: DataFrame, group: str, confidence: float = 0.0, lift: float = 0.0) -> DataFrame:
    """group, rule_id, antecedent, consequent (one item), support, confidence, lift from ``frequent_itemsets``."""
    sets = stored(itemsets.select(F.col(group).alias("group"), "items", "n", "baskets"), "itemsets")
    split = sets.filter(F.size("items") > 1).select("group", "items", "n", "baskets", F.explode("items").alias("item"))
    split = split.select("group", F.array_except("items", F.array("item")).alias("antecedent"), F.array("item").alias("consequent"), "n", "baskets")
    known = sets.select("group", "items", "n")
    both = split.join(sent(known.withColumnsRenamed({"items": "antecedent", "n": "n_a"})), ["group", "antecedent"]).join(sent(known.withColumnsRenamed({"items": "consequent", "n": "n_c"})), ["group", "consequent"])
    named = F.concat(F.lit("G"), F.substring(F.sha2(F.concat_ws("|", F.col("group").cast("string"), F.array_join("antecedent", ","), F.array_join("consequent", ",")), 256), 1, 8))
    rules = both.select(
        F.col("group").alias(group), named.alias("rule_id"), "antecedent", "consequent", (F.col("n") / F.col("baskets")).alias("support"),
        (F.col("n") / F.col("n_a")).alias("confidence"), (F.col("n") * F.col("baskets") / (F.col("n_a") * F.col("n_c"))).alias("lift"),
    )
    return rules.filter((F.col("confidence") >= confidence - 1e-9) & (F.col("lift") >= lift - 1e-9))


def contents(baskets: DataFrame, group: str, basket: str, item: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """group, basket, has: what each basket has, or has of its group's ``vocabulary`` (group, item), sorted; stored.

    Baskets with equal contents are judged once: what follows works on ``counts_of`` them, and comes back to
    the baskets by a join. A content is no longer than the vocabulary, or than the kinds of items there are.
    """
    rows = baskets.select(F.col(group).alias("group"), F.col(basket).alias("basket"), F.col(item).alias("item")).dropna()
    if vocabulary is not None:
        rows = rows.join(sent(stored(vocabulary.select("group", "item").distinct(), "vocabulary")), ["group", "item"], "left_semi")
    return stored(rows.groupBy("group", "basket").agg(F.sort_array(F.collect_set("item")).alias("has")), "contents")


def counts_of(lists: DataFrame) -> DataFrame:
    """group, has, n: the distinct contents; stored."""
    return stored(lists.groupBy("group", "has").agg(F.count("*").alias("n")), "counts")


def shares_of(counts: DataFrame) -> DataFrame:
    """group, item, n, share (of the group's baskets)."""
    totals = counts.groupBy("group").agg(F.sum("n").alias("baskets"))
    each = counts.select("group", "n", F.explode("has").alias("item")).groupBy("group", "item").agg(F.sum("n").alias("n"))
    return each.join(totals, "group").select("group", "item", "n", (F.col("n") / F.col("baskets")).alias("share"))


def pairs_of(counts: DataFrame) -> DataFrame:
    """group, antecedent, consequent (the later in the alphabet), n_both, lift."""
    shares, totals = shares_of(counts), counts.groupBy("group").agg(F.sum("n").alias("baskets"))
    first = counts.select("group", "has", "n", F.explode("has").alias("antecedent"))
    both = first.select("group", "n", "antecedent", F.explode(F.filter("has", lambda x: x > F.col("antecedent"))).alias("consequent"))
    both = both.groupBy("group", "antecedent", "consequent").agg(F.sum("n").alias("n_both")).join(totals, "group")
    for side, name in (("antecedent", "n_a"), ("consequent", "n_c")):
        both = both.join(shares.select("group", F.col("item").alias(side), F.col("n").alias(name)), ["group", side])
    return both.select("group", "antecedent", "consequent", "n_both", (F.col("n_both") * F.col("baskets") / (F.col("n_a") * F.col("n_c"))).alias("lift"))


def held(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """group, has, set_id: for each distinct content the sets of its group of which it has every item; stored.

    ``sets``: group, set_id, items (not empty). A set is looked up by its rarest item alone, so an item that
    most contents have brings up only sets of nothing rarer.
    """
    distinct = stored(lists.select("group", "has").distinct(), "distinct")
    each = distinct.select("group", "has", F.explode("has").alias("item"))
    counts = each.groupBy("group", "item").agg(F.count("*").alias("n"))
    parts = sets.select("group", "set_id", "items", F.explode("items").alias("item"))
    rarest = parts.join(counts, ["group", "item"], "left").groupBy("group", "set_id", "items").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "item")).alias("rarest"))
    keys = stored(rarest.select("group", "set_id", "items", F.col("rarest.item").alias("item")), "keys")
    return stored(each.join(sent(keys), ["group", "item"]).filter(F.size(F.array_except("items", "has")) == 0).select("group", "has", "set_id"), "held")


def contained(baskets: DataFrame, sets: DataFrame, group: str, basket: str, item: str) -> DataFrame:
    """basket, group, set_id: the sets of a basket's group of which it holds every item. ``sets``: group, set_id, items (not empty)."""
    sets = stored(sets.select(F.col(group).alias("group"), "set_id", "items"), "sets")
    lists = contents(baskets, group, basket, item, sets.select("group", F.explode("items").alias("item")))
    return lists.join(held(lists, sets), ["group", "has"]).select(F.col("basket").alias(basket), F.col("group").alias(group), "set_id")
