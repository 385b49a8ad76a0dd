"""Read models over rules, findings and extractions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import quantile_band
from ..functions.scalars import money, severity_rank
from ..operators.mining import detect_types

# What a review column holds beside its drafts.
REVIEW_CONFIDENCE = 0.85
REVIEW_SEVERITIES = ("approval_required", "blocker")


def source_of(miner: Column, migrated_from: Column) -> Column:
    return F.coalesce(miner, F.when(migrated_from.isNotNull(), "migrated"), F.lit(""))


def triage(rules: DataFrame, severity: str = "all", applies_to: str = "all", source: str = "all", cluster: str = "all") -> DataFrame:
    """Rules that meet all conditions; "all" is no condition. Columns: severity, applies_to, source, cluster_id."""
    wanted = {"severity": severity, "applies_to": applies_to, "source": source, "cluster_id": cluster}
    for column, value in wanted.items():
        if value != "all":
            rules = rules.filter(F.col(column) == value)
    return rules


def overlay(rules: DataFrame, actions: DataFrame) -> DataFrame:
    """Accepted rules are active, else retired ones retired, else the stored status. ``actions``: rule_id, accepted, retired."""
    got = rules.join(actions, "rule_id", "left")
    return got.withColumn("status", F.when(F.coalesce("accepted", F.lit(False)), "active").when(F.coalesce("retired", F.lit(False)), "retired").otherwise(F.col("status"))).drop("accepted", "retired")


def kanban(rules: DataFrame) -> DataFrame:
    """A row per rule and column it stands in; review overlaps draft."""
    draft = F.col("status") == "draft"
    review = draft & ((F.col("confidence") < REVIEW_CONFIDENCE) | F.col("severity").isin(*REVIEW_SEVERITIES))
    columns = F.array(F.when(draft, "draft"), F.when(review, "review"), F.when(F.col("status") == "active", "active"), F.when(F.col("status") == "retired", "retired"))
    return rules.withColumn("bucket", F.explode(F.filter(columns, lambda b: b.isNotNull())))


def grouped(rules: DataFrame) -> DataFrame:
    """group_kind, group_label, n: domains first, then by label."""
    kind, label = F.coalesce("group_kind", F.lit("cluster")).alias("group_kind"), F.coalesce("group_label", F.lit("Unbound")).alias("group_label")
    return rules.select(kind, label).groupBy("group_kind", "group_label").agg(F.count("*").alias("n")).orderBy(F.col("group_kind") != "domain", "group_label")


def cluster_rail(clusters: DataFrame, rules: DataFrame) -> DataFrame:
    """Clusters with their number of rules, the largest cluster first."""
    counts = rules.groupBy("cluster_id").agg(F.count("*").alias("rules"))
    return clusters.join(counts, "cluster_id", "left").fillna(0, ["rules", "chunk_count"]).orderBy(F.desc("chunk_count"), "cluster_id")


def normalized(rules: DataFrame) -> DataFrame:
    return rules.fillna({"description": "", "status": "draft", "confidence": 1.0})


def severity_palette(own: DataFrame, given: DataFrame) -> DataFrame:
    """Labels and ranks that ``given`` overrides, for known severities only."""
    theirs = given.select("severity", F.col("label").alias("g_label"), F.col("rank").alias("g_rank"))
    return own.join(theirs, "severity", "left").select("severity", F.coalesce("g_label", "label").alias("label"), F.coalesce("g_rank", "rank").alias("rank"))


def shares(counts: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """Each value's percentage within its key, and whether it is the most frequent."""
    w = Window.partitionBy(*keys)
    first = F.row_number().over(w.orderBy(F.desc(n), value)) == 1
    return counts.withColumn("pct", F.col(n) * 100.0 / F.sum(n).over(w)).withColumn("is_mode", first)


def frequency_map(counts: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """keys, frequencies: a map from each value to how often it occurs; for columns of few values."""
    return counts.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(value, n))).alias("frequencies"))


def scale_position(value: Column, low: Column, high: Column) -> Column:
    """Where a value lies between two others, in percent; equal ends count as a span of one."""
    return (value - low) / F.when(high == low, 1.0).otherwise(high - low) * 100


def contrast_bars(rules: DataFrame) -> DataFrame:
    cap = lambda c, k: F.least(F.col(c) * k, F.lit(100.0))
    return rules.withColumn("cluster_bar", cap("cluster_lift", 15)).withColumn("global_bar", cap("global_lift", 15)).withColumn("ratio_bar", cap("lift_ratio", 25))


def corpus_meta(agreements: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: agreement_count, drafts_pending, rules_active, rules_retired."""
    counts = rules.agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in (("draft", "drafts_pending"), ("active", "rules_active"), ("retired", "rules_retired"))))
    return agreements.agg(F.count_distinct("agreement_id").alias("agreement_count")).crossJoin(counts)  # one row each


def cell_severity() -> Column:
    """What a finding shows in the portfolio: its severity if it fails; undecided ones stay apart."""
    return F.when(F.col("outcome") == "fail", F.col("severity")).when(F.col("outcome") == "needs_human", "needs_human").otherwise("pass")


def portfolio(findings: DataFrame, limit: int = 24) -> DataFrame:
    """agreement_id, cells: the first agreements by id, with each rule's severity."""
    ids = findings.select("agreement_id").distinct().orderBy("agreement_id").limit(limit)
    rows = findings.join(ids, "agreement_id").withColumn("severity", cell_severity())
    return rows.groupBy("agreement_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "severity"))).alias("cells"))


def portfolio_bar(findings: DataFrame) -> DataFrame:
    return findings.groupBy("agreement_id", cell_severity().alias("cell")).agg(F.count("*").alias("n"))


def portfolio_matrix(findings: DataFrame, chips: int = 3) -> DataFrame:
    """Per rule and severity: how many agreements, the first few of them, and how many more."""
    rows = findings.select("rule_id", cell_severity().alias("cell"), "agreement_id")
    n = rows.groupBy("rule_id", "cell").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("rule_id", "cell").orderBy("agreement_id"))
    first = rows.withColumn("place", place).filter(F.col("place") <= chips).groupBy("rule_id", "cell").agg(F.sort_array(F.collect_list("agreement_id")).alias("chips"))
    return n.join(first, ["rule_id", "cell"]).withColumn("more", F.greatest(F.col("n") - chips, F.lit(0)))


def severity_tally(findings: DataFrame) -> DataFrame:
    return findings.groupBy(cell_severity().alias("cell")).agg(F.count("*").alias("n")).orderBy(severity_rank(F.col("cell")))


def taxonomy_health(clusters: DataFrame, fields: DataFrame, least_fields: int = 3, least_chunks: int = 5) -> DataFrame:
    """Clusters with too few fields or chunks."""
    n = fields.groupBy("cluster_id").agg(F.count("*").alias("fields"))
    got = clusters.join(n, "cluster_id", "left").fillna(0, ["fields"])
    return got.withColumn("incomplete", F.col("fields") < least_fields).withColumn("small", F.coalesce("chunk_count", F.lit(0)) < least_chunks)


def field_matrix(fields: DataFrame, types: list[str]) -> DataFrame:
    return fields.groupBy("cluster_id").pivot("field_type", types).agg(F.count(F.lit(1))).fillna(0)


def field_rollup(fields: DataFrame, extractions: DataFrame, agreements: DataFrame) -> DataFrame:
    """field_id, name, n, coverage_pct, examples: extractions joined to their fields, top examples cut to 32 characters.

    Coverage is out of the distinct ids in ``agreements``: agreement_id.
    """
    n = extractions.groupBy("field_id").agg(F.count("*").alias("n"), F.count_distinct("agreement_id").alias("have"))
    counts = extractions.groupBy("field_id", F.substring("value", 1, 32).alias("value")).agg(F.count("*").alias("c"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("field_id").orderBy(F.desc("c"), "value"))).filter("place <= 5")
    examples = top.groupBy("field_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("examples"))
    got = fields.join(n, "field_id", "left").join(examples, "field_id", "left").fillna(0, ["n", "have"])
    total = agreements.agg(F.greatest(F.count_distinct("agreement_id"), F.lit(1)).alias("agreements"))
    return got.crossJoin(F.broadcast(total)).withColumn("coverage_pct", F.col("have") * 100.0 / F.col("agreements")).drop("have", "agreements")  # one row


def field_enums(values: DataFrame, key: str, value: str, most: int = 12) -> DataFrame:
    """key, distinct_values, enum_values: the sorted values of a field that has ``most`` at most, else null."""
    each = values.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    k = each.groupBy(key).agg(F.count("*").alias("distinct_values"))
    few = each.join(k.filter(F.col("distinct_values") <= most).select(key), key)
    listed = few.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("enum_values"))
    return k.join(listed, key, "left")


def contract(contexts: DataFrame, agreement_id) -> DataFrame:
    """One agreement's clauses in order: agreement_id, place, id, label, text."""
    one = contexts.filter(F.col("agreement_id") == agreement_id)
    return one.select("agreement_id", F.posexplode("clauses").alias("place", "c")).select("agreement_id", "place", "c.id", "c.label", "c.text")


def cluster_fields(fields: DataFrame, extractions: DataFrame, agreements: DataFrame, cluster) -> DataFrame:
    """``field_rollup`` of the fields of one cluster. ``fields``: field_id, cluster_id."""
    own = fields.filter(F.col("cluster_id") == cluster).select("field_id")
    return field_rollup(own, extractions.join(own, "field_id", "left_semi"), agreements)


def field_ranges(values: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, lo, hi, median of the fields whose values are numbers, amounts of money and percentages too."""
    numeric = detect_types(values, key, value).filter("data_type = 'numeric'").select(key)
    numbers = values.join(numeric, key, "left_semi").withColumn("__number", money(F.col(value)))
    return quantile_band(numbers, [key], "__number")


def redline(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Failed findings beside the language the rule prefers and who to ask."""
    r = rules.select("rule_id", "title", "preferred_language", F.col("escalation_owner").alias("owner"))
    return findings.filter("outcome = 'fail'").join(r, "rule_id").select("agreement_id", "rule_id", "title", F.get("evidence", F.lit(0))["text"].alias("clause"), "preferred_language", "owner")


def _whole_percent(share: Column) -> Column:
    """Rounded half up."""
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def _tenths(x: Column) -> Column:
    tenths = F.floor(x * 10 + 0.5)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))


def trust(rules: DataFrame) -> DataFrame:
    """What a rule's trust rests on, as shown: lift to one place, support and confidence in percent, n.

    ``rules``: lift, support, n, confidence, each of which may be null.
    """
    none = F.lit("—")
    return rules.withColumns({
        "lift_shown": F.coalesce(F.concat(_tenths(F.col("lift")), F.lit("×")), none), "support_shown": F.coalesce(_whole_percent(F.col("support")), none),
        "n_shown": F.coalesce("n", F.lit(0)), "confidence_shown": _whole_percent(F.coalesce("confidence", F.lit(0.0))),
    })


def provenance_label(source: Column) -> Column:
    """Where a rule comes from, in a few words. ``source``: a struct of miner, migrated_from, n and the miners' figures."""
    s = lambda name: source[name].cast("string")
    n = F.concat(F.lit(" · n="), s("n"))
    return (
        F.when(source["miner"] == "coverage", F.concat(F.lit("Coverage "), _whole_percent(source["ratio"]), n))
        .when(source["miner"] == "distribution", F.concat(F.lit("Distribution p10–p90 ["), s("p10"), F.lit(", "), s("p90"), F.lit("] · median "), s("median")))
        .when(source["miner"] == "categorical", F.concat(F.lit('Mode "'), s("mode"), F.lit('" '), _whole_percent(source["frequency"]), n))
        .when(source["miner"] == "outlier", F.concat(F.lit("Outlier "), _whole_percent(source["outlier_pct"]), F.lit(" off-curve"), n))
        .when(source["miner"] == "contrastive", F.concat(F.lit("Lift ratio "), F.format_string("%.2f", source["lift_ratio"]), F.lit("×"), n))
        .when(source["migrated_from"].isNotNull(), F.concat(F.lit("Migrated from "), s("migrated_from")))
        .otherwise("—")
    )


def bootstrap(findings: DataFrame) -> DataFrame:
    """The findings of the portfolio's first agreement, what a reader sees before choosing one."""
    first = findings.agg(F.min("agreement_id").alias("agreement_id"))  # one row
    return findings.join(F.broadcast(first), "agreement_id").orderBy(severity_rank(F.col("severity")), "rule_id")


def snapshot(**parts: DataFrame) -> DataFrame:
    """One row: each part, a small report, as a JSON array in the order of its columns' values."""
    out = None
    for name, df in parts.items():
        rows = df.select(F.to_json(F.struct(*df.columns)).alias("row")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("row")), ","), F.lit("]")).alias(name))
        out = rows if out is None else out.crossJoin(rows)  # one row each
    return out


def predicate_text(predicate: Column) -> Column:
    """A JSON predicate tree as a line of text, per row where the rules are; null for null, the text itself if it is no JSON."""
    import pandas as pd

    from ..functions.predicates import describe

    @F.pandas_udf("string")
    def told(trees):
        def one(tree):
            try:
                return None if tree is None else describe(json.loads(tree))
            except ValueError:
                return tree

        return pd.Series([one(t) for t in trees], dtype=object)

    return told(predicate)
