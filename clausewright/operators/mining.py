"""Mines draft rules from corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import quantile_band
from ..functions.scalars import cosine, prevalence_tier, truncated_id

# Thresholds of the candidate kinds.
COVERAGE = 0.90
MODE_SHARE = 0.70
LOW, HIGH = 0.10, 0.90
LEAST_VALUES = 5
REBIND_SIMILARITY = 0.85
#: Vectors of the small side of an argmax that may be sent to every executor.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 64 << 20

# Plausible bounds of known fields, and by the ending of other fields' names.
BOUNDS_BY_FIELD = {"notice_period_days": (0, 365), "cure_period_days": (0, 180), "survival_period_years": (0, 25), "ownership_threshold_percent": (0, 100), "number_of_arbitrators": (1, 9)}
BOUNDS_BY_NAME = {"_days": (0, 730), "_hours": (0, 720), "_months": (0, 120), "_years": (0, 50), "_percent": (0, 100)}

# Starts of the buckets by the largest value that a ladder serves.
LADDERS = (
    (10, (0, 2, 4, 6)),
    (30, (0, 8, 15)),
    (100, (0, 26, 51, 76)),
    (365, (0, 31, 91, 181)),
    (1000, (0, 101, 251, 501)),
    (float("inf"), (0, 101, 1001, 10001)),
)
# The one set of bins for all fields, where no ladder is asked for.
FIXED_BINS = (0, 7, 30, 60, 90, 180, 365)


def coverage(clauses: DataFrame, threshold: float = COVERAGE, domain: str = "domain", agreement: str = "agreement_id", label: str = "label") -> DataFrame:
    """domain, label, n, total, ratio: labels that enough of a domain's agreements have."""
    totals = clauses.groupBy(domain).agg(F.count_distinct(agreement).alias("total"))
    each = clauses.filter(F.col(label).isNotNull()).groupBy(domain, label).agg(F.count_distinct(agreement).alias("n"))
    return each.join(totals, domain).withColumn("ratio", F.col("n") / F.greatest(F.col("total"), F.lit(1))).filter(F.col("ratio") >= threshold)


def coverage_with_baseline(clauses: DataFrame, threshold: float = COVERAGE, domain: str = "domain", agreement: str = "agreement_id", label: str = "label") -> DataFrame:
    """``coverage`` with the label's share over all domains."""
    total = clauses.agg(F.count_distinct(agreement).alias("all"))
    overall = clauses.groupBy(label).agg(F.count_distinct(agreement).alias("have")).crossJoin(total)  # one row: the total
    return coverage(clauses, threshold, domain, agreement, label).join(overall.select(label, (F.col("have") / F.col("all")).alias("global_baseline")), label)


def distribution(values: DataFrame, keys: list[str], value: str, least: int = LEAST_VALUES, low: float = LOW, high: float = HIGH) -> DataFrame:
    """keys, n, lo, hi, median for groups with enough numeric values."""
    return quantile_band(values.filter(~F.isnan(F.col(value).cast("double"))), keys, value, low, high).filter(F.col("n") >= least)


def suspicious_spread(bands: DataFrame, factor: float = 100) -> DataFrame:
    """Bands whose ends are so far apart that units were probably mixed."""
    return bands.withColumn("suspicious", F.coalesce((F.col("lo") > 0) & (F.col("hi") / F.col("lo") >= factor), F.lit(False)))


def categorical_mode(values: DataFrame, key: str = "field", value: str = "value", threshold: float = MODE_SHARE) -> DataFrame:
    """key, value, n, share: the most frequent value of a field, ties by value, if frequent enough."""
    counts = values.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct(-F.col("n"), F.col(value))).alias("best"), F.sum("n").alias("total"))
    return best.select(key, F.col(f"best.{value}").alias(value), (-F.col("best.col1")).alias("n"), (-F.col("best.col1") / F.col("total")).alias("share")).filter(F.col("share") >= threshold)


def centroids(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """key, centroid: the mean vector; sums of whole vectors are partial, so a hot cluster sends one row a task."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = Summarizer.mean(array_to_vector(F.col(embedding).cast("array<double>")))
    return vectors.filter(F.col(embedding).isNotNull()).groupBy(key).agg(vector_to_array(mean).alias("centroid"))


def centroid_similarity(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """Every vector's cosine to the centroid of its cluster; the centroids, one row a cluster, are the small side."""
    return vectors.join(centroids(vectors, key, embedding), key).withColumn("similarity", cosine(F.col(embedding), F.col("centroid"))).drop("centroid")


def outliers(vectors: DataFrame, key: str, embedding: str, least: float) -> DataFrame:
    """key, n, outliers, outlier_share: how much of a cluster is less similar to its centroid than ``least``."""
    s = centroid_similarity(vectors, key, embedding)
    return s.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("similarity") < least).alias("outliers")).withColumn("outlier_share", F.col("outliers") / F.col("n"))


def rank_candidates(flags: DataFrame, rule: str = "rule_id", agreement: str = "agreement_id", flagged: str = "flagged", resamples: int = 5, seed: int = 17) -> DataFrame:
    """rule, flag_rate, stability, score: the rate of flagged agreements times its agreement across resamples.

    Resample ``k`` leaves out the agreements whose seeded digest falls into bucket ``k``; stability is
    one less the spread of the rates.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(agreement).cast("string")).cast("binary"))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % resamples
    hit = F.col(flagged).cast("double")
    rates = [F.avg(F.when(bucket != k, hit)).alias(f"r{k}") for k in range(resamples)]
    got = flags.groupBy(rule).agg(F.avg(hit).alias("flag_rate"), *rates)
    all_rates = F.filter(F.array(*(F.col(f"r{k}") for k in range(resamples))), lambda x: x.isNotNull())
    got = got.withColumn("stability", F.coalesce(1 - (F.array_max(all_rates) - F.array_min(all_rates)), F.lit(0.0)))
    return got.select(rule, "flag_rate", "stability", (F.col("flag_rate") * F.col("stability")).alias("score"))


def preview(scored: DataFrame, rule: str, item: str, deviation: str, k: int = 3) -> DataFrame:
    """The ``k`` most aligned and the ``k`` most deviating items of each rule."""
    near = Window.partitionBy(rule).orderBy(F.col(deviation), F.col(item))
    far = Window.partitionBy(rule).orderBy(F.col(deviation).desc(), F.col(item))
    pick = lambda w, side: scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select(rule, item, deviation, "place", F.lit(side).alias("side"))
    return pick(near, "aligned").unionByName(pick(far, "deviating"))


def soft_rebind(bindings: DataFrame, clusters: DataFrame, least: float = REBIND_SIMILARITY) -> DataFrame:
    """binding_id, cluster_id, confidence, rebound: the most similar cluster, ties by id.

    ``bindings``: binding_id, label_embedding; ``clusters``: cluster_id, embedding. Every binding is
    scored against all clusters, a stated query set against a table of one row a cluster. Up to
    ``BROADCAST_ROWS`` clusters of ``BROADCAST_BYTES`` go to the tasks in one piece; more are dealt
    into blocks of that many rows, each binding meets each block, and only its best cluster of a
    block goes on.
    """
    size = clusters.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("embedding") * 8), F.lit(0)).alias("bytes")).first()
    score = cosine(F.col("label_embedding"), F.col("embedding")).alias("confidence")
    if size.rows <= BROADCAST_ROWS and size.bytes <= BROADCAST_BYTES:
        scored = bindings.crossJoin(F.broadcast(clusters)).select("binding_id", "cluster_id", score)
    else:
        blocks = max(-(-size.rows // BROADCAST_ROWS), -(-size.bytes // BROADCAST_BYTES))
        dealt = clusters.withColumn("block", F.pmod(F.xxhash64("cluster_id"), F.lit(blocks)))
        asked = bindings.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        scored = asked.join(dealt, "block").select("binding_id", "cluster_id", score)
    best = scored.groupBy("binding_id").agg(F.min(F.struct((-F.col("confidence")).alias("far"), "cluster_id")).alias("best"))
    return best.select("binding_id", "best.cluster_id", (-F.col("best.far")).alias("confidence"), (-F.col("best.far") >= least).alias("rebound"))


def in_bounds(field: Column, value: Column, named: dict[str, tuple[float, float]] | None = None) -> Column:
    """Whether a number is plausible for its field: by the field's own bounds, else by its name's ending."""
    out = F.lit(True)
    for ending, (low, high) in reversed(BOUNDS_BY_NAME.items()):
        out = F.when(F.contains(field, F.lit(ending)), value.between(low, high)).otherwise(out)
    for name, (low, high) in (BOUNDS_BY_FIELD | (named or {})).items():
        out = F.when(field == name, value.between(low, high)).otherwise(out)
    return out


def bucket_start(value: Column, largest: Column) -> Column:
    """The start of the value's bucket on the ladder for the field's largest value.

    Buckets are half open, so a number between two whole ones has a bucket too.
    """
    out = F.lit(None).cast("double")
    for top, starts in reversed(LADDERS):
        out = _start(value, starts) if top == float("inf") else F.when(largest <= top, _start(value, starts)).otherwise(out)
    return out


def fixed_bin(value: Column) -> Column:
    """The start of the value's bin of ``FIXED_BINS``; null below the first."""
    return F.when(value >= FIXED_BINS[0], _start(value, FIXED_BINS))


def _start(value: Column, starts: tuple[int, ...]) -> Column:
    out = F.lit(float(starts[0]))
    for s in starts[1:]:
        out = F.when(value >= s, float(s)).otherwise(out)
    return out


def detect_types(values: DataFrame, key: str = "field", value: str = "value") -> DataFrame:
    """key, data_type: boolean if over .8 of the values read so, else numeric if over half do, else text."""
    from ..functions.scalars import money

    flag = F.lower(F.trim(F.col(value))).isin("true", "false", "yes", "no").cast("double")
    number = money(F.col(value)).isNotNull().cast("double")
    shares = values.filter(F.col(value).isNotNull()).groupBy(key).agg(F.avg(flag).alias("b"), F.avg(number).alias("n"))
    return shares.select(key, F.when(F.col("b") > 0.8, "boolean").when(F.col("n") > 0.5, "numeric").otherwise("text").alias("data_type"))


def numeric_examples(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n and the values at five places from the smallest to the largest."""
    from ..functions.ranks import order_statistics

    places = {"smallest": lambda n: n * 0, "quarter": lambda n: F.floor(n / 4), "half": lambda n: F.floor(n / 2), "three_quarters": lambda n: F.floor(3 * n / 4), "largest": lambda n: n - 1}
    return order_statistics(values, keys, value, places)


def text_examples(values: DataFrame, key: str, value: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values of each field, ties by value."""
    counts = values.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))).filter(F.col("place") <= k)


def boolean_examples(values: DataFrame, key: str, value: str, item: str, k: int = 2) -> DataFrame:
    """The first ``k`` items of each truth value of each field, by item."""
    flag = F.lower(F.trim(F.col(value)))
    told = values.withColumn("flag", F.when(flag.isin("true", "yes"), True).when(flag.isin("false", "no"), False)).filter("flag is not null")
    place = F.row_number().over(Window.partitionBy(key, "flag").orderBy(item))
    return told.select(key, "flag", item, place.alias("place")).filter(F.col("place") <= k)


# What a rule about a label flags, and how severely, by how usual the label is; occasional ones get no rule.
TIER_RULES = {"expected": ("missing", "warn"), "common": ("missing", "info"), "rare": ("present", "info")}


def tier_rules(prevalent: DataFrame, group: str, label: str) -> DataFrame:
    """group, label, flagged, severity for each row of ``prevalence`` whose tier has a rule."""
    flagged, severity = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (what, how) in TIER_RULES.items():
        flagged, severity = F.when(F.col("tier") == name, what).otherwise(flagged), F.when(F.col("tier") == name, how).otherwise(severity)
    return prevalent.select(group, label, flagged.alias("flagged"), severity.alias("severity")).filter("flagged is not null")


def prevalence(clauses: DataFrame, group: str, agreement: str, label: str) -> DataFrame:
    """group, label, share, tier."""
    return coverage(clauses, 0.0, group, agreement, label).select(group, label, F.col("ratio").alias("share"), prevalence_tier(F.col("ratio")).alias("tier"))


def drafts(candidates: DataFrame, miner: str, title: Column, predicate: Column, severity: str, applies_to: str, policy_id: str, provenance: list, description: Column, tags: list, label: Column, answer_type: str | None = None, **more: Column) -> DataFrame:
    """Candidates as rows of the rule table, always drafts; ids follow from what the rule says.

    ``label`` names what the rule is about: ``candidate_bindings`` binds the rule to it.
    """
    return candidates.select(
        truncated_id(F.lit(policy_id), F.lit(miner), title, predicate).alias("rule_id"), F.lit(policy_id).alias("policy_id"), title.alias("title"), description.alias("description"),
        F.lit(applies_to).alias("applies_to"), F.lit(severity).alias("severity"), predicate.alias("predicate"), F.lit(answer_type).cast("string").alias("answer_type"),
        F.array(*(t if isinstance(t, Column) else F.lit(t) for t in tags)).alias("tags"), F.lit("draft").alias("status"), label.cast("string").alias("label"),
        F.to_json(F.struct(F.lit(miner).alias("miner"), *provenance)).alias("source_provenance"), *(c.alias(n) for n, c in more.items()),
    )


def candidate_bindings(rules: DataFrame) -> DataFrame:
    """A soft binding for each mined rule, to what it is about; ``soft_rebind`` finds the entity."""
    kind = F.when(F.col("applies_to") == "field", "field").when(F.col("applies_to") == "domain", "domain").otherwise("cluster")
    return rules.select("rule_id", kind.alias("entity_kind"), F.concat(F.lit("label:"), "label").alias("entity_id"), F.col("label").alias("label_text"), F.lit(0.5).alias("confidence"))


def _percent(share: Column) -> Column:
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def coverage_rules(clauses: DataFrame, policy_id: str, **options) -> DataFrame:
    found = coverage(clauses, **options)
    tree = F.to_json(F.struct(F.lit("any_of").alias("op"), F.array(F.struct(F.lit("clause.classified_as").alias("op"), F.array(F.col("label")).alias("args"))).alias("args")))
    about = F.concat(_percent(F.col("ratio")), F.lit(" of the agreements of "), "domain", F.lit(" have a clause of "), F.col("label"))
    title = F.concat(F.upper("domain"), F.lit(" must contain "), F.col("label"))
    return drafts(found, "coverage", title, tree, "warn", "domain", policy_id, ["ratio", "n"], about, [F.col("domain"), "coverage"], F.col("domain"))


def distribution_rules(values: DataFrame, policy_id: str, **options) -> DataFrame:
    """``values``: domain, cluster, field, value."""
    found = distribution(values, ["domain", "cluster", "field"], "value", **options)
    tree = F.concat(F.lit('{"op":"field.between","args":["'), F.col("field"), F.lit('",'), F.col("lo").cast("string"), F.lit(","), F.col("hi").cast("string"), F.lit("]}"))
    provenance = ["n", "median", "lo", "hi", F.col("lo").alias("p10"), F.col("hi").alias("p90")]
    about = F.concat(F.lit("median "), F.col("median").cast("string"), F.lit(", p10 "), F.col("lo").cast("string"), F.lit(", p90 "), F.col("hi").cast("string"), F.lit(" over "), F.col("n").cast("string"), F.lit(" values"))
    title = F.concat("cluster", F.lit("::"), "field", F.lit(" between p10 and p90"))
    return drafts(found, "distribution", title, tree, "info", "field", policy_id, provenance, about, [F.col("domain"), F.col("cluster"), "distribution"], F.col("field"), "numeric_range")


def categorical_rules(values: DataFrame, policy_id: str, **options) -> DataFrame:
    found = categorical_mode(values, **options)
    tree = F.to_json(F.struct(F.lit("field.eq").alias("op"), F.array("field", "value").alias("args")))
    about = F.concat(_percent(F.col("share")), F.lit(" of the values are "), "value")
    return drafts(found, "categorical", F.concat("field", F.lit(" is "), "value"), tree, "info", "field", policy_id, ["n", "share"], about, ["categorical"], F.col("field"), "enum")


def outlier_rules(vectors: DataFrame, key: str, embedding: str, least: float, policy_id: str) -> DataFrame:
    """A similarity rule for each cluster: its centroid is the reference, ``least`` the threshold."""
    found = outliers(vectors, key, embedding, least).join(centroids(vectors, key, embedding), key).withColumn("outlier_pct", F.col("outlier_share"))
    about = F.concat(_percent(F.col("outlier_share")), F.lit(" of the clauses are less similar to the centre"))
    title = F.concat(F.col(key).cast("string"), F.lit(" is near the centre"))
    return drafts(found, "outlier", title, F.lit(None).cast("string"), "info", "cluster", policy_id, ["outlier_pct", "n"], about, ["outlier"], F.col(key), similarity_threshold=F.lit(float(least)), reference_embedding=F.col("centroid"))
