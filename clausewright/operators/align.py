"""Aligns agreements with rules: one scan of the agreements, all rules as columns of it.

Rules live on the driver and are compiled once. The judge and the embedding of texts are the only
parts in Python; the judge is asked only for the rows that its gate lets through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Context, compile_predicate
from ..functions.scalars import cosine
from .judging import JudgeMemo

#: A rule without a threshold fails only below this similarity.
DEFAULT_SIMILARITY = 0.15
RULES_PER_SELECT = 64

FINDING = "rule_id string, severity string, predicate string, similarity string, deviation double, judge_asked boolean, assertion string, escalation_owner string"


def resolved(rules: DataFrame, bindings: DataFrame) -> DataFrame:
    """Active rules with their bindings, an array of structs; one row a rule."""
    entity = F.struct("entity_kind", "entity_id", "label_text", "confidence")
    bound = bindings.groupBy("rule_id").agg(F.sort_array(F.collect_list(entity)).alias("bindings"))
    return rules.filter("status = 'active'").join(bound, "rule_id", "left")


def scoped(rule: dict, ctx: Context) -> Column:
    """The clauses a rule looks at by its ``applies_to`` and bindings.

    A document's rule looks at all clauses; a domain's at all clauses of agreements of its domains; a
    cluster's at the clauses of its clusters. Without bindings of that kind nothing is left out. Rules
    about fields (field, composite, cross_field) look at values and at no clause.
    """
    clauses, kind = ctx.all_clauses(), rule.get("applies_to")
    labels = [b["label_text"] for b in rule.get("bindings") or [] if b.get("entity_kind") == kind]
    none = F.slice(clauses, 1, 0)
    if kind in ("field", "composite", "cross_field"):
        return none
    if kind == "cluster" and labels:
        return F.filter(clauses, lambda c: c["label"].isin(labels))
    if kind == "domain" and labels:
        return F.when(ctx.domain_name.isin(labels), clauses).otherwise(none)
    return clauses


def combine(outcomes: Column) -> Column:
    """Any fail fails; some outcomes and all of them pass; the rest needs a human. Nulls don't count."""
    there = F.filter(outcomes, lambda o: o.isNotNull())
    return F.when(F.exists(there, lambda o: o == "fail"), "fail").when((F.size(there) > 0) & F.forall(there, lambda o: o == "pass"), "pass").otherwise("needs_human")


def _rule_struct(rule: dict, ctx: Context, target: Column | None, scope: str) -> Column:
    if scope == "bound":
        from dataclasses import replace

        ctx = replace(ctx, clauses=scoped(rule, ctx))
    predicate = F.lit(None).cast("string")
    if rule.get("predicate") is not None:
        if rule["predicate"]:
            verdict = compile_predicate(rule["predicate"], ctx).verdict()
            predicate = F.when(verdict.isNull(), "needs_human").when(verdict, "pass").otherwise("fail")
        else:
            predicate = F.lit("needs_human")
    similarity, deviation = F.lit(None).cast("string"), F.lit(0.0)
    if rule.get("reference_embedding") and target is not None:
        reference = F.array(*(F.lit(float(x)) for x in rule["reference_embedding"]))
        away = F.when(F.size(target) > 0, F.greatest(F.lit(0.0), 1 - cosine(target, reference)))
        if rule.get("walkaway_embedding"):
            bad = F.array(*(F.lit(float(x)) for x in rule["walkaway_embedding"]))
            away = F.least(F.lit(2.0), away + F.greatest(F.lit(0.0), cosine(target, bad)) * float(rule.get("walkaway_weight", 0.0)))
        least = rule.get("similarity_threshold") or DEFAULT_SIMILARITY
        similarity = F.when(away > 1.0 - least, "fail").when(away.isNotNull(), "pass")
        deviation = F.coalesce(away, F.lit(0.0))
    asks = F.lit(bool(rule.get("nl_assertion")))
    if rule.get("predicate") is not None:
        asks = asks & (predicate == "needs_human")
    return F.struct(
        F.lit(rule["rule_id"]).alias("rule_id"),
        F.lit(rule.get("severity", "info")).alias("severity"),
        predicate.alias("predicate"),
        similarity.alias("similarity"),
        deviation.alias("deviation"),
        asks.alias("judge_asked"),
        F.lit(rule.get("nl_assertion")).cast("string").alias("assertion"),
        F.lit(rule.get("escalation_owner")).cast("string").alias("escalation_owner"),
    )


def align(contexts: DataFrame, rules: list[dict], judge: Callable[[str, str], str] | None = None, target_col: str | None = None, ctx: Context | None = None, scope: str = "document", run_id: str = "run", embed: Callable[[list[str]], list[list[float]]] | None = None, memo: JudgeMemo | None = None) -> DataFrame:
    """One finding per agreement and active rule.

    ``judge`` takes (assertion, evidence) and returns pass, fail or anything else for undecided; with a
    ``memo`` it is asked once for each distinct pair of these, in this run and later ones.
    ``target_col`` is an embedding of the text that similarity rules compare; without it ``embed``
    makes one of the first three clauses' texts. With ``scope='bound'`` a rule sees only the clauses
    that its kind and bindings leave it.
    """
    ctx = ctx or Context.standard()
    active = [r for r in rules if r.get("status", "active") == "active"]
    clauses = ctx.all_clauses()
    evidence = F.transform(F.slice(clauses, 1, 3), lambda c: F.struct(c["id"].alias("clause_id"), F.substring(F.coalesce(c["text"], F.lit("")), 1, 300).alias("text")))
    heard = F.array_join(F.transform(F.slice(clauses, 1, 5), lambda c: F.coalesce(c["text"], F.lit(""))), "\n")
    if target_col is None and embed is not None and any(r.get("reference_embedding") for r in active):

        @F.pandas_udf("array<double>")
        def embedded(texts):
            import pandas as pd

            return pd.Series([list(map(float, v)) for v in embed(texts.tolist())])

        target_col = "__target"
        contexts = contexts.withColumn(target_col, embedded(F.array_join(F.transform(F.slice(clauses, 1, 3), lambda c: F.coalesce(c["text"], F.lit(""))), " ")))
    target = F.col(target_col) if target_col else None
    parts = []
    for k in range(0, len(active), RULES_PER_SELECT):
        structs = [_rule_struct(r, ctx, target, scope) for r in active[k : k + RULES_PER_SELECT]]
        parts.append(contexts.select("agreement_id", evidence.alias("evidence"), heard.alias("heard"), F.inline(F.array(*structs))))
    if not parts:
        empty = contexts.select("agreement_id", evidence.alias("evidence"), heard.alias("heard")).limit(0)
        parts = [empty.select("*", F.inline(F.expr("array()").cast(f"array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>")))]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if judge is None:
        found = found.withColumn("judged", F.lit(None).cast("string"))
    elif memo is not None:
        found = memo.judged(found, judge)
    else:

        @F.pandas_udf("string")
        def verdict(assertion, text):
            import pandas as pd

            given = [None if a is None else judge(a, t) or "n/a" for a, t in zip(assertion, text, strict=True)]
            return pd.Series([v if v is None or v in ("pass", "fail") else "needs_human" for v in given], dtype=object)

        # One pass over the agreements: rows that the gate holds back bring no text and get no verdict.
        gated = lambda c: F.when(F.col("judge_asked"), F.coalesce(c, F.lit("")))
        found = found.withColumn("judged", verdict(gated("assertion"), gated("heard")))
    used = F.struct(F.col("predicate").isNotNull().alias("predicate"), F.col("similarity").isNotNull().alias("similarity"), F.col("judged").isNotNull().alias("judge"))
    return found.select(
        F.lit(run_id).alias("run_id"), "agreement_id", "rule_id", "severity",
        combine(F.array("predicate", "similarity", "judged")).alias("outcome"), "deviation", "evidence", used.alias("evaluator_used"), "escalation_owner",
    )


def routed(findings: DataFrame) -> DataFrame:
    """Failed findings by who has to deal with them."""
    return findings.filter("outcome = 'fail' and escalation_owner is not null").groupBy("escalation_owner").agg(F.count("*").alias("n"))


def agreement_report(findings: DataFrame) -> DataFrame:
    """Per agreement: number of findings and violations, the worst severity, the largest deviation."""
    from ..functions.scalars import severity_rank

    failed = F.col("outcome") == "fail"
    worst = F.min_by("severity", F.when(failed, severity_rank(F.col("severity"))))
    return findings.groupBy("agreement_id").agg(
        F.count("*").alias("findings"), F.count_if(failed).alias("violations"), F.when(F.count_if(failed) > 0, worst).alias("worst_severity"),
        F.max("deviation").alias("deviation"), F.sort_array(F.collect_set(F.when(failed, F.col("rule_id")))).alias("violated"),
    )


def document_report(findings: DataFrame, clauses: DataFrame) -> DataFrame:
    """``agreement_report`` with the types of an agreement's clauses, how sure they are, and how many were told.

    ``clauses``: agreement_id, label (null if none was told), confidence.
    """
    told = F.col("label").isNotNull()
    of_clauses = clauses.groupBy("agreement_id").agg(
        F.sort_array(F.collect_set("label")).alias("clause_types"), F.avg(F.when(told, F.col("confidence"))).alias("mean_confidence"),
        F.count("*").alias("paragraphs_total"), F.count_if(told).alias("paragraphs_processed"),
    )
    return agreement_report(findings).join(of_clauses, "agreement_id", "left")


def precision_recall(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """Precision, recall and F1 of ``fail``; only the rules that ``expected`` names count. One row."""
    got = findings.select("agreement_id", "rule_id", F.col("outcome").alias("got"))
    both = expected.select("agreement_id", "rule_id", F.col("outcome").alias("want")).join(got, ["agreement_id", "rule_id"], "left")
    want, have = F.col("want").eqNullSafe(F.lit("fail")), F.col("got").eqNullSafe(F.lit("fail"))
    counts = both.agg(F.count_if(want & have).alias("tp"), F.count_if(~want & have).alias("fp"), F.count_if(want & ~have).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    counts = counts.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return counts.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
