"""The queries over the driver's tables, each with DuckDB SQL that gives the same rows.

Conversations stand in for agreements (a turn is a clause, its role the clause's label), documents
with their labels for agreements' fields, sources and priorities for domains, and embeddings with
their labels for clustered clauses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.stored import sent, stored
from ..operators import align as A
from ..operators import associations as S
from ..operators import context, mining, scoring
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


# ---------------------------------------------------------------- contexts


def conversation_clauses(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("agreement_id"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("role").alias("label"), "text", F.col("turn").alias("ordinal"),
        F.lit(None).cast("array<float>").alias("embedding"), F.lit("conversation").alias("domain"),
    )


def conversation_contexts(spark, sf_dir, of_clause: tuple[str, ...] = ("id", "label", "text", "embedding")) -> DataFrame:
    clauses = conversation_clauses(spark, sf_dir)
    sizes = clauses.select("agreement_id", F.lit("first_turn").alias("name"), F.when(F.col("ordinal") == 0, F.length("text")).cast("string").alias("value"), "ordinal")
    got = context.build(sizes, clauses, of_clause=of_clause)
    return got.withColumn("domain", F.struct(F.lit("d").alias("id"), F.lit("conversation").alias("name"))).withColumn("doc", F.struct(F.size("clauses").cast("double").alias("value"), F.lit("vendor").alias("party_role")))


def document_fields(spark, sf_dir) -> DataFrame:
    """One row per document with its fields as typed columns: nothing is pivoted or shuffled but the labels."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(read(spark, sf_dir, "labels"), "doc_id", "left")


def document_context() -> P.Context:
    field = context.typed_field
    fields = {"lang": field(F.col("lang"), "string"), "source": field(F.col("source"), "string"), "n_chars": field(F.col("n_chars"), "number"), "quality": field(F.col("quality"), "number"), "toxic": field(F.col("toxic"), "number")}
    return P.Context(fields=fields, domain_name=F.col("source"), party_role=F.col("lang"), doc_value=F.col("n_chars").cast("double"))


def _document_predicate(name: str, tree: dict, sql: str) -> None:
    """Registers a predicate over documents: doc_id and whether it holds."""

    def run(spark, sf_dir):
        return document_fields(spark, sf_dir).select("doc_id", P.compile_predicate(tree, document_context()).verdict().alias("holds"))

    QUERIES[name] = run
    SQL[name] = f"SELECT d.doc_id, coalesce({sql}, false) AS holds FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _clause_predicate(name: str, tree: dict, sql: str) -> None:
    """Registers a predicate over conversations: agreement_id and whether it holds."""

    def run(spark, sf_dir):
        asked = ("label", "text") if "clause.contains" in str(tree) else ("label",)
        return conversation_contexts(spark, sf_dir, asked).select("agreement_id", P.compile_predicate(tree, P.Context.standard()).verdict().alias("holds"))

    QUERIES[name] = run
    SQL[name] = f"SELECT conv_id AS agreement_id, {sql} AS holds FROM conversations GROUP BY conv_id"


def op(name: str, *args) -> dict:
    return {"op": name, "args": list(args)}


_document_predicate("pred_exists_left_join", op("field.exists", "quality"), "l.quality IS NOT NULL")
_document_predicate("pred_eq", op("field.eq", "lang", "en"), "d.lang = 'en'")
_document_predicate("pred_eq_number", op("field.eq", "toxic", 1), "l.toxic = 1")
_document_predicate("pred_eq_null", op("field.eq", "toxic", None), "l.toxic IS NULL")
_document_predicate("pred_in", op("field.in", "lang", ["de", "fr", 3]), "d.lang IN ('de', 'fr')")
_document_predicate("pred_in_substring", op("field.in", "lang", "de,en"), "contains('de,en', d.lang)")
_document_predicate("pred_gte", op("field.gte", "n_chars", 2000), "d.n_chars >= 2000")
_document_predicate("pred_lte", op("field.lte", "n_chars", "800"), "d.n_chars <= 800")
_document_predicate("pred_between", op("field.between", "n_chars", 500, 1500), "d.n_chars BETWEEN 500 AND 1500")
_document_predicate("pred_matches_regex", op("field.matches", "source", "regex", r"^src1\d"), r"regexp_matches(d.source, '^src1\d')")
_document_predicate("pred_matches_glob", op("field.matches", "source", "glob", "src[!1]*"), "d.source GLOB 'src[!1]*'")
_document_predicate("pred_value", op("field.value", "toxic"), "l.toxic <> 0")
_document_predicate("pred_not", op("not", op("field.eq", "toxic", 0)), "NOT coalesce(l.toxic = 0, false)")
_document_predicate("pred_if_then", op("if_then", op("field.eq", "quality", 1), op("field.eq", "toxic", 0)), "NOT coalesce(l.quality = 1, false) OR coalesce(l.toxic = 0, false)")
_document_predicate("pred_and_or", op("and", op("field.exists", "quality"), op("or", op("field.gte", "n_chars", 4000), op("field.eq", "lang", "es"))), "l.quality IS NOT NULL AND (d.n_chars >= 4000 OR d.lang = 'es')")
_document_predicate("pred_all_any", op("all_of", op("any_of", op("field.eq", "lang", "de"), op("field.gte", "n_chars", 900)), op("all_of"), op("not", op("any_of"))), "d.lang = 'de' OR d.n_chars >= 900")
_document_predicate("domain_is", op("domain.is", "src3"), "d.source = 'src3'")
_document_predicate("party_role_is", op("doc.party_role.is", "fr"), "d.lang = 'fr'")
_document_predicate("doc_value_gte", op("doc.value.gte", "1000"), "d.n_chars >= 1000")
_clause_predicate("clause_classified_as", op("any_of", op("clause.classified_as", "system")), "bool_or(role = 'system')")
_clause_predicate("clause_contains", op("clause.contains", "THE "), "bool_or(contains(lower(text), 'the '))")
_clause_predicate("clause_count_ge", op("count", op("clause.classified_as", "user"), ">=", 3), "count(*) FILTER (role = 'user') >= 3")
_clause_predicate("clause_and_not", op("and", op("clause.classified_as", "assistant"), op("not", op("clause.contains", "and"))), "bool_or(role = 'assistant') AND NOT bool_or(contains(lower(text), 'and'))")


@query("SELECT conv_id AS agreement_id FROM conversations GROUP BY conv_id HAVING NOT bool_or(role = 'system')")
def clause_absent_anti(spark, sf_dir):
    """clause.absent over the corpus as an anti join."""
    c = conversation_clauses(spark, sf_dir)
    return c.select("agreement_id").distinct().join(c.filter("label = 'system'").select("agreement_id"), "agreement_id", "left_anti")


@query("SELECT DISTINCT conv_id AS agreement_id FROM conversations WHERE role = 'system'")
def clause_present_semi(spark, sf_dir):
    c = conversation_clauses(spark, sf_dir)
    return c.select("agreement_id").distinct().join(c.filter("label = 'system'").select("agreement_id"), "agreement_id", "left_semi")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 10 AND 30")
def pred_between_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return read(spark, sf_dir, "events").select("event_id", k.alias("k")).filter(F.col("k").between(10, 30))


@query("SELECT conv_id AS agreement_id, CASE WHEN bool_or(role = 'assistant') THEN 'pass' ELSE 'needs_human' END AS outcome FROM conversations GROUP BY conv_id")
def pred_inconclusive(spark, sf_dir):
    """An unknown operator after a true one doesn't matter; before it, the result is open."""
    tree = op("or", op("clause.classified_as", "assistant"), op("no.such.operator"))
    verdict = P.compile_predicate(tree, P.Context.standard()).verdict()
    return conversation_contexts(spark, sf_dir).select("agreement_id", F.when(verdict.isNull(), "needs_human").when(verdict, "pass").otherwise("fail").alias("outcome"))


# ---------------------------------------------------------------- alignment

RULES = [
    {"rule_id": "r1", "severity": "blocker", "predicate": op("any_of", op("clause.classified_as", "system")), "escalation_owner": "legal"},
    {"rule_id": "r2", "severity": "warn", "predicate": op("count", op("clause.classified_as", "user"), ">=", 3), "nl_assertion": "is long enough"},
    {"rule_id": "r3", "severity": "approval_required", "predicate": op("clause.contains", "and the")},
    {"rule_id": "r4", "severity": "info", "predicate": op("or", op("clause.absent", "system"), op("no.such.operator"))},
    {"rule_id": "r5", "severity": "info", "predicate": op("field.gte", "first_turn", 200)},
    {"rule_id": "r6", "severity": "warn", "predicate": op("clause.absent", "user"), "status": "retired"},
]

_FINDINGS_SQL = """
WITH a AS (
  SELECT conv_id AS agreement_id, bool_or(role = 'system') AS has_system, count(*) FILTER (role = 'user') AS users,
         bool_or(contains(lower(text), 'and the')) AS has_words, max(CASE WHEN turn = 0 THEN length(text) END) AS first_turn
  FROM conversations GROUP BY conv_id),
f AS (
  SELECT agreement_id, 'r1' AS rule_id, 'blocker' AS severity, CASE WHEN has_system THEN 'pass' ELSE 'fail' END AS outcome FROM a
  UNION ALL SELECT agreement_id, 'r2', 'warn', CASE WHEN users >= 3 THEN 'pass' ELSE 'fail' END FROM a
  UNION ALL SELECT agreement_id, 'r3', 'approval_required', CASE WHEN has_words THEN 'pass' ELSE 'fail' END FROM a
  UNION ALL SELECT agreement_id, 'r4', 'info', CASE WHEN has_system THEN 'needs_human' ELSE 'pass' END FROM a
  UNION ALL SELECT agreement_id, 'r5', 'info', CASE WHEN coalesce(first_turn >= 200, false) THEN 'pass' ELSE 'fail' END FROM a)
"""


def findings(spark, sf_dir) -> DataFrame:
    return A.align(conversation_contexts(spark, sf_dir), RULES)


_CELL = "CASE WHEN outcome = 'fail' THEN severity WHEN outcome = 'needs_human' THEN 'needs_human' ELSE 'pass' END"


@query(_FINDINGS_SQL + "SELECT * FROM f")
def align_findings(spark, sf_dir):
    return findings(spark, sf_dir).select("agreement_id", "rule_id", "severity", "outcome")


@query(_FINDINGS_SQL + f"SELECT {_CELL} AS cell, count(*) AS n FROM f GROUP BY 1")
def severity_tally(spark, sf_dir):
    return views.severity_tally(findings(spark, sf_dir))


@query(_FINDINGS_SQL + f"SELECT agreement_id, {_CELL} AS cell, count(*) AS n FROM f GROUP BY 1, 2")
def portfolio_bar(spark, sf_dir):
    return views.portfolio_bar(findings(spark, sf_dir))


@query(
    _FINDINGS_SQL
    + f"""SELECT rule_id, {_CELL} AS cell, count(*) AS n, array_to_string(list_sort(list(agreement_id))[1:3], ',') AS chips, greatest(count(*) - 3, 0) AS more FROM f GROUP BY 1, 2"""
)
def portfolio_matrix(spark, sf_dir):
    got = views.portfolio_matrix(findings(spark, sf_dir))
    return got.withColumn("chips", F.array_join(F.transform("chips", lambda x: x.cast("string")), ","))


@query(
    _FINDINGS_SQL
    + f"""SELECT agreement_id, string_agg(rule_id || '=' || {_CELL}, ',' ORDER BY rule_id) AS cells FROM f
WHERE agreement_id IN (SELECT DISTINCT agreement_id FROM f ORDER BY 1 LIMIT 24) GROUP BY 1"""
)
def portfolio_heatmap(spark, sf_dir):
    got = views.portfolio(findings(spark, sf_dir))
    return got.select("agreement_id", F.array_join(F.transform("cells", lambda c: F.concat(c["rule_id"], F.lit("="), c["severity"])), ",").alias("cells"))


@query(_FINDINGS_SQL + "SELECT 'legal' AS escalation_owner, count(*) AS n FROM f WHERE rule_id = 'r1' AND outcome = 'fail' HAVING count(*) > 0")
def escalation_routing(spark, sf_dir):
    return A.routed(findings(spark, sf_dir))


@query(
    _FINDINGS_SQL
    + """, r AS (SELECT *, CASE severity WHEN 'blocker' THEN 0 WHEN 'approval_required' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END AS rank FROM f)
SELECT agreement_id, count(*) AS findings, count(*) FILTER (outcome = 'fail') AS violations,
       arg_min(severity, rank) FILTER (outcome = 'fail') AS worst_severity, coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (outcome = 'fail'), '') AS violated
FROM r GROUP BY agreement_id"""
)
def agreement_report(spark, sf_dir):
    return A.agreement_report(findings(spark, sf_dir)).drop("deviation").withColumn("violated", F.array_join("violated", ","))


@query(
    _FINDINGS_SQL
    + """, g AS (SELECT f.*, CASE WHEN agreement_id % 3 = 0 THEN 'fail' ELSE 'pass' END AS want FROM f WHERE rule_id IN ('r1', 'r2')),
c AS (SELECT count(*) FILTER (want = 'fail' AND outcome = 'fail') AS tp, count(*) FILTER (want <> 'fail' AND outcome = 'fail') AS fp, count(*) FILTER (want = 'fail' AND outcome <> 'fail') AS fn FROM g),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS re FROM c)
SELECT tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM p"""
)
def eval_prf1(spark, sf_dir):
    """The gold outcomes are made up: every third agreement should fail."""
    c = conversation_clauses(spark, sf_dir).select("agreement_id").distinct()
    gold = c.select("agreement_id", F.explode(F.array(F.lit("r1"), F.lit("r2"))).alias("rule_id")).withColumn("outcome", F.when(F.col("agreement_id") % 3 == 0, "fail").otherwise("pass"))
    got = A.precision_recall(gold, findings(spark, sf_dir))
    return got.select("tp", "fp", "fn", *(r6(F.col(x)).alias(x) for x in ("precision", "recall", "f1")))


@query(
    """WITH s AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], c)/(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))*sqrt(list_dot_product(c, c))+1e-9) AS cos
FROM embeddings, (SELECT embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id = 0))
SELECT vec_id AS agreement_id, CASE WHEN greatest(0, 1 - cos) > 0.9 THEN 'fail' ELSE 'pass' END AS outcome, round(greatest(0, 1 - cos), 6) AS deviation FROM s"""
)
def align_similarity(spark, sf_dir):
    """A similarity rule: every vector against the first one, threshold .1."""
    e = read(spark, sf_dir, "embeddings")
    reference = e.filter("vec_id = 0").first().embedding
    rules = [{"rule_id": "s1", "severity": "info", "reference_embedding": reference, "similarity_threshold": 0.1}]
    rows = e.select(F.col("vec_id").alias("agreement_id"), F.col("embedding").alias("target"))
    got = A.align(rows, rules, target_col="target", ctx=P.Context())
    return got.select("agreement_id", "outcome", r6(F.col("deviation")).alias("deviation"))


@query(
    _FINDINGS_SQL
    + """, h AS (SELECT conv_id AS agreement_id, (sum(length(text)) FILTER (rn <= 5) + least(count(*), 5) - 1) % 2 = 0 AS even, bool_or(role = 'system') AS has_system
 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY 1)
SELECT agreement_id, rule_id, outcome FROM f WHERE rule_id = 'r2'
UNION ALL SELECT agreement_id, 'j1', CASE WHEN even THEN 'pass' ELSE 'fail' END FROM h
UNION ALL SELECT agreement_id, 'j2', CASE WHEN NOT has_system THEN 'pass' WHEN even THEN 'needs_human' ELSE 'fail' END FROM h"""
)
def align_judge(spark, sf_dir):
    """A judge that passes evidence of even length: always asked by j1, by j2 where its predicate is inconclusive, never by r2."""
    rules = [r for r in RULES if r["rule_id"] == "r2"] + [
        {"rule_id": "j1", "severity": "info", "nl_assertion": "even"},
        {"rule_id": "j2", "severity": "info", "nl_assertion": "even", "predicate": op("or", op("clause.absent", "system"), op("no.such.operator"))},
    ]
    got = A.align(conversation_contexts(spark, sf_dir), rules, judge=lambda assertion, text: "pass" if len(text) % 2 == 0 else "fail")
    return got.select("agreement_id", "rule_id", "outcome")


# ---------------------------------------------------------------- mining


@query("""SELECT role AS label, count(DISTINCT conv_id) AS n, round(count(DISTINCT conv_id)::DOUBLE / (SELECT count(DISTINCT conv_id) FROM conversations), 6) AS ratio
FROM conversations GROUP BY role HAVING count(DISTINCT conv_id)::DOUBLE / (SELECT count(DISTINCT conv_id) FROM conversations) >= 0.9""")
def coverage_by_label(spark, sf_dir):
    return mining.coverage(conversation_clauses(spark, sf_dir)).select("label", "n", r6(F.col("ratio")).alias("ratio"))


@query("""WITH t AS (SELECT source, count(DISTINCT doc_id) AS t FROM documents GROUP BY source), g AS (SELECT lang, count(DISTINCT doc_id)::DOUBLE / (SELECT count(DISTINCT doc_id) FROM documents) AS b FROM documents GROUP BY lang)
SELECT source, d.lang, count(DISTINCT doc_id) AS n, round(count(DISTINCT doc_id)::DOUBLE / any_value(t), 6) AS ratio, round(any_value(b), 6) AS global_baseline
FROM documents d JOIN t USING (source) JOIN g ON d.lang = g.lang GROUP BY source, d.lang HAVING count(DISTINCT doc_id)::DOUBLE / any_value(t) >= 0.5""")
def coverage_with_baseline(spark, sf_dir):
    got = mining.coverage_with_baseline(read(spark, sf_dir, "documents"), 0.5, "source", "doc_id", "lang")
    return got.select("source", "lang", "n", r6(F.col("ratio")).alias("ratio"), r6(F.col("global_baseline")).alias("global_baseline"))


_BAND = """WITH b AS (SELECT o_orderpriority, count(*) AS n, list_sort(list(o_totalprice)) AS v, median(o_totalprice) AS median FROM orders GROUP BY 1),
q AS (SELECT o_orderpriority, n, v[CAST(floor(0.1::DOUBLE * (n - 1)) AS BIGINT) + 1] AS lo, v[CAST(floor(0.9::DOUBLE * (n - 1)) AS BIGINT) + 1] AS hi, median FROM b)
"""


@query(_BAND + "SELECT o_orderpriority, n, round(lo, 6) AS lo, round(hi, 6) AS hi, round(median, 6) AS median FROM q WHERE n >= 5")
def numeric_range_p10_p90(spark, sf_dir):
    got = mining.distribution(read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return got.select("o_orderpriority", "n", *(r6(F.col(c)).alias(c) for c in ("lo", "hi", "median")))


@query(_BAND + "SELECT o_orderpriority, count(*) AS outside FROM orders JOIN q USING (o_orderpriority) WHERE o_totalprice < lo OR o_totalprice > hi GROUP BY 1")
def range_violations(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    bands = mining.distribution(orders, ["o_orderpriority"], "o_totalprice")
    got = orders.join(bands, "o_orderpriority").filter(~F.col("o_totalprice").between(F.col("lo"), F.col("hi")))
    return got.groupBy("o_orderpriority").agg(F.count("*").alias("outside"))


@query(_BAND + "SELECT o_orderpriority, lo > 0 AND hi / lo >= 100 AS suspicious FROM q")
def suspicious_spread(spark, sf_dir):
    return mining.suspicious_spread(mining.distribution(read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")).select("o_orderpriority", "suspicious")


def _field_values(spark, sf_dir) -> DataFrame:
    """Documents' fields in long form, values as strings."""
    d = document_fields(spark, sf_dir)
    return d.select("doc_id", F.expr("stack(4, 'lang', lang, 'quality', cast(quality as string), 'toxic', cast(toxic as string), 'n_chars', cast(n_chars as string)) as (field, value)"))


_LONG = """v AS (SELECT d.doc_id, unnest(['lang', 'quality', 'toxic', 'n_chars']) AS field, unnest([lang, quality::VARCHAR, toxic::VARCHAR, n_chars::VARCHAR]) AS value
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query(f"""WITH {_LONG}, c AS (SELECT field, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2),
s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY field) AS share, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rn FROM c)
SELECT field, value, n, round(share, 6) AS share FROM s WHERE rn = 1 AND share >= 0.7""")
def categorical_mode(spark, sf_dir):
    return mining.categorical_mode(_field_values(spark, sf_dir)).select("field", "value", "n", r6(F.col("share")).alias("share"))


@query(f"""WITH {_LONG} SELECT field, CASE WHEN avg(CASE WHEN lower(trim(value)) IN ('true', 'false', 'yes', 'no') THEN 1.0 ELSE 0 END) > 0.8 THEN 'boolean'
WHEN avg(CASE WHEN try_cast(value AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END) > 0.5 THEN 'numeric' ELSE 'text' END AS data_type FROM v WHERE value IS NOT NULL GROUP BY field""")
def field_type_detection(spark, sf_dir):
    return mining.detect_types(_field_values(spark, sf_dir))


@query("""WITH t AS (SELECT source, count(DISTINCT doc_id) AS t FROM documents GROUP BY 1), c AS (SELECT source, lang, count(DISTINCT doc_id)::DOUBLE / any_value(t) AS share FROM documents JOIN t USING (source) GROUP BY 1, 2)
SELECT source, lang, round(share, 6) AS share, CASE WHEN share >= .8 THEN 'expected' WHEN share >= .5 THEN 'common' WHEN share >= .2 THEN 'occasional' ELSE 'rare' END AS tier FROM c""")
def prevalence_tier_by_source(spark, sf_dir):
    return mining.prevalence(read(spark, sf_dir, "documents"), "source", "doc_id", "lang").withColumn("share", r6(F.col("share")))


_CENTROID = """WITH u AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS centroid FROM m GROUP BY 1),
s AS (SELECT vec_id, e.label, list_dot_product(embedding::DOUBLE[], centroid) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(centroid, centroid)) + 1e-9) AS cos FROM embeddings e JOIN c ON e.label = c.label)
"""


@query(_CENTROID + "SELECT label, round(avg(cos), 5) AS mean_cos, round(min(cos), 5) AS min_cos, count(*) FILTER (cos < 0) AS below FROM s GROUP BY label")
def centroid_cosine(spark, sf_dir):
    s = mining.centroid_similarity(read(spark, sf_dir, "embeddings"), "label", "embedding")
    return s.groupBy("label").agg(F.round(F.avg("similarity"), 5).alias("mean_cos"), F.round(F.min("similarity"), 5).alias("min_cos"), F.count_if(F.col("similarity") < 0).alias("below"))


@query(_CENTROID + "SELECT label, count(*) AS n, count(*) FILTER (cos < 0.05) AS outliers, round(count(*) FILTER (cos < 0.05)::DOUBLE / count(*), 6) AS outlier_share FROM s GROUP BY label")
def outlier_pct(spark, sf_dir):
    return mining.outliers(read(spark, sf_dir, "embeddings"), "label", "embedding", 0.05).withColumn("outlier_share", r6(F.col("outlier_share")))


@query(_CENTROID + """, p AS (SELECT label, vec_id, round(1 - cos, 9) AS deviation FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY deviation, vec_id) AS a, row_number() OVER (PARTITION BY label ORDER BY deviation DESC, vec_id) AS d FROM p)
SELECT label, vec_id, a AS place, 'aligned' AS side FROM r WHERE a <= 3 UNION ALL SELECT label, vec_id, d, 'deviating' FROM r WHERE d <= 3""")
def rule_preview(spark, sf_dir):
    s = mining.centroid_similarity(read(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("deviation", F.round(1 - F.col("similarity"), 9))
    return mining.preview(s, "label", "vec_id", "deviation").select("label", "vec_id", "place", "side")


@query(_CENTROID + """, x AS (SELECT e.vec_id, c.label, list_dot_product(embedding::DOUBLE[], centroid) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(centroid, centroid)) + 1e-9) AS cos FROM embeddings e, c)
SELECT vec_id AS binding_id, arg_max(label, cos) AS cluster_id, round(max(cos), 5) AS confidence, max(cos) >= 0.3 AS rebound FROM x GROUP BY 1""")
def soft_rebind_argmax(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    clusters = mining.centroids(e, "label", "embedding").select(F.col("label").alias("cluster_id"), F.col("centroid").alias("embedding"))
    got = mining.soft_rebind(e.select(F.col("vec_id").alias("binding_id"), F.col("embedding").alias("label_embedding")), clusters, 0.3)
    return got.withColumn("confidence", F.round("confidence", 5))


_PAIRS = """b AS (SELECT DISTINCT user_id % 5 AS cluster, user_id::VARCHAR || '/' || CAST(ts AS DATE)::VARCHAR AS basket, event_type AS item FROM events),
n AS (SELECT count(DISTINCT basket) AS n FROM b), i AS (SELECT item, count(*) AS k FROM b GROUP BY 1),
p AS (SELECT x.item AS antecedent, y.item AS consequent, count(*) AS n_both FROM b x JOIN b y ON x.basket = y.basket AND x.item <> y.item GROUP BY 1, 2),
g AS (SELECT antecedent, consequent, n_both, n, n_both::DOUBLE / n AS support, n_both::DOUBLE / ia.k AS confidence, n_both::DOUBLE * n / (ia.k * ic.k) AS lift
FROM p, n, i ia, i ic WHERE ia.item = antecedent AND ic.item = consequent),
cn AS (SELECT cluster, count(DISTINCT basket) AS n FROM b GROUP BY 1), ci AS (SELECT cluster, item, count(*) AS k FROM b GROUP BY 1, 2),
cp AS (SELECT x.cluster, x.item AS antecedent, y.item AS consequent, count(*) AS n_both FROM b x JOIN b y ON x.basket = y.basket AND x.item <> y.item GROUP BY 1, 2, 3),
cg AS (SELECT cp.cluster, antecedent, consequent, n_both::DOUBLE * n / (ia.k * ic.k) AS lift FROM cp JOIN cn ON cp.cluster = cn.cluster
JOIN ci ia ON ia.cluster = cp.cluster AND ia.item = antecedent JOIN ci ic ON ic.cluster = cp.cluster AND ic.item = consequent)
"""


def _baskets(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 5).alias("cluster"), F.concat_ws("/", "user_id", F.to_date("ts")).alias("basket"), F.col("event_type").alias("item"))


@query(f"WITH {_PAIRS} SELECT antecedent, consequent, n_both, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM g")
def association_pairs(spark, sf_dir):
    got = S.pair_rules(_baskets(spark, sf_dir))
    return got.select("antecedent", "consequent", "n_both", *(r6(F.col(c)).alias(c) for c in ("support", "confidence", "lift")))


@query(f"""WITH {_PAIRS} SELECT cg.cluster, cg.antecedent, cg.consequent, round(cg.lift, 6) AS cluster_lift, round(g.lift, 6) AS global_lift, round(cg.lift / greatest(g.lift, 0.01), 2) AS lift_ratio
FROM cg LEFT JOIN g USING (antecedent, consequent) WHERE cg.lift > 0.5 AND (coalesce(g.lift, 0) < 0.1 OR cg.lift / greatest(coalesce(g.lift, 0), 0.01) > 1.03)""")
def contrastive_lift(spark, sf_dir):
    """With the default thresholds these uniform baskets have no such rule, so lower ones are given."""
    b = _baskets(spark, sf_dir)
    got = S.contrastive(S.pair_rules(b, groups=("cluster",)), S.pair_rules(b), ["cluster"], least=0.5, globally_below=0.1, ratio=1.03)
    return got.select("cluster", "antecedent", "consequent", r6(F.col("cluster_lift")).alias("cluster_lift"), r6(F.col("global_lift")).alias("global_lift"), "lift_ratio")


_SPARSE = """b AS (SELECT DISTINCT l_orderkey AS basket, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT count(DISTINCT basket) AS n FROM b), i AS (SELECT item, count(*) AS k FROM b GROUP BY 1),
p AS (SELECT x.item AS antecedent, y.item AS consequent, count(*) AS n_both FROM b x JOIN b y ON x.basket = y.basket AND x.item <> y.item GROUP BY 1, 2),
g AS (SELECT antecedent, consequent, n_both, n_both::DOUBLE / n AS support, n_both::DOUBLE / ia.k AS confidence, n_both::DOUBLE * n / (ia.k * ic.k) AS lift
FROM p, n, i ia, i ic WHERE ia.item = antecedent AND ic.item = consequent)
"""


def _order_types(spark, sf_dir) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(read(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket"), F.col("p_type").alias("item"))


@query(f"""WITH {_SPARSE} SELECT antecedent, consequent, split_part(antecedent, ' ', 1) AS antecedent_clauses, split_part(consequent, ' ', 1) AS consequent_clauses, round(lift, 6) AS lift FROM g WHERE support >= 0.005 AND confidence >= 0.1 AND lift >= 0.5 AND split_part(antecedent, ' ', 1) <> split_part(consequent, ' ', 1)
ORDER BY g.lift DESC, antecedent, consequent LIMIT 500""")
def cross_clause_rules(spark, sf_dir):
    """A part type's first word is its clause type."""
    baskets = _order_types(spark, sf_dir)
    types = read(spark, sf_dir, "part").select(F.col("p_type").alias("item"), F.split("p_type", " ")[0].alias("clause_type")).distinct()
    return S.cross_clause(S.pair_rules(baskets), types, confidence=0.1, lift=0.5).select("antecedent", "consequent", *(F.array_join(c, ",").alias(c) for c in ("antecedent_clauses", "consequent_clauses")), r6(F.col("lift")).alias("lift"))


@query(f"""WITH {_SPARSE}, u AS (SELECT x.item AS a, y.item AS b, count(*) AS n_both FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2)
SELECT a, b, n_both, round(n_both::DOUBLE / (ia.k + ib.k - n_both), 6) AS jaccard FROM u JOIN i ia ON ia.item = a JOIN i ib ON ib.item = b""")
def cooccurrence_pairs(spark, sf_dir):
    return S.cooccurrence(_order_types(spark, sf_dir), "basket", "item").withColumn("jaccard", r6(F.col("jaccard")))


@query(f"""WITH {_SPARSE}, l AS (SELECT list(item ORDER BY item) AS l FROM b GROUP BY basket), z AS (SELECT l, unnest(range(1, 1 << len(l))) AS mask FROM l),
f AS (SELECT list_filter(l, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items, count(*) AS k FROM z GROUP BY 1), q AS (SELECT * FROM f, n WHERE k >= 0.05 * n.n),
x AS (SELECT q.*, unnest(items) AS consequent FROM q WHERE len(items) > 1), y AS (SELECT x.*, list_filter(items, lambda i: i <> consequent) AS antecedent FROM x)
SELECT array_to_string(antecedent, ',') AS antecedent, consequent, round(y.k::DOUBLE / a.k, 6) AS confidence, round(y.k::DOUBLE / a.k / (c.k::DOUBLE / y.n), 6) AS lift, round(y.k::DOUBLE / y.n, 6) AS support
FROM y JOIN q a ON a.items = antecedent JOIN q c ON c.items = [consequent] WHERE y.k::DOUBLE / a.k >= 0.2""")
def fpgrowth_rules(spark, sf_dir):
    """Itemsets of several types."""
    got = S.itemset_rules(_order_types(spark, sf_dir), "basket", "item", 0.05, 0.2)
    return got.select(F.array_join(F.array_sort("antecedent"), ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), r6(F.col("confidence")).alias("confidence"), r6(F.col("lift")).alias("lift"), r6(F.col("support")).alias("support"))


@query("""WITH s AS (SELECT source, lang, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source) AS share FROM documents GROUP BY 1, 2), g AS (SELECT lang, count(*)::DOUBLE / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY 1),
r AS (SELECT s.source, s.lang, row_number() OVER (PARTITION BY s.source ORDER BY round(s.share / g.share, 9) DESC, s.lang) AS place FROM s JOIN g USING (lang) WHERE s.share >= 0.1)
SELECT source, string_agg(lang, ' + ' ORDER BY place) AS name FROM r WHERE place <= 3 GROUP BY source""")
def cluster_naming(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    each = d.groupBy("source", "lang").agg(F.count("*").alias("n")).withColumn("share", scoring.share_of_total(d, ["source"], "n"))
    overall = d.groupBy("lang").agg(F.count("*").alias("n")).crossJoin(d.agg(F.count("*").alias("t"))).select("lang", (F.col("n") / F.col("t")).alias("share"))  # one row: the total
    return S.cluster_names(each.select("source", "lang", "share"), overall, "source", "lang", least=0.1)


@query("""SELECT p_size, CASE WHEN p_size < 5 THEN 'net_days' ELSE 'term_years' END AS field, CASE WHEN p_size < 5 THEN p_size * 300 BETWEEN 0 AND 730 ELSE p_size * 2 BETWEEN 0 AND 50 END AS plausible, count(*) AS n FROM part GROUP BY 1, 2, 3""")
def numeric_bounds_validation(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("field", F.when(F.col("p_size") < 5, "net_days").otherwise("term_years")).withColumn("v", F.when(F.col("p_size") < 5, F.col("p_size") * 300).otherwise(F.col("p_size") * 2))
    return p.groupBy("p_size", "field", mining.in_bounds(F.col("field"), F.col("v")).alias("plausible")).agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT 'quantity' AS field, l_quantity AS v FROM lineitem UNION ALL SELECT 'line', l_linenumber FROM lineitem UNION ALL SELECT 'size', p_size * 7.5 FROM part UNION ALL SELECT 'nation', n_nationkey FROM nation
UNION ALL SELECT 'charge', p_retailprice / 2 FROM part UNION ALL SELECT 'price', o_totalprice FROM orders), m AS (SELECT field, max(v) AS m FROM v GROUP BY 1),
s AS (SELECT field, v, CASE WHEN m <= 10 THEN [0, 2, 4, 6] WHEN m <= 30 THEN [0, 8, 15] WHEN m <= 100 THEN [0, 26, 51, 76] WHEN m <= 365 THEN [0, 31, 91, 181] WHEN m <= 1000 THEN [0, 101, 251, 501] ELSE [0, 101, 1001, 10001] END AS starts FROM v JOIN m USING (field))
SELECT field, coalesce(list_max(list_filter(starts, lambda x: x <= v)), 0)::DOUBLE AS bucket, count(*) AS n FROM s GROUP BY 1, 2""")
def numeric_buckets(spark, sf_dir):
    """Fields of several sizes, each on the ladder for its largest value."""
    li, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    field = lambda df, name, value: df.select(F.lit(name).alias("field"), value.cast("double").alias("v"))
    v = field(li, "quantity", F.col("l_quantity")).unionByName(field(li, "line", F.col("l_linenumber"))).unionByName(field(p, "size", F.col("p_size") * 7.5))
    v = v.unionByName(field(read(spark, sf_dir, "nation"), "nation", F.col("n_nationkey"))).unionByName(field(p, "charge", F.col("p_retailprice") / 2)).unionByName(field(read(spark, sf_dir, "orders"), "price", F.col("o_totalprice")))
    largest = sent(stored(v.groupBy("field").agg(F.max("v").alias("m")), "largest"))
    return v.join(largest, "field").groupBy("field", mining.bucket_start(F.col("v"), F.col("m")).alias("bucket")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT o_orderstatus, count(*) AS n, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY 1)
SELECT o_orderstatus, n, v[1] AS smallest, v[n // 4 + 1] AS quarter, v[n // 2 + 1] AS half, v[3 * n // 4 + 1] AS three_quarters, v[n] AS largest FROM b""")
def diverse_examples(spark, sf_dir):
    return mining.numeric_examples(read(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice")


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, lang, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS place FROM c QUALIFY place <= 2""")
def text_examples(spark, sf_dir):
    return mining.text_examples(read(spark, sf_dir, "documents"), "source", "lang", 2)


@query("""WITH f AS (SELECT o_orderpriority, o_orderkey, o_totalprice > 400000 AS flagged FROM orders) SELECT o_orderpriority AS rule_id, round(avg(flagged::INT::DOUBLE), 6) AS flag_rate FROM f GROUP BY 1""")
def candidate_flag_rate(spark, sf_dir):
    flags = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("rule_id"), F.col("o_orderkey").alias("agreement_id"), (F.col("o_totalprice") > 400000).alias("flagged"))
    return mining.rank_candidates(flags).select("rule_id", r6(F.col("flag_rate")).alias("flag_rate"))


@query("""WITH f AS (SELECT o_orderpriority AS rule_id, CASE WHEN o_totalprice > 400000 THEN 1.0::DOUBLE ELSE 0 END AS hit, ('0x' || substr(md5('17:' || o_orderkey), 1, 8))::BIGINT % 5 AS bucket FROM orders),
k AS (SELECT rule_id, b, avg(hit) AS rate FROM f, (SELECT unnest(range(5)) AS b) WHERE bucket <> b GROUP BY 1, 2), s AS (SELECT rule_id, 1 - (max(rate) - min(rate)) AS stability FROM k GROUP BY 1), r AS (SELECT rule_id, avg(hit) AS flag_rate FROM f GROUP BY 1)
SELECT rule_id, round(flag_rate, 6) AS flag_rate, round(stability, 6) AS stability, round(flag_rate * stability, 6) AS score FROM r JOIN s USING (rule_id)""")
def candidate_scores(spark, sf_dir):
    """Flag rate times stability over seeded resamples."""
    flags = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("rule_id"), F.col("o_orderkey").alias("agreement_id"), (F.col("o_totalprice") > 400000).alias("flagged"))
    return mining.rank_candidates(flags).select("rule_id", *(r6(F.col(c)).alias(c) for c in ("flag_rate", "stability", "score")))


@query("""WITH t AS (SELECT count(DISTINCT conv_id) AS t FROM conversations), c AS (SELECT role, count(DISTINCT conv_id) AS n FROM conversations GROUP BY 1)
SELECT 'CONVERSATION must contain ' || role AS title, 'domain' AS applies_to, 'warn' AS severity, 'draft' AS status, '{"op":"any_of","args":[{"op":"clause.classified_as","args":["' || role || '"]}]}' AS predicate FROM c, t WHERE n::DOUBLE / t >= 0.9""")
def mined_coverage_rules(spark, sf_dir):
    return mining.coverage_rules(conversation_clauses(spark, sf_dir), "p").select("title", "applies_to", "severity", "status", "predicate")


@query(f"""WITH {_LONG}, c AS (SELECT field, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY field) AS share, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rn FROM c)
SELECT field || ' is ' || value AS title, '{{"op":"field.eq","args":["' || field || '","' || value || '"]}}' AS predicate FROM s WHERE rn = 1 AND share >= 0.7""")
def mined_categorical_rules(spark, sf_dir):
    return mining.categorical_rules(_field_values(spark, sf_dir), "p").select("title", "predicate")


@query("""SELECT item_id AS benchmark_id, round(greatest(0.5, 1 - 2 * (item_id % 40) / 100.0), 6) AS similarity_threshold FROM benchmark""")
def threshold_migration(spark, sf_dir):
    from ..sources.store import migrate_benchmarks

    b = read(spark, sf_dir, "benchmark").select(F.lit("c1").alias("cluster_id"), F.lit("Indemnification").alias("label"), F.col("item_id").alias("benchmark_id"), "text", (F.col("item_id") % 40 / 100.0).alias("mean_dev"))
    got = migrate_benchmarks(b, "p")
    return got.select(F.get_json_object("source_provenance", "$.benchmark_id").cast("long").alias("benchmark_id"), r6(F.col("similarity_threshold")).alias("similarity_threshold"))


# ---------------------------------------------------------------- scoring

_FLAGS = """t AS (SELECT source, lang, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source) AS share FROM documents GROUP BY 1, 2),
e AS (SELECT * FROM t WHERE share >= 0.5), f AS (SELECT doc_id, d.source, e.lang AS missing, e.share FROM documents d JOIN e ON d.source = e.source AND d.lang <> e.lang),
sc AS (SELECT doc_id, source, sum(2.0 * (1 + 2.0 * share)) AS score FROM f GROUP BY 1, 2),
tr AS (SELECT *, CASE WHEN score >= 5 THEN 'high' WHEN score >= 2.5 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS tier FROM sc)
"""


def _missing(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    expected = mining.prevalence(d, "source", "doc_id", "lang").filter(F.col("share") >= 0.5)
    return scoring.missing_expected(d, expected, "doc_id", "source", "lang")


def _scores(spark, sf_dir) -> DataFrame:
    flags = _missing(spark, sf_dir).select("doc_id", F.lit("missing_expected").alias("kind"), F.col("share").alias("prevalence_gap"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("double").alias("lift"))
    return scoring.deviation_score(flags, "doc_id")


@query(f"WITH {_FLAGS} SELECT doc_id, source, missing AS lang, round(share, 6) AS share FROM f")
def anomaly_flags(spark, sf_dir):
    return _missing(spark, sf_dir).withColumn("share", r6(F.col("share")))


@query(f"WITH {_FLAGS} SELECT doc_id, round(score, 6) AS score, tier FROM tr")
def deviation_score(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("score", r6(F.col("score")))


@query(f"WITH {_FLAGS} SELECT source, count(*) AS documents, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score, count(*) FILTER (tier = 'high') AS high FROM tr GROUP BY 1")
def portfolio_report(spark, sf_dir):
    s = _scores(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    got = scoring.portfolio_report(s, "source")
    return got.withColumn("mean_score", r6(F.col("mean_score"))).withColumn("max_score", r6(F.col("max_score")))


@query(f"WITH {_FLAGS} SELECT tier, count(*) AS n FROM tr GROUP BY 1")
def deviation_tiers(spark, sf_dir):
    return scoring.severity_buckets(_scores(spark, sf_dir))


@query(f"WITH {_FLAGS} SELECT doc_id FROM (SELECT doc_id, round(score, 9) AS score FROM tr) ORDER BY score DESC, doc_id LIMIT (SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) FROM tr)")
def top_outliers(spark, sf_dir):
    return scoring.top_outliers(_scores(spark, sf_dir).withColumn("score", F.round("score", 9)), "doc_id").select("doc_id")


@query(f"WITH {_FLAGS} SELECT missing AS lang, count(*) AS n FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def most_missing(spark, sf_dir):
    return scoring.most_missing(_missing(spark, sf_dir), "lang")


# ---------------------------------------------------------------- views


def _rule_rows(spark, sf_dir) -> DataFrame:
    """Parts as rules: brands are clusters, types decide severity and status."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("rule_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("cluster_id"), F.when(F.col("p_size") % 2 == 0, "cluster").otherwise("field").alias("applies_to"),
        F.when(F.col("p_size") > 40, "blocker").when(F.col("p_size") > 30, "approval_required").when(F.col("p_size") > 10, "warn").otherwise("info").alias("severity"),
        F.when(F.col("p_partkey") % 4 == 0, "active").when(F.col("p_partkey") % 4 == 1, "retired").otherwise("draft").alias("status"), (F.col("p_size") / 50.0).alias("confidence"),
        F.when(F.col("p_size") % 3 == 0, "coverage").alias("miner"), F.when(F.col("p_size") % 5 == 0, "legacy").alias("migrated_from"), F.col("p_type").alias("group_label"),
        F.when(F.col("p_size") % 7 == 0, "domain").alias("group_kind"),
    )


_RULES = """r AS (SELECT p_partkey::VARCHAR AS rule_id, p_name AS title, p_brand AS cluster_id, CASE WHEN p_size % 2 = 0 THEN 'cluster' ELSE 'field' END AS applies_to,
CASE WHEN p_size > 40 THEN 'blocker' WHEN p_size > 30 THEN 'approval_required' WHEN p_size > 10 THEN 'warn' ELSE 'info' END AS severity,
CASE WHEN p_partkey % 4 = 0 THEN 'active' WHEN p_partkey % 4 = 1 THEN 'retired' ELSE 'draft' END AS status, p_size / 50.0 AS confidence,
CASE WHEN p_size % 3 = 0 THEN 'coverage' END AS miner, CASE WHEN p_size % 5 = 0 THEN 'legacy' END AS migrated_from, p_type AS group_label, CASE WHEN p_size % 7 = 0 THEN 'domain' END AS group_kind FROM part)
"""


@query(f"WITH {_RULES} SELECT rule_id, title FROM r WHERE severity = 'warn' AND applies_to = 'cluster' AND coalesce(miner, CASE WHEN migrated_from IS NOT NULL THEN 'migrated' END, '') = 'migrated'")
def triage(spark, sf_dir):
    r = _rule_rows(spark, sf_dir).withColumn("source", views.source_of(F.col("miner"), F.col("migrated_from")))
    return views.triage(r, severity="warn", applies_to="cluster", source="migrated").select("rule_id", "title")


@query(f"""WITH {_RULES}, k AS (SELECT rule_id, unnest([CASE WHEN status = 'draft' THEN 'draft' END, CASE WHEN status = 'draft' AND (confidence < 0.85 OR severity IN ('approval_required', 'blocker')) THEN 'review' END,
CASE WHEN status = 'active' THEN 'active' END, CASE WHEN status = 'retired' THEN 'retired' END]) AS bucket FROM r) SELECT bucket, count(*) AS n FROM k WHERE bucket IS NOT NULL GROUP BY 1""")
def kanban_buckets(spark, sf_dir):
    return views.kanban(_rule_rows(spark, sf_dir)).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"WITH {_RULES} SELECT rule_id, CASE WHEN rule_id::INT % 8 = 2 THEN 'active' WHEN rule_id::INT % 8 = 4 THEN 'retired' ELSE status END AS status FROM r")
def rule_overlay(spark, sf_dir):
    r = _rule_rows(spark, sf_dir)
    n = F.col("rule_id").cast("int") % 8
    actions = r.select("rule_id", (n == 2).alias("accepted"), (n.isin(2, 4)).alias("retired")).filter("accepted or retired")
    return views.overlay(r, actions).select("rule_id", "status")


@query(f"WITH {_RULES} SELECT coalesce(group_kind, 'cluster') AS group_kind, coalesce(group_label, 'Unbound') AS group_label, count(*) AS n FROM r GROUP BY 1, 2")
def hierarchical_group(spark, sf_dir):
    return views.grouped(_rule_rows(spark, sf_dir))


@query(f"WITH {_RULES}, c AS (SELECT p_brand AS cluster_id, count(*) FILTER (p_size > 25) AS chunk_count FROM part GROUP BY 1) SELECT c.cluster_id, chunk_count, count(rule_id) AS rules FROM c LEFT JOIN (SELECT * FROM r WHERE status = 'active') a ON a.cluster_id = c.cluster_id GROUP BY 1, 2")
def cluster_rail(spark, sf_dir):
    clusters = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("cluster_id")).agg(F.count_if(F.col("p_size") > 25).alias("chunk_count"))
    return views.cluster_rail(clusters, _rule_rows(spark, sf_dir).filter("status = 'active'"))


@query(f"WITH {_RULES} SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS agreement_count, count(*) FILTER (status = 'draft') AS drafts_pending, count(*) FILTER (status = 'active') AS rules_active, count(*) FILTER (status = 'retired') AS rules_retired FROM r")
def corpus_meta(spark, sf_dir):
    return views.corpus_meta(conversation_clauses(spark, sf_dir), _rule_rows(spark, sf_dir))


@query("SELECT source, lang, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY source), 6) AS pct, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) = 1 AS is_mode FROM documents GROUP BY 1, 2")
def category_shares(spark, sf_dir):
    counts = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return views.shares(counts, ["source"], "lang").select("source", "lang", r6(F.col("pct")).alias("pct"), "is_mode")


@query(_BAND + "SELECT o_orderkey, round((o_totalprice - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 100, 6) AS position FROM orders JOIN q USING (o_orderpriority) WHERE o_orderstatus = 'F'")
def distribution_scale(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    got = orders.filter("o_orderstatus = 'F'").join(mining.distribution(orders, ["o_orderpriority"], "o_totalprice"), "o_orderpriority")
    return got.select("o_orderkey", r6(views.scale_position(F.col("o_totalprice"), F.col("lo"), F.col("hi"))).alias("position"))


@query("SELECT s.lang, count(l.doc_id) AS n FROM documents s LEFT JOIN labels l ON s.doc_id = l.doc_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def top_fields_left_join(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled"), F.col("doc_id") == F.col("labelled"), "left")
    return d.groupBy("lang").agg(F.count("labelled").alias("n")).orderBy(F.desc("n"), "lang").limit(12)


@query("SELECT r_name AS domain, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def cluster_domain_join(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("domain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(20)


@query("SELECT source AS cluster_id, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY 1")
def field_type_matrix(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("cluster_id"), F.col("lang").alias("field_type"))
    return views.field_matrix(d, ["de", "en", "es", "fr"])


@query(f"""WITH {_LONG}, f AS (SELECT field, count(value) AS n, count(DISTINCT doc_id) FILTER (value IS NOT NULL) AS have FROM v GROUP BY 1),
c AS (SELECT field, value, count(*) AS c FROM v WHERE value IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY c DESC, value) AS place FROM c)
SELECT f.field AS field_id, n, round(have * 100.0 / (SELECT count(DISTINCT doc_id) FROM documents), 6) AS coverage_pct, string_agg(t.value, ',' ORDER BY place) AS examples FROM f JOIN t ON f.field = t.field AND place <= 5 GROUP BY 1, 2, 3""")
def field_rollup(spark, sf_dir):
    v = _field_values(spark, sf_dir).filter("value is not null").select(F.col("field").alias("field_id"), F.col("doc_id").alias("agreement_id"), "value")
    fields = v.select("field_id").distinct()
    agreements = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("agreement_id"))
    return views.field_rollup(fields, v, agreements).select("field_id", "n", r6(F.col("coverage_pct")).alias("coverage_pct"), F.array_join("examples", ",").alias("examples"))


@query("""WITH c AS (SELECT source AS cluster_id, count(*) AS chunk_count, count(DISTINCT lang) AS fields FROM documents GROUP BY 1) SELECT cluster_id, fields, fields < 4 AS incomplete, chunk_count < 40 AS small FROM c""")
def taxonomy_health(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    clusters = d.groupBy(F.col("source").alias("cluster_id")).agg(F.count("*").alias("chunk_count"))
    fields = d.select(F.col("source").alias("cluster_id"), "lang").distinct()
    return views.taxonomy_health(clusters, fields, 4, 40).select("cluster_id", "fields", "incomplete", "small")


@query(_FINDINGS_SQL + """, t AS (SELECT conv_id AS agreement_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1)
SELECT agreement_id, rule_id, left(text, 300) AS clause, 'ask ' || rule_id AS title FROM f JOIN t USING (agreement_id) WHERE outcome = 'fail'""")
def redline(spark, sf_dir):
    rules = spark.createDataFrame([(r["rule_id"], "ask " + r["rule_id"], None, r.get("escalation_owner")) for r in RULES], "rule_id string, title string, preferred_language string, escalation_owner string")
    return views.redline(findings(spark, sf_dir), rules).select("agreement_id", "rule_id", "clause", "title")


from . import portfolio_queries, rulebook_queries  # noqa: E402, F401  register their queries; they need what is defined above
