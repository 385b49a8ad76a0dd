"""Queries over the rule store, the importers and the read models of rules, with their SQL.

Nations and regions stand in for the rows of a rulebook, parts for stored rules. The small files and
tables that these queries write go below the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import align as A
from ..operators import associations as S
from ..operators import context, mining
from ..sources import office
from ..sources.store import Store, shared_folder
from . import service, views
from .queries import _CENTROID, _FINDINGS_SQL, _LONG, _RULES, _SPARSE, _field_values, _order_types, _rule_rows, conversation_clauses, conversation_contexts, findings, op, query, r6, read

# ---------------------------------------------------------------- store


def _store(spark) -> Store:
    return Store(spark, shared_folder(spark, "store"))


@query("""SELECT r_name AS name, CASE WHEN r_regionkey = 2 THEN 'described later' ELSE 'region ' || r_regionkey END AS description, 'draft' AS status, CASE WHEN r_regionkey = 2 THEN 2 ELSE 1 END AS version FROM region WHERE r_regionkey <> 4""")
def store_policies(spark, sf_dir):
    """A policy a region, created one by one, one of them described again and one archived, listed without the latter."""
    store = _store(spark)
    made = {r.r_regionkey: store.create_policy(r.r_name, f"region {r.r_regionkey}", at="2024-01-01") for r in read(spark, sf_dir, "region").orderBy("r_regionkey").collect()}
    if 2 in made:
        store.describe(made[2], "2024-01-02", "described later")
    if 4 in made:
        store.describe(made[4], "2024-01-03", status="archived")
    return store.policies(archived=False).select("name", "description", "status", "version")


def _stored_rules(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.lit("p").alias("policy_id"), F.concat_ws(" ", "p_partkey", "p_name").alias("title"), F.concat(F.lit('{"op":"field.gte","args":["size",'), F.col("p_size").cast("string"), F.lit("]}")).alias("predicate"),
        F.lit("info").alias("severity"), F.lit("draft").alias("status"), F.array("p_brand", "p_type").alias("tags"), F.col("p_partkey").cast("string").alias("rule_id"),
    )


_STORED = """s AS (SELECT p_partkey, p_brand, p_type, p_partkey || ' ' || p_name AS title, '{"op":"field.gte","args":["size",' || p_size || ']}' AS predicate, CASE WHEN p_partkey % 4 = 0 THEN 'retired' WHEN p_partkey % 2 = 0 THEN 'active' ELSE 'draft' END AS status FROM part)
"""


def _filled(spark, sf_dir) -> Store:
    """Rules, then two rounds of status events: even ones become active, every fourth retires."""
    store, rules = _store(spark), _stored_rules(spark, sf_dir)
    store.create_rules(rules)
    store.set_status(rules.filter("rule_id % 2 = 0"), "active", "2024-01-02")
    store.set_status(rules.filter("rule_id % 4 = 0"), "retired", "2024-01-03")
    return store


@query(f"WITH {_STORED} SELECT title, predicate, 'info' AS severity, status, p_brand || ',' || p_type AS tags FROM s")
def store_rules(spark, sf_dir):
    return _filled(spark, sf_dir).rules("p").select("title", "predicate", "severity", "status", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_STORED} SELECT title, p_brand AS label_text, 0.5::DOUBLE AS confidence FROM s WHERE status = 'active'")
def rules_with_bindings(spark, sf_dir):
    """Active rules with what they are bound to."""
    store = _filled(spark, sf_dir)
    store.add_bindings(read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("rule_id"), F.lit("cluster").alias("entity_kind"), F.concat(F.lit("label:"), "p_brand").alias("entity_id"), F.col("p_brand").alias("label_text"), F.lit(0.5).alias("confidence")))
    got = A.resolved(store.rules("p"), store.table("rule_bindings"))
    return got.select("title", F.inline("bindings")).select("title", "label_text", "confidence")


@query("SELECT 'label:' || p_brand AS entity_id, 'cluster' AS entity_kind FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)")
def store_bindings(spark, sf_dir):
    """The bindings of one rule."""
    store, p = _store(spark), read(spark, sf_dir, "part")
    store.add_bindings(p.select(F.col("p_partkey").cast("string").alias("rule_id"), F.lit("cluster").alias("entity_kind"), F.concat(F.lit("label:"), "p_brand").alias("entity_id")))
    return store.bindings_for(str(p.agg(F.min("p_partkey")).first()[0])).select("entity_id", "entity_kind")


@query(_FINDINGS_SQL + "SELECT agreement_id::VARCHAR AS agreement_id, rule_id, severity, outcome FROM f")
def store_findings(spark, sf_dir):
    """A run's findings, recorded at once and read again; another run beside it."""
    store, found = _store(spark), findings(spark, sf_dir)
    store.record(found.withColumn("run_id", F.lit("one")), "2024-01-01")
    store.record(found.filter("rule_id = 'r1'").withColumn("run_id", F.lit("two")), "2024-01-02")
    return store.findings("one").select("agreement_id", "rule_id", "severity", "outcome")


@query(_FINDINGS_SQL + ", one AS (SELECT * FROM f WHERE agreement_id = (SELECT min(agreement_id) FROM f)) SELECT r AS run_id, rule_id, outcome FROM one, (SELECT unnest(['2', '3']) AS r)")
def store_latest(spark, sf_dir):
    """The latest ten evaluations of an agreement that three runs evaluated with five rules."""
    store, contexts = _store(spark), conversation_contexts(spark, sf_dir)
    first = contexts.agg(F.min("agreement_id")).first()[0]
    found = findings(spark, sf_dir).filter(F.col("agreement_id") == first)
    for run in ("1", "2", "3"):
        store.record(found.withColumn("run_id", F.lit(run)), f"2024-01-0{run}")
    return store.latest_evaluations(str(first), 10).select("run_id", "rule_id", "outcome")


@query(f"WITH {_STORED} SELECT title, predicate, status, p_brand || ',' || p_type AS tags FROM s WHERE p_partkey % 3 = 0")
def rules_yaml(spark, sf_dir):
    """Rules written as YAML and read again."""
    store, folder = _store(spark), shared_folder(spark, "yaml")
    store.create_rules(_stored_rules(spark, sf_dir).filter("rule_id % 3 = 0"))
    store.set_status(store.table("policy_rules").filter("rule_id % 2 = 0"), "active", "2024-01-02")
    store.set_status(store.table("policy_rules").filter("rule_id % 4 = 0"), "retired", "2024-01-03")
    store.export_yaml(folder, "p")
    return store.import_yaml(folder).select("title", "predicate", "status", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_STORED} SELECT title, status FROM s")
def rules_json(spark, sf_dir):
    """Rules exported as JSON and read again."""
    folder = shared_folder(spark, "json")
    _filled(spark, sf_dir).export_rules(folder, "p")
    return spark.read.schema("title string, status string").json(folder)


@query(_FINDINGS_SQL + "SELECT agreement_id::VARCHAR AS agreement_id, rule_id, severity, outcome FROM f WHERE outcome = 'fail'")
def findings_csv(spark, sf_dir):
    """A run's findings exported as CSV and read again."""
    store, folder = _store(spark), shared_folder(spark, "csv")
    store.record(findings(spark, sf_dir).filter("outcome = 'fail'").withColumn("run_id", F.lit("one")), "2024-01-01")
    store.export_findings(folder, "one")
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(folder).select("agreement_id", "rule_id", "severity", "outcome")


# ---------------------------------------------------------------- importers


def _nations(spark, sf_dir) -> list:
    """At most a rulebook's worth of rows: the nations table has 25."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", "n_name", "r_name").orderBy("r_name", "n_nationkey").collect()


@query("""SELECT r_name || ' :: ' || n_name AS title, 'Is ' || n_name || ' covered?' AS description, 'cluster' AS applies_to, 'warn' AS severity,
CASE WHEN n_nationkey % 2 = 0 THEN 'standard_nonstandard' ELSE 'yes_no' END AS answer_type, CASE WHEN n_nationkey % 2 = 0 THEN 'Standard|Non' ELSE 'Yes|No' END AS answer_options,
CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE '{"op":"or","args":[{"op":"field.exists","args":["F_' || n_nationkey || '"]},{"op":"and","args":[{"op":"field.exists","args":["G"]},{"op":"field.exists","args":["H_' || n_nationkey || '"]}]}]}' END AS predicate,
CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'Standard' END AS answer FROM nation JOIN region ON n_regionkey = r_regionkey""")
def import_tabular(spark, sf_dir):
    """A workbook with a note above its header; every third row has only an Else branch."""
    rows = [["notes"], ["Topic", "Sub-Topic", "Prompt Question", "Answer Options", "Deployment Logic"]]
    for n in _nations(spark, sf_dir):
        k = n.n_nationkey
        logic = "Else --> Answer = Non" if k % 3 == 0 else f"1) IF F_{k} OR (G AND H_{k}) IS SET --> Answer = Standard\nElse --> Answer = Non"
        rows.append([n.r_name, n.n_name, f"Is {n.n_name} covered?", "Standard: Non;" if k % 2 == 0 else " Yes; No", logic])
    rows.append(["no question", "here", None, "x", ""])
    path = shared_folder(spark, "tabular") + "/rules.xlsx"
    office.write_workbook(spark, path, {"Rules": rows})
    got = office.import_rules(spark, path, "p")
    return got.select("title", "description", "applies_to", "severity", "answer_type", F.array_join("answer_options", "|").alias("answer_options"), "predicate", F.get_json_object("source_provenance", "$.answer").alias("answer"))


@query("""SELECT r_name || ' :: ' || left('Wants ' || n_name || ' changed ' || repeat('y', 90), 80) AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'approval_required' ELSE 'warn' END AS severity,
'owner ' || (n_nationkey % 4) AS escalation_owner, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 'Use ' || n_name END AS preferred_language, r_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey""")
def import_narrative(spark, sf_dir):
    """A workbook of issues in sections, one a region."""
    rows: list[list[str | None]] = [["Section/Topic", "Customer Issue/Request", "Approvals/Notes/Responses", "Escalation Owner(s)", "Edits to offer"]]
    section = None
    for n in _nations(spark, sf_dir):
        if n.r_name != section:
            section = n.r_name
            rows += [[section], [None, "Clause"]]
        k = n.n_nationkey
        rows.append([None, f"Wants {n.n_name} changed {'y' * 90}", "Approval Required by them" if k % 2 == 0 else "fine", f"owner {k % 4}", None if k % 5 == 0 else f"Use {n.n_name}"])
    path = shared_folder(spark, "narrative") + "/issues.xlsx"
    office.write_workbook(spark, path, {"Issues": rows})
    return office.import_rules(spark, path, "p").select("title", "severity", "escalation_owner", "preferred_language", "label")


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY r_name, n_nationkey) + 1 AS row FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'Rule ' || row ELSE n_name END AS title, 'Must name ' || n_name AS nl_assertion, 'good ' || n_name AS reference_text, 'bad & <' || n_name || '>' AS walkaway_language, 0.85::DOUBLE AS similarity_threshold
FROM n WHERE n_nationkey % 7 <> 3""")
def import_paired(spark, sf_dir):
    """A text document's table of desirable and undesirable clauses; some rows have no rule, some no topic."""
    rows = [["Topic", "Sources", "AI Policy Rule", "Desirable Sample Clause", "Undesirable Sample Clause"]]
    for n in _nations(spark, sf_dir):
        k = n.n_nationkey
        rows.append([None if k % 4 == 0 else n.n_name, "s", None if k % 7 == 3 else f"Must name {n.n_name}", f"good {n.n_name}", f"bad & <{n.n_name}>"])
    path = shared_folder(spark, "paired") + "/clauses.docx"
    office.write_document(spark, path, [[["another", "table"]], rows])
    return office.import_rules(spark, path, "p").select("title", "nl_assertion", "reference_text", "walkaway_language", "similarity_threshold")


@query("""WITH n AS (SELECT n_nationkey AS k, n_name FROM nation)
SELECT n_name, 1 AS branch, '{"op":"and","args":[{"op":"or","args":[{"op":"field.exists","args":["A_' || k || '"]},{"op":"field.exists","args":["B"]}]},{"op":"field.exists","args":["C"]}]}' AS predicate, 'Standard ' || k AS answer, false AS is_else FROM n
UNION ALL SELECT n_name, 2, '{"op":"field.exists","args":["D"]}', 'Other', false FROM n WHERE k % 2 = 0
UNION ALL SELECT n_name, CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END, '{"op":"and","args":[]}', 'None', true FROM n""")
def rule_logic_branches(spark, sf_dir):
    """Logic texts with parentheses, wildcards, a line of another form and an Else branch."""
    from ..sources.rule_logic import branches

    k = F.col("n_nationkey").cast("string")
    second = F.when(F.col("n_nationkey") % 2 == 0, "\n2) if D is set -> answer = Other").otherwise("\nsee the notes")
    logic = F.concat(F.lit("1) IF (A_"), k, F.lit(":* OR B) AND C IS SET --> Answer = Standard "), k, second, F.lit("\nElse --> Answer = None"))
    return branches(read(spark, sf_dir, "nation").select("n_name", logic.alias("logic")), "logic").drop("logic")


@query("""SELECT n_name, 'if (not (' || n_name || ' = yes)) then ((cap between ' || n_nationkey || ' and ' || (n_nationkey + 10) || ') or (has clause ' || n_name || ') or (field.gte(cap, 5)))' AS text FROM nation""")
def predicate_texts(spark, sf_dir):
    """Trees as lines of text; a rulebook's worth, on the driver."""
    tree = lambda n: op("if_then", op("not", op("field.eq", n.n_name, "yes")), op("any_of", op("field.between", "cap", n.n_nationkey, n.n_nationkey + 10), op("clause.classified_as", n.n_name), op("field.gte", "cap", 5)))
    rows = [(n.n_name, P.describe(tree(n))) for n in read(spark, sf_dir, "nation").collect()]
    return spark.createDataFrame(rows, "n_name string, text string")


# ---------------------------------------------------------------- alignment


def _position(text: str) -> list[float]:
    """A made-up embedding of short texts: how often some letters occur."""
    return [float(text.count(c)) for c in "enfr"] + [1.0]


def _positions(text):
    return F.array(*((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in "enfr"), F.lit(1.0))


@query("""WITH v AS (SELECT doc_id, [length(lang) - length(replace(lang, 'e', '')), length(lang) - length(replace(lang, 'n', '')), length(lang) - length(replace(lang, 'f', '')), length(lang) - length(replace(lang, 'r', '')), 1]::DOUBLE[] AS e FROM documents)
SELECT doc_id, coalesce(list_dot_product(e, [1, 1, 0, 0, 1]::DOUBLE[]) / (sqrt(list_dot_product(e, e)) * sqrt(3.0::DOUBLE) + 1e-9) >= 0.7, false) AS holds FROM v""")
def pred_semantic_match(spark, sf_dir):
    """A field's text against a literal, both through the context's embedding."""
    from dataclasses import replace

    from .queries import document_context, document_fields

    ctx = replace(document_context(), embed_literal=_position, embed_column=_positions)
    return document_fields(spark, sf_dir).select("doc_id", P.compile_predicate(op("field.semantic_match", "lang", "en", 0.7), ctx).verdict().alias("holds"))


@query("""WITH c AS (SELECT embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT label AS agreement_id, count(*) FILTER (list_dot_product(embedding::DOUBLE[], c) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(c, c)) + 1e-9) >= 0.4) > 0 AS holds FROM embeddings, c GROUP BY label""")
def clause_similar_to(spark, sf_dir):
    """Clusters that hold a vector near the first one."""
    from dataclasses import replace

    e = read(spark, sf_dir, "embeddings")
    reference = e.orderBy("vec_id").first().embedding
    clauses = e.select(F.col("label").alias("agreement_id"), F.col("vec_id").cast("string").alias("id"), F.lit("c").alias("label"), F.lit("clause").alias("text"), F.col("vec_id").alias("ordinal"), F.col("embedding"))
    none = spark.createDataFrame([], "agreement_id int, name string, value string, ordinal long")
    got = context.build(none, clauses)
    got = got.withColumn("domain", F.struct(F.lit("d").alias("id"), F.lit("d").alias("name"))).withColumn("doc", F.struct(F.lit(0.0).alias("value"), F.lit("v").alias("party_role")))
    ctx = replace(P.Context.standard(), embed_literal=lambda _: [float(x) for x in reference])
    return got.select("agreement_id", P.compile_predicate(op("clause.similar_to", "like the first", 0.4), ctx).verdict().alias("holds"))


def _bound(kind: str, label: str) -> list[dict]:
    return [{"entity_kind": kind, "label_text": label}]


SCOPED = [
    {"rule_id": "document", "applies_to": "document", "predicate": op("clause.classified_as", "system")},
    {"rule_id": "cluster", "applies_to": "cluster", "bindings": _bound("cluster", "user"), "predicate": op("count", op("clause.contains", "the"), ">=", 2)},
    {"rule_id": "domain", "applies_to": "domain", "bindings": _bound("domain", "conversation"), "predicate": op("clause.classified_as", "system")},
    {"rule_id": "elsewhere", "applies_to": "domain", "bindings": _bound("domain", "other"), "predicate": op("clause.classified_as", "user")},
    {"rule_id": "field", "applies_to": "field", "bindings": _bound("field", "first_turn"), "predicate": op("field.gte", "first_turn", 100)},
    {"rule_id": "composite", "applies_to": "composite", "predicate": op("and", op("field.exists", "first_turn"), op("clause.absent", "user"))},
    {"rule_id": "cross_field", "applies_to": "cross_field", "predicate": op("or", op("field.lte", "first_turn", 50), op("clause.classified_as", "user"))},
]


@query("""WITH a AS (SELECT conv_id AS agreement_id, bool_or(role = 'system') AS has_system, count(*) FILTER (role = 'user' AND contains(lower(text), 'the')) AS the, max(CASE WHEN turn = 0 THEN length(text) END) AS first_turn FROM conversations GROUP BY 1),
r AS (SELECT agreement_id, unnest(['document', 'cluster', 'domain', 'elsewhere', 'field', 'composite', 'cross_field']) AS rule_id,
unnest([has_system, the >= 2, has_system, false, coalesce(first_turn >= 100, false), first_turn IS NOT NULL, coalesce(first_turn <= 50, false)]) AS holds FROM a)
SELECT agreement_id, rule_id, CASE WHEN holds THEN 'pass' ELSE 'fail' END AS outcome FROM r""")
def align_scoped(spark, sf_dir):
    """Rules that see the document, their clusters, their domains, or values only."""
    return A.align(conversation_contexts(spark, sf_dir), SCOPED, scope="bound").select("agreement_id", "rule_id", "outcome")


@query("""WITH t AS (SELECT conv_id AS agreement_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) FILTER (n <= 3) AS t FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY 1),
v AS (SELECT agreement_id, [length(t) - length(replace(t, 'e', '')), length(t) - length(replace(t, 'n', '')), length(t) - length(replace(t, 'f', '')), length(t) - length(replace(t, 'r', '')), 1]::DOUBLE[] AS e FROM t),
s AS (SELECT agreement_id, list_dot_product(e, [5, 4, 1, 3, 0]::DOUBLE[]) / (sqrt(list_dot_product(e, e)) * sqrt(51.0::DOUBLE) + 1e-9) AS cos FROM v)
SELECT agreement_id, CASE WHEN greatest(0, 1 - cos) > 1 - 0.97::DOUBLE THEN 'fail' ELSE 'pass' END AS outcome, round(greatest(0, 1 - cos), 6) AS deviation FROM s""")
def align_similarity_of_clauses(spark, sf_dir):
    """A similarity rule without a stored target: the first three clauses are embedded."""
    rules = [{"rule_id": "s", "severity": "info", "reference_embedding": [5.0, 4.0, 1.0, 3.0, 0.0], "similarity_threshold": 0.97}]
    got = A.align(conversation_contexts(spark, sf_dir), rules, embed=lambda texts: [_position(t) for t in texts])
    return got.select("agreement_id", "outcome", r6(F.col("deviation")).alias("deviation"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), good AS (SELECT e AS g FROM e WHERE vec_id = 0), bad AS (SELECT e AS b FROM e WHERE vec_id = 1),
s AS (SELECT vec_id, list_dot_product(e, g) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(g, g)) + 1e-9) AS near, list_dot_product(e, b) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(b, b)) + 1e-9) AS bad FROM e, good, bad),
d AS (SELECT vec_id, least(2.0, greatest(0.0, 1 - near) + 0.5 * greatest(0.0, bad)) AS away FROM s)
SELECT vec_id AS agreement_id, CASE WHEN away > 1 - 0.1::DOUBLE THEN 'fail' ELSE 'pass' END AS outcome, round(away, 6) AS deviation FROM d""")
def align_walkaway(spark, sf_dir):
    """A similarity rule that also counts nearness to an undesirable text against a clause."""
    e = read(spark, sf_dir, "embeddings")
    vectors = {r.vec_id: r.embedding for r in e.filter("vec_id < 2").collect()}
    rules = [{"rule_id": "s1", "severity": "info", "reference_embedding": vectors[0], "walkaway_embedding": vectors[1], "walkaway_weight": 0.5, "similarity_threshold": 0.1}]
    got = A.align(e.select(F.col("vec_id").alias("agreement_id"), F.col("embedding").alias("target")), rules, target_col="target", ctx=P.Context())
    return got.select("agreement_id", "outcome", r6(F.col("deviation")).alias("deviation"))


@query(_FINDINGS_SQL + """, t AS (SELECT conv_id AS agreement_id, string_agg(DISTINCT role, ',' ORDER BY role) FILTER (turn % 3 <> 2) AS clause_types, round(avg(1.0::DOUBLE / (1 + turn)) FILTER (turn % 3 <> 2), 6) AS mean_confidence,
count(*) AS paragraphs_total, count(*) FILTER (turn % 3 <> 2) AS paragraphs_processed FROM conversations GROUP BY 1),
v AS (SELECT agreement_id, count(*) AS findings, count(*) FILTER (outcome = 'fail') AS violations FROM f GROUP BY 1)
SELECT agreement_id, findings, violations, coalesce(clause_types, '') AS clause_types, mean_confidence, paragraphs_total, paragraphs_processed FROM v JOIN t USING (agreement_id)""")
def document_report(spark, sf_dir):
    """Every third turn was not told; a clause's confidence falls with its place."""
    c = read(spark, sf_dir, "conversations")
    clauses = c.select(F.col("conv_id").alias("agreement_id"), F.when(F.col("turn") % 3 != 2, F.col("role")).alias("label"), (1 / (1 + F.col("turn"))).alias("confidence"))
    got = A.document_report(findings(spark, sf_dir), clauses)
    return got.select("agreement_id", "findings", "violations", F.array_join("clause_types", ",").alias("clause_types"), r6(F.col("mean_confidence")).alias("mean_confidence"), "paragraphs_total", "paragraphs_processed")


# ---------------------------------------------------------------- mining


@query("""WITH t AS (SELECT count(DISTINCT conv_id) AS t FROM conversations), c AS (SELECT role, count(DISTINCT conv_id) AS n FROM conversations GROUP BY 1)
SELECT 'domain' AS entity_kind, 'label:conversation' AS entity_id, 'conversation' AS label_text, 0.5::DOUBLE AS confidence, floor(n * 100.0::DOUBLE / t + 0.5)::BIGINT || '% of the agreements of conversation have a clause of ' || role AS description, 'conversation,coverage' AS tags
FROM c, t WHERE n::DOUBLE / t >= 0.9""")
def mined_bindings(spark, sf_dir):
    """What coverage rules are bound to, with how they describe themselves."""
    rules = mining.coverage_rules(conversation_clauses(spark, sf_dir), "p")
    got = mining.candidate_bindings(rules).join(rules.select("rule_id", "description", F.array_join("tags", ",").alias("tags")), "rule_id")
    return got.drop("rule_id")


@query(_CENTROID + """SELECT label || ' is near the centre' AS title, 'cluster' AS applies_to, 0.05::DOUBLE AS similarity_threshold, round(count(*) FILTER (cos < 0.05)::DOUBLE / count(*), 6) AS outlier_pct, count(*) AS n FROM s GROUP BY label""")
def mined_outlier_rules(spark, sf_dir):
    got = mining.outlier_rules(read(spark, sf_dir, "embeddings"), "label", "embedding", 0.05, "p")
    figure = lambda name, kind: F.get_json_object("source_provenance", f"$.{name}").cast(kind).alias(name)
    return got.select("title", "applies_to", "similarity_threshold", r6(figure("outlier_pct", "double")).alias("outlier_pct"), figure("n", "long"))


@query("""SELECT CASE WHEN p_size * 10 >= 365 THEN 365.0 WHEN p_size * 10 >= 180 THEN 180.0 WHEN p_size * 10 >= 90 THEN 90.0 WHEN p_size * 10 >= 60 THEN 60.0 WHEN p_size * 10 >= 30 THEN 30.0 WHEN p_size * 10 >= 7 THEN 7.0 ELSE 0.0 END::DOUBLE AS bin, count(*) AS n FROM part GROUP BY 1""")
def fixed_bins(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(mining.fixed_bin(F.col("p_size") * 10).alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT p_brand AS field, p_partkey, p_size > 25 AS flag FROM part WHERE p_size % 5 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY field, flag ORDER BY p_partkey) AS place FROM b)
SELECT field, flag, p_partkey, place FROM r WHERE place <= 2""")
def boolean_examples(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("field"), "p_partkey", F.when(F.col("p_size") % 5 == 0, "perhaps").when(F.col("p_size") > 25, "Yes").otherwise("no").alias("value"))
    return mining.boolean_examples(p, "field", "value", "p_partkey")


@query("""WITH t AS (SELECT source, count(DISTINCT doc_id) AS t FROM documents GROUP BY 1), c AS (SELECT source, lang, count(DISTINCT doc_id)::DOUBLE / any_value(t) AS share FROM documents JOIN t USING (source) GROUP BY 1, 2)
SELECT source, lang, CASE WHEN share >= .5 THEN 'missing' ELSE 'present' END AS flagged, CASE WHEN share >= .8 THEN 'warn' ELSE 'info' END AS severity FROM c WHERE share >= .5 OR share < .2""")
def tier_rules(spark, sf_dir):
    """What labels' tiers make of them: missing ones are flagged where they are usual, present ones where they are rare."""
    return mining.tier_rules(mining.prevalence(read(spark, sf_dir, "documents"), "source", "doc_id", "lang"), "source", "lang")


@query("""WITH n AS (SELECT unnest(['cure_period_days', 'number_of_arbitrators', 'rent_hours', 'grace_months', 'other']) AS field, unnest([180, 9, 720, 120, NULL]) AS high, unnest([0, 1, 0, 0, NULL]) AS low)
SELECT p_partkey, field, CASE WHEN high IS NULL THEN true ELSE p_size * 6 BETWEEN low AND high END AS plausible FROM part, n""")
def numeric_bounds_registry(spark, sf_dir):
    """Known fields by their own bounds, others by their names' endings."""
    names = ["cure_period_days", "number_of_arbitrators", "rent_hours", "grace_months", "other"]
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 6).alias("v"), F.explode(F.array(*map(F.lit, names))).alias("field"))
    return p.select("p_partkey", "field", mining.in_bounds(F.col("field"), F.col("v")).alias("plausible"))


@query(f"""WITH {_SPARSE}, l AS (SELECT list(item ORDER BY item) AS l FROM b GROUP BY basket), z AS (SELECT l, unnest(range(1, 1 << len(l))) AS mask FROM l),
f AS (SELECT list_filter(l, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items, count(*) AS k FROM z GROUP BY 1), q AS (SELECT * FROM f, n WHERE k >= 0.05 * n.n),
x AS (SELECT q.*, unnest(items) AS consequent FROM q WHERE len(items) > 1), y AS (SELECT x.*, list_filter(items, lambda i: i <> consequent) AS antecedent FROM x)
SELECT array_to_string(antecedent, ',') AS antecedent, consequent, array_to_string(list_sort(list_distinct(list_transform(antecedent, lambda i: i[1]))), ',') AS antecedent_clauses, consequent[1] AS consequent_clauses, round(y.k::DOUBLE / a.k, 6) AS confidence
FROM y JOIN q a ON a.items = antecedent JOIN q c ON c.items = [consequent] WHERE y.k::DOUBLE / a.k >= 0.2 AND y.k::DOUBLE / a.k / (c.k::DOUBLE / y.n) >= 0.5 AND NOT list_contains(list_transform(antecedent, lambda i: i[1]), consequent[1])""")
def cross_clause_sets(spark, sf_dir):
    """Rules of several part types, whose first letters are their clause types."""
    baskets = _order_types(spark, sf_dir)
    types = read(spark, sf_dir, "part").select(F.col("p_type").alias("item"), F.substring("p_type", 1, 1).alias("clause_type"))
    got = S.cross_clause_sets(S.itemset_rules(baskets, "basket", "item", 0.05, 0.2), types, confidence=0.2, lift=0.5)
    joined = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return got.select(joined("antecedent"), joined("consequent"), joined("antecedent_clauses"), joined("consequent_clauses"), r6(F.col("confidence")).alias("confidence"))


# ---------------------------------------------------------------- read models of rules


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS description, CASE WHEN p_size % 4 = 0 THEN 'draft' ELSE 'active' END AS status, CASE WHEN p_size % 5 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM part""")
def rules_normalized(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    some = p.select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("description"), F.when(F.col("p_size") % 4 != 0, "active").alias("status"), F.when(F.col("p_size") % 5 != 0, 0.5).alias("confidence"))
    return views.normalized(some)


@query("""WITH own AS (SELECT unnest(['blocker', 'approval_required', 'warn', 'info']) AS severity, unnest(['Blocker', 'Approval', 'Warning', 'Note']) AS label, unnest([0, 1, 2, 3]) AS rank)
SELECT severity, CASE WHEN severity = 'warn' THEN r_name ELSE label END AS label, CASE WHEN severity = 'warn' THEN 9 ELSE rank END AS rank FROM own, region WHERE r_regionkey = 1""")
def severity_palette(spark, sf_dir):
    """What is given overrides known severities; a severity nobody knows is not added."""
    own = spark.createDataFrame([("blocker", "Blocker", 0), ("approval_required", "Approval", 1), ("warn", "Warning", 2), ("info", "Note", 3)], "severity string, label string, rank int")
    given = read(spark, sf_dir, "region").filter("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 1, "warn").otherwise("unheard").alias("severity"), F.col("r_name").alias("label"), F.lit(9).alias("rank"))
    return views.severity_palette(own, given)


_MINERS = """m AS (SELECT p_partkey, p_size, ['coverage', 'distribution', 'categorical', 'outlier', 'contrastive', NULL, NULL][p_partkey % 7 + 1] AS miner, CASE WHEN p_partkey % 7 = 5 THEN p_brand END AS migrated_from, p_size / 50.0::DOUBLE AS share FROM part)
"""


def _sources(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "part")
    names = F.array(*(F.lit(x) for x in ("coverage", "distribution", "categorical", "outlier", "contrastive", None, None)))
    share = F.col("p_size") / 50.0
    return p.select(
        "p_partkey",
        F.struct(
            F.get(names, (F.col("p_partkey") % 7).cast("int")).alias("miner"), F.when(F.col("p_partkey") % 7 == 5, F.col("p_brand")).alias("migrated_from"), F.col("p_size").alias("n"), share.alias("ratio"), share.alias("frequency"),
            share.alias("outlier_pct"), F.col("p_size").alias("p10"), (F.col("p_size") + 10).alias("p90"), (F.col("p_size") + 5).alias("median"), F.col("p_type").alias("mode"), (F.col("p_size") / 4.0).alias("lift_ratio"),
        ).alias("source"),
    )


@query(f"""WITH {_MINERS} SELECT m.p_partkey, CASE miner WHEN 'coverage' THEN 'Coverage ' || floor(share * 100 + 0.5)::BIGINT || '% · n=' || m.p_size WHEN 'distribution' THEN 'Distribution p10–p90 [' || m.p_size || ', ' || (m.p_size + 10) || '] · median ' || (m.p_size + 5)
WHEN 'categorical' THEN 'Mode "' || p_type || '" ' || floor(share * 100 + 0.5)::BIGINT || '% · n=' || m.p_size WHEN 'outlier' THEN 'Outlier ' || floor(share * 100 + 0.5)::BIGINT || '% off-curve · n=' || m.p_size
WHEN 'contrastive' THEN 'Lift ratio ' || printf('%.2f', m.p_size / 4.0::DOUBLE) || '× · n=' || m.p_size ELSE coalesce('Migrated from ' || migrated_from, '—') END AS label FROM m JOIN part ON m.p_partkey = part.p_partkey""")
def provenance_labels(spark, sf_dir):
    return _sources(spark, sf_dir).select("p_partkey", views.provenance_label(F.col("source")).alias("label"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '—' ELSE (floor(floor(p_size / 8.0::DOUBLE * 10 + 0.5) / 10)::BIGINT) || '.' || (floor(p_size / 8.0::DOUBLE * 10 + 0.5)::BIGINT % 10) || '×' END AS lift_shown,
CASE WHEN p_size % 7 = 0 THEN '—' ELSE floor(p_size / 80.0::DOUBLE * 100 + 0.5)::BIGINT || '%' END AS support_shown, CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size END AS n_shown, floor(p_size / 50.0::DOUBLE * 100 + 0.5)::BIGINT || '%' AS confidence_shown FROM part""")
def trust_metrics(spark, sf_dir):
    p, n = read(spark, sf_dir, "part"), F.col("p_size")
    rules = p.select("p_partkey", F.when(n % 5 != 0, n / 8.0).alias("lift"), F.when(n % 7 != 0, n / 80.0).alias("support"), F.when(n % 2 != 0, n).alias("n"), (n / 50.0).alias("confidence"))
    return views.trust(rules).select("p_partkey", "lift_shown", "support_shown", "n_shown", "confidence_shown")


@query("""SELECT p_partkey, least(p_size / 4.0::DOUBLE * 15, 100) AS cluster_bar, least(p_size / 8.0::DOUBLE * 15, 100) AS global_bar, least(p_size / 8.0::DOUBLE * 25, 100) AS ratio_bar FROM part""")
def contrast_bars(spark, sf_dir):
    n = F.col("p_size")
    rules = read(spark, sf_dir, "part").select("p_partkey", (n / 4.0).alias("cluster_lift"), (n / 8.0).alias("global_lift"), (n / 8.0).alias("lift_ratio"))
    return views.contrast_bars(rules).select("p_partkey", "cluster_bar", "global_bar", "ratio_bar")


@query(_FINDINGS_SQL + "SELECT agreement_id, rule_id, severity, outcome FROM f WHERE agreement_id = (SELECT min(agreement_id) FROM f)")
def first_agreement(spark, sf_dir):
    return views.bootstrap(findings(spark, sf_dir)).select("agreement_id", "rule_id", "severity", "outcome")


@query(f"""WITH {_RULES}, s AS (SELECT status, count(*) AS n FROM r GROUP BY 1), v AS (SELECT severity, count(*) AS n FROM r GROUP BY 1)
SELECT '[' || (SELECT string_agg('{{"status":"' || status || '","n":' || n || '}}', ',' ORDER BY status) FROM s) || ']' AS statuses, '[' || (SELECT string_agg('{{"severity":"' || severity || '","n":' || n || '}}', ',' ORDER BY severity) FROM v) || ']' AS severities""")
def report_snapshot(spark, sf_dir):
    """What a static report needs, in one row."""
    r = _rule_rows(spark, sf_dir)
    return views.snapshot(statuses=r.groupBy("status").agg(F.count("*").alias("n")), severities=r.groupBy("severity").agg(F.count("*").alias("n")))


@query(f"""WITH {_LONG}, c AS (SELECT field, value, count(*) AS c FROM v WHERE value IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY c DESC, value) AS place, count(*) OVER (PARTITION BY field) AS k FROM c)
SELECT field, k AS distinct_values, CASE WHEN k <= 12 THEN string_agg(value, ',' ORDER BY value) END AS enum_values FROM t WHERE value IS NOT NULL GROUP BY 1, 2""")
def field_enums(spark, sf_dir):
    """The values of fields that have twelve at most."""
    return views.field_enums(_field_values(spark, sf_dir), "field", "value").withColumn("enum_values", F.array_join("enum_values", ","))


@query("SELECT source, string_agg(lang || '=' || n, ',' ORDER BY lang) AS frequencies FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def frequency_maps(spark, sf_dir):
    counts = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("frequencies")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return views.frequency_map(counts, ["source"], "lang").select("source", shown.alias("frequencies"))


@query("""WITH w AS (SELECT p_partkey, p_size % 5 AS k, p_size FROM part) SELECT p_partkey, CASE k WHEN 0 THEN 12.0 WHEN 1 THEN p_size WHEN 2 THEN 20.0 END::DOUBLE AS number,
CASE k WHEN 1 THEN p_size * 1000 WHEN 4 THEN p_size + 0.5 END::DOUBLE AS amount, k <> 3 AS plain FROM w""")
def number_texts(spark, sf_dir):
    """Numbers in words, amounts of money, and texts that words speak against."""
    from ..functions.scalars import mentions_none, money, word_number

    k, size = F.col("p_size") % 5, F.col("p_size").cast("string")
    words = F.when(k == 0, "Twelve").when(k == 1, size).when(k == 2, " twenty ").when(k == 3, "shall NOT count")
    amounts = F.when(k == 1, F.concat(F.lit("$"), size, F.lit(",000"))).when(k == 3, "about 5").when(k == 4, F.concat(size, F.lit(".5%")))
    return read(spark, sf_dir, "part").select("p_partkey", word_number(words).alias("number"), money(amounts).alias("amount"), mentions_none(words, ["not", "never"]).alias("plain"))


# ---------------------------------------------------------------- application calls


@query("""WITH a AS (SELECT conv_id AS agreement_id, max(CASE WHEN turn = 0 THEN 1 END) IS NOT NULL AS first_turn FROM conversations GROUP BY 1),
r AS (SELECT unnest(['Length :: First', 'Length :: Other', 'Length :: Either']) AS title)
SELECT agreement_id::VARCHAR AS agreement_id, title, CASE WHEN title <> 'Length :: Other' AND first_turn THEN 'pass' ELSE 'fail' END AS outcome, '3 rules from rules.xlsx' AS description FROM a, r""")
def import_run_record(spark, sf_dir):
    """A rulebook imported, activated, run over all conversations, and its findings read from the store."""
    rows = [["Topic", "Subtopic", "Prompt Question", "Answer Type", "Deployment Logic"]]
    rows += [["Length", name, "Is it there?", "Yes; No", f"IF {logic} IS SET --> Answer = Yes"] for name, logic in (("First", "first_turn"), ("Other", "second_turn"), ("Either", "second_turn OR first_turn"))]
    path = shared_folder(spark, "service") + "/rules.xlsx"
    office.write_workbook(spark, path, {"Rules": rows})
    store = _store(spark)
    policy_id = service.import_policy(store, path, "Lengths", "2024-01-01")
    store.set_status(store.rules(policy_id), "active", "2024-01-02")
    found = service.run(store, policy_id, conversation_contexts(spark, sf_dir), "run", "2024-01-03")
    named = found.join(store.rules(policy_id).select("rule_id", "title"), "rule_id")
    return named.join(service.policy(store, policy_id).select("description"), F.lit(True)).select("agreement_id", "title", "outcome", "description")  # one policy


@query("""SELECT conv_id AS agreement_id, row_number() OVER (ORDER BY turn) - 1 AS place, conv_id || ':' || turn AS id, role AS label, text FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)""")
def contract_view(spark, sf_dir):
    contexts = conversation_contexts(spark, sf_dir)
    return views.contract(contexts, contexts.agg(F.min("agreement_id")).first()[0])


@query(f"""WITH {_LONG}, f AS (SELECT field, count(value) AS n, count(DISTINCT doc_id) FILTER (value IS NOT NULL) AS have FROM v WHERE field IN ('quality', 'toxic') GROUP BY 1),
c AS (SELECT field, value, count(*) AS c FROM v WHERE value IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY c DESC, value) AS place FROM c)
SELECT f.field AS field_id, n, round(have * 100.0 / (SELECT count(DISTINCT doc_id) FROM documents), 6) AS coverage_pct, string_agg(t.value, ',' ORDER BY place) AS examples FROM f JOIN t ON f.field = t.field AND place <= 5 GROUP BY 1, 2, 3""")
def cluster_fields(spark, sf_dir):
    """The fields that come from labels, as one cluster's."""
    v = _field_values(spark, sf_dir).filter("value is not null").select(F.col("field").alias("field_id"), F.col("doc_id").alias("agreement_id"), "value")
    fields = spark.createDataFrame([("quality", "labels"), ("toxic", "labels"), ("lang", "documents"), ("n_chars", "documents")], "field_id string, cluster_id string")
    got = views.cluster_fields(fields, v, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("agreement_id")), "labels")
    return got.select("field_id", "n", r6(F.col("coverage_pct")).alias("coverage_pct"), F.array_join("examples", ",").alias("examples"))


@query(f"""WITH {_LONG}, b AS (SELECT field, count(*) AS n, list_sort(list(value::DOUBLE)) AS v, median(value::DOUBLE) AS median FROM v WHERE value IS NOT NULL AND field <> 'lang' GROUP BY 1)
SELECT field, n, v[CAST(floor(0.1::DOUBLE * (n - 1)) AS BIGINT) + 1] AS lo, v[CAST(floor(0.9::DOUBLE * (n - 1)) AS BIGINT) + 1] AS hi, median FROM b""")
def field_ranges(spark, sf_dir):
    """Ranges of the fields that turn out to be numeric."""
    return views.field_ranges(_field_values(spark, sf_dir), "field", "value")
