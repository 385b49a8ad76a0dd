"""Queries over the shop's tables: itemsets by cluster, the four kinds of flags, and what follows from them.

A sale stands for a document, the kinds of the items in it for its clauses, its status for the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.stored import sent, stored
from ..operators import align as A
from ..operators import clustering, composites, itemsets, keywords, rebinding, scoring, segments
from ..operators.judging import JudgeMemo
from ..sources.store import shared_folder
from . import views
from .queries import QUERIES, RULES, SQL, conversation_contexts, document_context, document_fields, op, query, r6, read

SUPPORT, CONFIDENCE = 0.05, 0.4
PAIR_LIFT, PAIR_SHARE = 0.9, 0.3
RARE = 0.4


def sale_kinds(spark, sf_dir) -> DataFrame:
    """status, sale_id, kind: each kind of item in each sale once."""
    lines, items, sales = (read(spark, sf_dir, t) for t in ("sale_lines", "items", "sales"))
    kinds = items.select("item_id", "kind").dropna().distinct()
    got = lines.select("sale_id", "item_id").dropna().join(kinds, "item_id").select("sale_id", "kind").distinct()
    return got.join(sales.select("sale_id", "status").dropna().distinct(), "sale_id").select("status", "sale_id", "kind")


_KINDS = """b AS (SELECT DISTINCT s.status, l.sale_id, i.kind FROM sale_lines l JOIN items i ON l.item_id = i.item_id JOIN sales s ON l.sale_id = s.sale_id WHERE i.kind IS NOT NULL AND s.status IS NOT NULL),
nb AS (SELECT status, count(DISTINCT sale_id) AS baskets, greatest(ceil(count(DISTINCT sale_id) * 0.05::DOUBLE - 1e-9), 5) AS least FROM b GROUP BY 1 HAVING count(DISTINCT sale_id) >= 20),
l AS (SELECT status, list(kind ORDER BY kind) AS l FROM b GROUP BY status, sale_id), z AS (SELECT status, l, unnest(range(1, 1 << len(l))) AS mask FROM l),
f AS (SELECT status, list_filter(l, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items, count(*) AS n FROM z GROUP BY 1, 2),
q AS (SELECT status, items, n, baskets FROM f JOIN nb USING (status) WHERE n >= least),
x AS (SELECT status, items, n, baskets, unnest(items) AS consequent FROM q WHERE len(items) > 1),
y AS (SELECT status, n, baskets, consequent, list_filter(items, lambda i: i <> consequent) AS antecedent FROM x),
r AS (SELECT y.status, 'G' || left(sha256(y.status || '|' || array_to_string(antecedent, ',') || '|' || consequent), 8) AS rule_id, antecedent, consequent, y.n::DOUBLE / y.baskets AS support,
y.n::DOUBLE / a.n AS confidence, (y.n * y.baskets)::DOUBLE / (a.n * c.n)::DOUBLE AS lift
FROM y JOIN q a ON a.status = y.status AND a.items = antecedent JOIN q c ON c.status = y.status AND c.items = [consequent])
"""


@query(f"WITH {_KINDS} SELECT status, array_to_string(items, ',') AS items, n, baskets FROM q")
def itemsets_by_cluster(spark, sf_dir):
    got = itemsets.frequent_itemsets(sale_kinds(spark, sf_dir), "status", "sale_id", "kind", SUPPORT)
    return got.select("status", F.array_join("items", ",").alias("items"), "n", "baskets")


def _contents(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sales' contents, how many sales have each, and the association rules of each status."""
    lists = itemsets.contents(sale_kinds(spark, sf_dir), "status", "sale_id", "kind")
    counts = itemsets.counts_of(lists)
    return lists, counts, itemsets.rules_of(itemsets.itemsets_of(counts, SUPPORT), "group", CONFIDENCE)


@query(f"WITH {_KINDS} SELECT status, rule_id, array_to_string(antecedent, ',') AS antecedent, consequent, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM r WHERE confidence >= {CONFIDENCE} - 1e-9")
def itemset_rules_by_cluster(spark, sf_dir):
    _, _, got = _contents(spark, sf_dir)
    return got.select(F.col("group").alias("status"), "rule_id", F.array_join("antecedent", ",").alias("antecedent"), F.col("consequent")[0].alias("consequent"), *(r6(F.col(c)).alias(c) for c in ("support", "confidence", "lift")))


def _flags(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lists, counts, rules = _contents(spark, sf_dir)
    return lists, scoring.content_flags(counts, rules, 0.5, RARE, PAIR_LIFT, PAIR_SHARE)


_DEVIATIONS = f"""{_KINDS.strip()},
sh AS (SELECT status, kind, count(DISTINCT sale_id)::DOUBLE / any_value(t) AS share FROM b JOIN (SELECT status, count(DISTINCT sale_id) AS t FROM b GROUP BY 1) USING (status) GROUP BY 1, 2),
baskets AS (SELECT status, sale_id, list(kind) AS has FROM b GROUP BY 1, 2),
arm AS (
  SELECT sale_id, r.consequent AS about, rule_id, confidence, lift FROM baskets k JOIN r ON r.status = k.status
  WHERE confidence >= {CONFIDENCE} - 1e-9 AND list_has_all(has, antecedent) AND NOT list_contains(has, r.consequent)
  QUALIFY row_number() OVER (PARTITION BY sale_id, r.status, r.consequent ORDER BY lift DESC, confidence DESC, rule_id) = 1),
pr AS (
  SELECT x.status, x.kind AS a, y.kind AS c, count(*) AS n_both FROM b x JOIN b y ON x.sale_id = y.sale_id AND x.status = y.status AND x.kind < y.kind GROUP BY 1, 2, 3),
one AS (SELECT status, kind, count(*) AS k FROM b GROUP BY 1, 2), al AS (SELECT status, count(DISTINCT sale_id) AS n FROM b GROUP BY 1),
odd AS (
  SELECT pr.status, a, c, (n_both * n)::DOUBLE / (ia.k * ic.k)::DOUBLE AS lift FROM pr JOIN al USING (status) JOIN one ia ON ia.status = pr.status AND ia.kind = a JOIN one ic ON ic.status = pr.status AND ic.kind = c
  JOIN sh sa ON sa.status = pr.status AND sa.kind = a JOIN sh sc ON sc.status = pr.status AND sc.kind = c WHERE sa.share >= {PAIR_SHARE} AND sc.share >= {PAIR_SHARE} AND (n_both * n)::DOUBLE / (ia.k * ic.k)::DOUBLE < {PAIR_LIFT}),
fl AS (
  SELECT sale_id, 'missing_arm_consequent' AS flag, about, rule_id, NULL::DOUBLE AS prevalence_gap, confidence, lift FROM arm
  UNION ALL SELECT sale_id, 'missing_expected', sh.kind, NULL, share, NULL, NULL FROM baskets k JOIN sh ON sh.status = k.status WHERE share >= 0.5 AND NOT list_contains(has, sh.kind)
  UNION ALL SELECT sale_id, 'unexpected_clause', b.kind, NULL, 1 - share, NULL, NULL FROM b JOIN sh ON sh.status = b.status AND sh.kind = b.kind WHERE share < {RARE}
  UNION ALL SELECT sale_id, 'rare_combination', a || '+' || c, NULL, NULL, NULL, lift FROM baskets k JOIN odd ON odd.status = k.status WHERE list_contains(has, a) AND list_contains(has, c))
"""


@query(f"WITH {_DEVIATIONS} SELECT sale_id, flag, about, rule_id, round(prevalence_gap, 6) AS prevalence_gap, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM fl")
def deviation_flags(spark, sf_dir):
    lists, flags = _flags(spark, sf_dir)
    each = lists.join(sent(flags), ["group", "has"])
    return each.select(F.col("basket").alias("sale_id"), F.col("kind").alias("flag"), "about", "rule_id", *(r6(F.col(c)).alias(c) for c in ("prevalence_gap", "confidence", "lift")))


@query(f"""WITH {_DEVIATIONS}, sc AS (
  SELECT sale_id, count(DISTINCT flag) AS kinds, sum(CASE flag WHEN 'missing_arm_consequent' THEN 3.0::DOUBLE WHEN 'missing_expected' THEN 2.0 WHEN 'unexpected_clause' THEN 1.5 ELSE 1.0 END
  * (1 + 2.0::DOUBLE * coalesce(prevalence_gap, 0) + 1.5::DOUBLE * coalesce(confidence, 0) + 0.5::DOUBLE * coalesce(lift, 0))) AS score FROM fl GROUP BY 1)
SELECT sale_id, kinds, round(score, 5) AS score, CASE WHEN score >= 5 THEN 'high' WHEN score >= 2.5 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS tier FROM sc""")
def deviation_of_all_kinds(spark, sf_dir):
    """Scores to which all four kinds of flags add."""
    lists, flags = _flags(spark, sf_dir)
    scores = stored(scoring.deviation_score(flags, ["group", "has"], F.size(F.collect_set("kind")).cast("long").alias("kinds")), "scores")
    got = lists.join(sent(scores), ["group", "has"])
    return got.select(F.col("basket").alias("sale_id"), "kinds", F.round("score", 5).alias("score"), "tier")


# ---------------------------------------------------------------- vectors


def vector_clusters(spark, sf_dir):
    """Eight macro clusters of the vectors, each split in two where that makes it more coherent, and again. SQL can't iterate so; tests hold it against plain rounds."""
    vectors = read(spark, sf_dir, "embeddings")
    fitted = clustering.fit(vectors, "vec_id", "embedding", 8, levels=2, least=20, cohesive=0.9)
    return clustering.assign(vectors, fitted, "vec_id", "embedding").select("vec_id", F.split("path", r"\.")[0].cast("int").alias("macro"), F.col("path").alias("micro"), r6(F.col("distance")).alias("distance"))


QUERIES["vector_clusters"] = vector_clusters


@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda v: v / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)
SELECT a.label, CAST((1 + sqrt(1 + 8 * count(*))) / 2 AS BIGINT) AS n, round(avg(list_dot_product(a.u, b.u)), 5) AS cohesion FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""")
def cluster_cohesion(spark, sf_dir):
    """The mean cosine of all pairs of a cluster's vectors, without forming pairs."""
    return clustering.cohesion(read(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("cohesion", F.round("cohesion", 5))


@query("""WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: v / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
x AS (SELECT a.vec_id AS binding_id, b.vec_id AS cluster_id, list_dot_product(a.u, b.u) AS cos FROM u a, u b WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0)
SELECT binding_id, arg_max(cluster_id, cos) AS cluster_id, round(max(cos), 5) AS confidence, max(cos) >= 0.4 AS rebound FROM x GROUP BY 1""")
def rebind_by_index(spark, sf_dir):
    """Every twentieth vector is a binding, the others are clusters: the nearest one through the index, and the exact way beyond it."""
    e = read(spark, sf_dir, "embeddings")
    bindings = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("binding_id"), F.col("embedding").alias("label_embedding"))
    clusters = e.filter("vec_id % 20 <> 0").select(F.col("vec_id").alias("cluster_id"), "embedding")
    return rebinding.rebind(bindings, clusters, 0.4).withColumn("confidence", F.round("confidence", 5))


# ---------------------------------------------------------------- composites and the judge's memo

COMPOSITES = [
    {"name": "grade", "combine": "choose", "when": op("field.gte", "exposure", 3), "then": "exposure", "otherwise": "size"},
    {"name": "exposure", "combine": "sum", "parts": ["risk", "labels", "size"]},
    {"name": "risk", "combine": "sum", "parts": ["toxic", "quality"], "weights": [5, -1]},
    {"name": "labels", "combine": "count", "parts": ["toxic", "quality"]},
    {"name": "size", "combine": "sum", "parts": ["n_chars"], "weights": [0.001], "missing": "null"},
    {"name": "name", "combine": "join", "parts": ["lang", "source"], "separator": "/"},
]


@query("""WITH l1 AS (
  SELECT d.doc_id, CASE WHEN toxic IS NULL THEN -quality WHEN quality IS NULL THEN 5 * toxic ELSE 5 * toxic - quality END::DOUBLE AS risk,
         (toxic IS NOT NULL)::INT + (quality IS NOT NULL)::INT AS labels, n_chars * 0.001::DOUBLE AS size, concat_ws('/', lang, source) AS name FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
l2 AS (SELECT *, coalesce(risk, 0) + labels + coalesce(size, 0) AS exposure FROM l1), l3 AS (SELECT *, CASE WHEN exposure >= 3 THEN exposure ELSE size END AS grade FROM l2)
SELECT doc_id, round(risk, 6) AS risk, round(exposure, 6) AS exposure, round(grade, 6) AS grade, name, CASE WHEN grade >= 1.5 THEN 'pass' ELSE 'fail' END AS outcome FROM l3""")
def composite_cascade(spark, sf_dir):
    """Three levels of composites, and a rule about the last."""
    rows, ctx = composites.attach(document_fields(spark, sf_dir), COMPOSITES, document_context())
    holds = P.compile_predicate(op("field.gte", "grade", 1.5), ctx).verdict()
    return rows.select("doc_id", *(r6(F.col(f"composite_{c}.d")).alias(c) for c in ("risk", "exposure", "grade")), F.col("composite_name.s").alias("name"), F.when(holds, "pass").otherwise("fail").alias("outcome"))


def align_judge_memo(spark, sf_dir):
    """``align_judge`` with a memo, twice: the second run finds every answer."""
    rules = [r for r in RULES if r["rule_id"] == "r2"] + [
        {"rule_id": "j1", "severity": "info", "nl_assertion": "even"},
        {"rule_id": "j2", "severity": "info", "nl_assertion": "even", "predicate": op("or", op("clause.absent", "system"), op("no.such.operator"))},
    ]
    memo = JudgeMemo(spark, shared_folder(spark, "memo"))
    A.align(conversation_contexts(spark, sf_dir), rules, judge=lambda assertion, text: "pass" if len(text) % 2 == 0 else "fail", memo=memo)
    got = A.align(conversation_contexts(spark, sf_dir), rules, judge=lambda assertion, text: 1 / 0, memo=memo)
    return got.select("agreement_id", "rule_id", "outcome")


QUERIES["align_judge_memo"], SQL["align_judge_memo"] = align_judge_memo, SQL["align_judge"]


# ---------------------------------------------------------------- texts

_ABOVE = " || ".join(
    f"CASE WHEN level >= {k} AND coalesce(a{k} > greatest(-1, {', '.join(f'coalesce(a{j}, -1)' for j in range(1, k)) or '-1'}), false) THEN ' > ' || n{k} ELSE '' END" for k in range(1, segments.LEVELS + 1)
)
_LAST = ", ".join(f"max(pos) FILTER (level = {k}) OVER w AS a{k}, arg_max(number, pos) FILTER (level = {k}) OVER w AS n{k}" for k in range(1, segments.LEVELS + 1))


@query(f"""WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
m AS (SELECT doc_id, pos, length(line) + 1 AS size, length(text) AS whole, regexp_extract(line, '{segments.ARTICLE}', 1) AS x1, regexp_extract(line, '{segments.DECIMAL}', 1) AS x2,
  regexp_extract(line, '{segments.LETTER}', 1) AS x3, regexp_extract(line, '{segments.ROMAN}', 1) AS x4 FROM l),
p AS (SELECT doc_id, pos, whole, coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  CASE WHEN x1 <> '' THEN 1 WHEN x2 <> '' THEN least(1 + len(string_split(x2, '.')), 8) WHEN x3 <> '' THEN 9 WHEN x4 <> '' THEN 10 END AS level, CASE WHEN x1 <> '' THEN x1 WHEN x2 <> '' THEN x2 WHEN x3 <> '' THEN x3 ELSE x4 END AS number FROM m),
h AS (SELECT doc_id, pos, whole, start, coalesce(level, 0) AS level, number FROM p WHERE level IS NOT NULL OR (pos = 0 AND whole > 0)),
a AS (SELECT *, {_LAST} FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT doc_id, row_number() OVER o - 1 AS ordinal, level, substr({_ABOVE}, 4) AS path, CAST(start AS BIGINT) AS start, CAST(coalesce(lead(start) OVER o, whole) - start AS BIGINT) AS length FROM a WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT s.doc_id, ordinal, level, path, start, s.length, md5(substr(text, start + 1, s.length)) AS clause_md5 FROM s JOIN documents d ON s.doc_id = d.doc_id""")
def document_clauses(spark, sf_dir):
    """Every whole text cut at its numbered headings, with the path of headings above each clause."""
    return segments.clauses(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").withColumn("clause_md5", F.md5("clause")).drop("clause")


@query(r"""WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[\p{L}]{3,}')) AS word FROM documents WHERE source IS NOT NULL), c AS (SELECT source, word, count(*) AS n FROM w GROUP BY 1, 2),
t AS (SELECT source, sum(n) AS words FROM c GROUP BY 1), o AS (SELECT word, sum(n) AS o FROM c GROUP BY 1)
SELECT source, word, n, round(n::DOUBLE / words * ln(1 + (SELECT avg(words) FROM t) / o), 9) AS weight FROM c JOIN t USING (source) JOIN o USING (word)""")
def keyword_weights(spark, sf_dir):
    """Class-based TF-IDF of every word of whole texts by source."""
    counts = keywords.word_counts(read(spark, sf_dir, "documents"), "source", "text")
    return keywords.weights(counts, "source").withColumn("weight", F.round("weight", 9))


def cluster_keywords(spark, sf_dir):
    """Five keywords a source, chosen by maximal marginal relevance; tests hold the choice against brute force."""
    counts = keywords.word_counts(read(spark, sf_dir, "documents"), "source", "text")
    return keywords.keywords(keywords.weights(counts, "source"), "source").withColumn("weight", F.round("weight", 9))


QUERIES["cluster_keywords"] = cluster_keywords


# ---------------------------------------------------------------- revisions


@query("""WITH p AS (SELECT p_partkey::VARCHAR AS rule_id, p_partkey AS k, p_name AS title, p_size AS n FROM part)
SELECT rule_id, 1 AS version, title, '{"op":"field.gte","args":["size",' || n || ']}' AS predicate FROM p
UNION ALL SELECT rule_id, 2, title, '{"op":"not","args":[{"op":"field.gte","args":["size",' || n + 1 || ']}]}' FROM p WHERE k % 3 = 0
UNION ALL SELECT rule_id, 3, title || ' (again)', '{"op":"not","args":[{"op":"field.gte","args":["size",' || n + 1 || ']}]}' FROM p WHERE k % 9 = 0""")
def rule_revisions(spark, sf_dir):
    """Parts as rules: a third are revised, a ninth twice; every version comes back from the diffs."""
    from ..sources import revisions
    from ..sources.store import Store

    store = Store(spark, shared_folder(spark, "store"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("rule_id"), F.col("p_partkey").alias("k"), F.col("p_name").alias("title"), F.col("p_size").alias("n"))
    tree = lambda n: F.concat(F.lit('{"op":"field.gte","args":["size",'), n.cast("string"), F.lit("]}"))
    store.create_rules(parts.select("rule_id", "title", tree(F.col("n")).alias("predicate")))
    revisions.revise(store, parts.filter("k % 3 = 0").select("rule_id", F.concat(F.lit('{"op":"not","args":['), tree(F.col("n") + 1), F.lit("]}")).alias("predicate")), "reviewer", "turned round", "2024-02-01 00:00:00")
    revisions.revise(store, parts.filter("k % 9 = 0").select("rule_id", F.concat("title", F.lit(" (again)")).alias("title")), "reviewer", "named anew", "2024-03-01 00:00:00")
    return revisions.history(store).select("rule_id", "version", F.get_json_object("document", "$.title").alias("title"), F.get_json_object("document", "$.predicate").alias("predicate"))


# ---------------------------------------------------------------- streams


@query("""WITH v AS (SELECT client_id, seq, unnest(['segment', 'city']) AS name, unnest([segment, city]) AS value FROM client_changes WHERE client_id IS NOT NULL),
w AS (SELECT client_id, name, value FROM v WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id, name ORDER BY seq DESC NULLS LAST, value DESC) = 1)
SELECT client_id, max(value) FILTER (name = 'segment') AS segment, max(value) FILTER (name = 'city') AS city FROM w GROUP BY 1 HAVING count(*) = 2""")
def streamed_contexts(spark, sf_dir):
    """Clients' contexts from their changes as a stream: the last one that went out of each client that is complete."""
    from ..streaming import contexts

    changes = read(spark, sf_dir, "client_changes")
    stream = spark.readStream.schema(changes.schema).parquet(f"{sf_dir}/client_change[s].parquet")
    values = stream.select(F.col("client_id").alias("agreement_id"), F.col("seq").alias("ordinal"), F.expr("stack(2, 'segment', segment, 'city', city) as (name, value)"))
    folder = shared_folder(spark, "contexts")
    emitted = contexts.context_stream(values, ["segment", "city"]).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    emitted.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = contexts.latest(spark.read.schema("agreement_id long, revision int, fields map<string,string>").parquet(f"{folder}/out"))
    return got.select(F.col("agreement_id").alias("client_id"), F.col("fields.segment").alias("segment"), F.col("fields.city").alias("city"))


# ---------------------------------------------------------------- texts of rules


@query("""SELECT p_partkey::VARCHAR AS rule_id, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'ask a lawyer' ELSE
'if (not (brand = ' || p_brand || ')) then ((size between ' || p_size || ' and ' || (p_size + 10) || ') or (has clause ' || p_type || ') or (field.gte(price, ' || p_size * 2 || ')))' END AS text FROM part""")
def rule_texts(spark, sf_dir):
    """Parts as rules: every rule's tree as a line of text, made where the rules are."""
    p = read(spark, sf_dir, "part")
    node = lambda name, *args: F.struct(F.lit(name).alias("op"), F.array(*args).alias("args"))
    between = F.concat(F.lit('{"op":"field.between","args":["size",'), F.col("p_size").cast("string"), F.lit(","), (F.col("p_size") + 10).cast("string"), F.lit("]}"))
    least = F.concat(F.lit('{"op":"field.gte","args":["price",'), (F.col("p_size") * 2).cast("string"), F.lit("]}"))
    unless = F.concat(F.lit('{"op":"not","args":['), F.to_json(node("field.eq", F.lit("brand"), F.col("p_brand"))), F.lit("]}"))
    either = F.concat(F.lit('{"op":"any_of","args":['), F.concat_ws(",", between, F.to_json(node("clause.classified_as", F.col("p_type"))), least), F.lit("]}"))
    tree = F.concat(F.lit('{"op":"if_then","args":['), unless, F.lit(","), either, F.lit("]}"))
    predicate = F.when(F.col("p_size") % 5 == 1, "ask a lawyer").when(F.col("p_size") % 5 != 0, tree)
    return p.select(F.col("p_partkey").cast("string").alias("rule_id"), views.predicate_text(predicate).alias("text"))
