"""Composite fields in order, their cascades, and the judge's memo."""

import pytest
from clausewright.functions import predicates as P
from clausewright.operators import align, composites, judging
from clausewright.operators.context import typed_field
from pyspark.sql import functions as F

CHAIN = [
    {"name": "c", "combine": "sum", "parts": ["b", "x"]},
    {"name": "b", "combine": "mean", "parts": ["a", "y"]},
    {"name": "a", "combine": "greatest", "parts": ["x", "y"]},
    {"name": "far", "combine": "count", "parts": ["z"]},
]


def test_levels_cascades_and_cycles(spark):
    assert [[d["name"] for d in level] for level in composites.levels(CHAIN)] == [["a", "far"], ["b"], ["c"]]
    assert composites.cascade(CHAIN, ["y"]) == ["a", "b", "c"] and composites.cascade(CHAIN, ["z"]) == ["far"] and composites.cascade(CHAIN, ["b"]) == ["c"]
    assert composites.levels([]) == [] and composites.cascade(CHAIN, ["other"]) == []
    with pytest.raises(ValueError, match="p -> q -> r -> p"):
        composites.levels([{"name": "p", "combine": "sum", "parts": ["q"]}, {"name": "q", "combine": "sum", "parts": ["r", "x"]}, {"name": "r", "combine": "choose", "when": {"op": "field.gte", "args": ["p", 1]}, "then": "x"}])
    with pytest.raises(ValueError, match="s -> s"):
        composites.levels([{"name": "s", "combine": "sum", "parts": ["s"]}])
    with pytest.raises(ValueError, match="twice"):
        composites.levels([CHAIN[0], CHAIN[0]])
    for bad in ({"combine": "median", "parts": ["x"]}, {"combine": "sum", "parts": []}, {"combine": "sum", "parts": ["x"], "weights": [1, 2]}):
        with pytest.raises(ValueError, match="composite"):
            composites.value_of({"name": "n", **bad}, P.Context())


def fields(spark, rows):
    df = spark.createDataFrame(rows, "id int, x double, y double, flag boolean, word string")
    kinds = {"x": "number", "y": "number", "flag": "bool", "word": "string"}
    return df, P.Context(fields={k: typed_field(F.col(k), kind) for k, kind in kinds.items()})


ROWS = [(1, 1.0, 2.0, True, "yes"), (2, None, 4.0, False, None), (3, 5.0, None, None, "no"), (4, None, None, None, None)]


def test_chains_of_composites(spark):
    df, ctx = fields(spark, ROWS)
    got, _ = composites.attach(df, CHAIN, ctx)
    value = lambda r: tuple(None if r[f"composite_{n}"] is None else r[f"composite_{n}"].d for n in "abc")
    assert {r.id: value(r) for r in got.collect()} == {1: (2.0, 2.0, 3.0), 2: (4.0, 4.0, 4.0), 3: (5.0, 5.0, 10.0), 4: (None, None, None)}


@pytest.mark.parametrize(("definition", "want"), [
    ({"combine": "sum", "parts": ["x", "y"], "missing": "null"}, [3.0, None, None, None]),
    ({"combine": "mean", "parts": ["x", "y"], "weights": [3, 1]}, [1.25, 4.0, 5.0, None]),
    ({"combine": "least", "parts": ["x", "y"]}, [1.0, 4.0, 5.0, None]),
    ({"combine": "count", "parts": ["x", "word"]}, [2.0, 0.0, 2.0, 0.0]),
    ({"combine": "all", "parts": ["flag", "word"]}, ["true", "false", "false", None]),
    ({"combine": "any", "parts": ["flag", "word"]}, ["true", "false", "false", None]),
    ({"combine": "join", "parts": ["word", "x"], "separator": "-"}, ["yes-1.0", None, "no-5.0", None]),
    ({"combine": "choose", "when": {"op": "field.gte", "args": ["x", 2]}, "then": "x", "otherwise": "y"}, [2.0, 4.0, 5.0, None]),
])
def test_combinations(spark, definition, want):
    df, ctx = fields(spark, ROWS)
    got, _ = composites.attach(df, [{"name": "n", **definition}], ctx)
    value = lambda v: None if v is None else v.d if isinstance(next(w for w in want if w is not None), float) else v.s
    assert [value(r.composite_n) for r in got.orderBy("id").collect()] == want


def test_only_the_cascade_is_computed_anew_and_rules_see_it(spark):
    df, ctx = fields(spark, ROWS)
    before, _ = composites.attach(df.withColumn("z", F.lit(1.0)), [*CHAIN[:3], {"name": "far", "combine": "count", "parts": ["word"]}], ctx)
    stale = before.withColumn("x", F.lit(100.0)).withColumn("word", F.lit("changed"))
    after, seen = composites.attach(stale, [*CHAIN[:3], {"name": "far", "combine": "count", "parts": ["word"]}], ctx, changed=["x"])
    rows = {r.id: r for r in after.withColumn("holds", P.compile_predicate({"op": "field.gte", "args": ["c", 150]}, seen).verdict()).collect()}
    assert rows[1].composite_c.d == 151.0 and rows[4].composite_c.d == 200.0 and rows[4].composite_far.d == 0.0  # far as it was
    assert all(r.holds for r in rows.values())


def test_each_question_is_asked_once(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def judge(assertion, evidence):
        import uuid

        (log / uuid.uuid4().hex).write_text(f"{assertion}|{evidence}")
        return {"a": "pass", "b": "fail", "c": "what?"}.get(evidence[:1])

    texts = ["apple", "apple", "ball", "cat", "ball", "", None, "apple"] * 5
    found = spark.createDataFrame([(k, t, "is so", k % 4 != 3) for k, t in enumerate(texts)] + [(100, "apple", None, True), (101, "apple", "is not", True)], "k int, heard string, assertion string, judge_asked boolean").repartition(4)
    memo = judging.JudgeMemo(spark, str(tmp_path / "memo"))
    verdicts = {"a": "pass", "b": "fail", "": "needs_human", "c": "needs_human"}
    want = {r.k: verdicts[(r.heard or "")[:1]] if r.judge_asked and r.assertion else None for r in found.collect()}
    for _ in range(2):  # the second run asks nothing
        assert {r.k: r.judged for r in memo.judged(found, judge).collect()} == want
        asked = sorted(p.read_text() for p in log.iterdir())
        assert asked == sorted({f"{r.assertion}|{r.heard or ''}" for r in found.collect() if r.judge_asked and r.assertion})
    more = found.withColumn("heard", F.when(F.col("k") == 1, "bread").otherwise(F.col("heard")))
    assert judging.JudgeMemo(spark, str(tmp_path / "memo")).judged(more, judge).filter("k = 1").first().judged == "fail"
    assert len(list(log.iterdir())) == len(asked) + 1


def test_digests_tell_pairs_apart(spark):
    df = spark.createDataFrame([("a", "b:c"), ("a:b", "c"), ("ab", "c"), ("a", "bc")], "a string, e string")
    assert df.select(judging.digest(F.col("a"), F.col("e"))).distinct().count() == 4


def test_alignment_with_a_memo_is_the_same(spark, tmp_path):
    rows = [(k, [(str(k), "l", "t" * (k % 3), None)]) for k in range(9)]
    contexts = spark.createDataFrame(rows, f"agreement_id int, clauses array<{P.CLAUSE_TYPE}>")
    rules = [{"rule_id": "j", "severity": "info", "nl_assertion": "even"}, {"rule_id": "p", "severity": "warn", "predicate": {"op": "clause.classified_as", "args": ["l"]}}]
    judge = lambda a, t: "pass" if len(t) % 2 == 0 else "fail"
    ctx = P.Context(clauses=F.col("clauses"))
    plain = lambda df: sorted((r.agreement_id, r.rule_id, r.outcome, r.evaluator_used) for r in df.collect())
    memo = judging.JudgeMemo(spark, str(tmp_path / "memo"))
    assert plain(align.align(contexts, rules, judge, ctx=ctx, memo=memo)) == plain(align.align(contexts, rules, judge, ctx=ctx))
    assert memo.answers().count() == 3
