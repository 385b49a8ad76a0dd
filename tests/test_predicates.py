import fnmatch
import math
import random
import re

import pytest
from clausewright.functions import predicates as P
from pyspark.sql import functions as F

DDL = f"agreement_id long, fields map<string,{P.FIELD_TYPE}>, clauses array<{P.CLAUSE_TYPE}>, domain struct<id:string,name:string>, doc struct<value:double,party_role:string>"


def typed(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("bool", str(v), float(v), v)
    if isinstance(v, float):
        return ("number", str(v), v, None)
    return ("string", v, None, None)


def frame(spark, contexts):
    rows = [(k, {n: typed(v) for n, v in c["fields"].items()}, [(str(i), lab, t, [1.0, float(i)]) for i, (lab, t) in enumerate(c["clauses"])], ("d", c["domain"]), (c["value"], c["role"])) for k, c in enumerate(contexts)]
    return spark.createDataFrame(rows, DDL)


class Wrong(Exception):
    pass


def interpret(node, c):
    """What a tree means, in plain Python."""
    if not isinstance(node, dict) or "op" not in node:
        return bool(node)
    op, a = node["op"], node["args"]
    value = c["fields"].get(a[0]) if op.startswith("field.") else None

    def number(x):
        try:
            return float(x)
        except (TypeError, ValueError):
            return math.nan

    if op == "field.exists":
        return value is not None
    if op == "field.eq":
        return value == a[1]
    if op == "field.in":
        if isinstance(a[1], str) and not isinstance(value, str):
            raise Wrong
        return value in a[1]
    if op == "field.gte":
        return number(value) >= number(a[1])
    if op == "field.lte":
        return number(value) <= number(a[1])
    if op == "field.between":
        return number(a[1]) <= number(value) <= number(a[2])
    if op == "field.matches":
        if value is None:
            return False
        if a[1] not in ("regex", "glob"):
            raise Wrong
        return bool(re.search(a[2], str(value)) if a[1] == "regex" else re.match(fnmatch.translate(a[2]), str(value)))
    if op == "field.value":
        return bool(value)
    if op == "clause.classified_as":
        return any(lab == a[0] for lab, _ in c["clauses"])
    if op == "clause.absent":
        return all(lab != a[0] for lab, _ in c["clauses"])
    if op == "clause.contains":
        return any(a[0].lower() in (t or "").lower() for _, t in c["clauses"])
    if op in ("and", "all_of"):
        return all(interpret(x, c) for x in a)
    if op in ("or", "any_of"):
        return any(interpret(x, c) for x in a)
    if op == "not":
        return not interpret(a[0], c)
    if op == "if_then":
        return not interpret(a[0], c) or interpret(a[1], c)
    if op == "count":
        hits = sum(interpret(a[0], {**c, "clauses": [x]}) for x in c["clauses"])
        if a[1] not in (">=", ">", "<=", "<", "=="):
            raise Wrong
        return {">=": hits >= a[2], ">": hits > a[2], "<=": hits <= a[2], "<": hits < a[2], "==": hits == a[2]}[a[1]]
    if op == "domain.is":
        return c["domain"] == a[0]
    if op == "doc.party_role.is":
        return c["role"] == a[0]
    if op == "doc.value.gte":
        return number(c["value"]) >= number(a[0])
    raise Wrong


VALUES = [None, "", "30", "30.0", "1e1", " 7 ", "1,000", "abc", "12d", "0x10", "true", "nan", "inf", 0.0, 30.0, math.nan, -2.5, True, False]
NAMES = ["a", "b", "c"]
LABELS = ["x", "y", None]
TEXTS = ["The Cap", "the end", "", None]


def contexts(rng, n):
    return [
        {"fields": {k: rng.choice(VALUES) for k in NAMES if rng.random() < 0.9}, "clauses": [(rng.choice(LABELS), rng.choice(TEXTS)) for _ in range(rng.randint(0, 3))], "domain": rng.choice(["m", "n", None]), "role": rng.choice(["p", None]), "value": rng.choice([None, 5.0, math.nan, 90.0])}
        for _ in range(n)
    ]


def tree(rng, depth):
    if depth and rng.random() < 0.6:
        op = rng.choice(["and", "or", "not", "if_then", "any_of", "all_of", "count"])
        if op == "count":
            return {"op": op, "args": [tree(rng, depth - 1), rng.choice([">=", ">", "<=", "<", "==", "~"]), rng.randint(0, 2)]}
        n = {"not": 1, "if_then": 2}.get(op, rng.randint(0, 3))
        return {"op": op, "args": [tree(rng, depth - 1) for _ in range(n)]}
    name, literal = rng.choice(NAMES), rng.choice([*VALUES[:5], 30, 30.0, True, 0, "x"])
    return rng.choice(
        [
            {"op": "field.exists", "args": [name]}, {"op": "field.eq", "args": [name, literal]}, {"op": "field.in", "args": [name, [literal, "abc", 0]]}, {"op": "field.in", "args": [name, "abc 30"]},
            {"op": "field.gte", "args": [name, rng.choice([7, "7", "x", None])]}, {"op": "field.lte", "args": [name, 30]}, {"op": "field.between", "args": [name, "0", 30]},
            {"op": "field.matches", "args": [name, "regex", r"^\d+$"]}, {"op": "field.matches", "args": [name, "glob", "*[!a]*"]}, {"op": "field.matches", "args": [name, "soundex", "x"]},
            {"op": "field.value", "args": [name]}, {"op": "clause.classified_as", "args": ["x"]}, {"op": "clause.absent", "args": ["y"]}, {"op": "clause.contains", "args": ["THE"]},
            {"op": "domain.is", "args": ["m"]}, {"op": "doc.party_role.is", "args": ["p"]}, {"op": "doc.value.gte", "args": ["10"]}, {"op": "no.such", "args": []}, rng.choice([True, 0, "text", None]),
        ]
    )


@pytest.mark.parametrize("seed", range(3))
def test_compiled_trees_mean_what_the_interpreter_says(spark, seed):
    rng = random.Random(seed)
    cs, trees = contexts(rng, 60), [tree(rng, 2) for _ in range(60)]
    got = frame(spark, cs).select("agreement_id", *(P.compile_predicate(t, P.Context.standard()).verdict().alias(f"t{k}") for k, t in enumerate(trees))).collect()
    for row in got:
        for k, t in enumerate(trees):
            try:
                want = interpret(t, cs[row.agreement_id])
            except Wrong:
                want = None
            assert row[f"t{k}"] == want, (t, cs[row.agreement_id])


def test_order_decides_whether_a_fault_matters(spark):
    one = frame(spark, contexts(random.Random(1), 1))
    bad, yes = {"op": "no.such", "args": []}, {"op": "all_of", "args": []}
    verdict = lambda *args, op="or": one.select(P.compile_predicate({"op": op, "args": list(args)}, P.Context.standard()).verdict()).first()[0]
    assert verdict(yes, bad) is True and verdict(bad, yes) is None
    assert verdict({"op": "not", "args": [yes]}, bad, op="and") is False


def test_similarity_operators(spark):
    one = frame(spark, [{"fields": {"a": "up"}, "clauses": [("x", "t"), ("x", "")], "domain": None, "role": None, "value": None}])
    ctx = P.Context.standard(embed_literal=lambda t: [1.0, 0.0] if t == "right" else [0.0, 1.0], embed_column=lambda c: F.array(F.lit(0.0), F.when(c == "up", 1.0).otherwise(0.0)))
    holds = lambda op, *args: one.select(P.compile_predicate({"op": op, "args": list(args)}, ctx).verdict()).first()[0]
    assert holds("field.semantic_match", "a", "up", 0.9) and not holds("field.semantic_match", "a", "right", 0.9)
    assert holds("clause.similar_to", "right", 0.9) and not holds("clause.similar_to", "up", 0.9)  # a clause without text has no say


def test_registry_and_descriptions():
    assert len(P.known()) == 23
    assert P.describe({"op": "not", "args": [{"op": "field.between", "args": ["cap", 1, 2]}]}) == "not (cap between 1 and 2)"
    assert P.fields_of({"op": "and", "args": [{"op": "field.eq", "args": ["a", 1]}, {"op": "not", "args": [{"op": "field.exists", "args": ["b"]}]}]}) == {"a", "b"}
