"""Diffs of rules' documents and every version back from them."""

import json

import pytest
from clausewright.sources import revisions as R
from clausewright.sources.store import Store
from hypothesis import given, settings
from hypothesis import strategies as st

TREES = st.recursive(st.none() | st.booleans() | st.integers(-3, 3) | st.floats(allow_nan=False, allow_infinity=False, width=16) | st.sampled_from(["a", "b", "é", ""]), lambda t: st.lists(t, max_size=4) | st.dictionaries(st.sampled_from(["op", "args", "x"]), t, max_size=3), max_leaves=12)


@settings(max_examples=400, deadline=None)
@given(TREES, TREES)
def test_a_diff_makes_the_one_of_the_other(before, after):
    edits = json.loads(json.dumps(R.diff(before, after)))
    got = R.apply(before, edits)
    assert json.dumps(got, sort_keys=True) == json.dumps(after, sort_keys=True) and (R.diff(after, after) == [])


def test_diffs_name_only_what_changed():
    tree = lambda n, more=(): {"op": "and", "args": [{"op": "field.gte", "args": ["n", n]}, {"op": "clause.absent", "args": ["x"]}, *more]}
    assert R.diff(tree(1), tree(2)) == [{"edit": "set", "path": ["args", 0, "args", 1], "value": 2}]
    assert R.diff(tree(1), tree(1, [5])) == [{"edit": "splice", "path": ["args"], "at": 2, "drop": 0, "put": [5]}]
    assert R.diff({"a": 1, "b": 1}, {"a": True}) == [{"edit": "drop", "path": ["b"]}, {"edit": "set", "path": ["a"], "value": True}]


@pytest.mark.parametrize("one, other", [(False, 0), (True, 1), (1, 1.0), (0.0, -0.0)])
@pytest.mark.parametrize("around", [lambda v: v, lambda v: [True, False, v], lambda v: {"args": [["n", v], 2]}, lambda v: [{"x": v}, {"x": v}]])
def test_numbers_are_not_booleans_at_any_depth(around, one, other):
    for before, after in ((around(one), around(other)), (around(other), around(one))):
        edits = R.diff(before, after)
        assert edits and json.dumps(R.apply(before, edits)) == json.dumps(after)


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"))
    rows = [(f"r{k}", f"title {k}", json.dumps({"op": "field.gte", "args": ["n", k]}, separators=(",", ":")), ["t"], 0.5 if k else None) for k in range(5)]
    made.create_rules(spark.createDataFrame(rows, "rule_id string, title string, predicate string, tags array<string>, similarity_threshold double"))
    return made


def test_every_version_comes_back(spark, store):
    versions = {f"r{k}": [k] for k in range(5)}
    for step in (10, 20, 30):
        edited = [(f"r{k}", f"title {k} of {step}" if k == 1 else f"title {k}", json.dumps({"op": "not", "args": [{"op": "field.gte", "args": ["n", k + step]}]}, separators=(",", ":"))) for k in (1, 3)]
        R.revise(store, spark.createDataFrame([*edited, ("unknown", "x", "y")], "rule_id string, title string, predicate string"), "someone", f"step {step}", f"2024-01-{step:02} 00:00:00")
        for k in (1, 3):
            versions[f"r{k}"].append(k + step)
    R.revise(store, spark.createDataFrame([("r4", "title 4")], "rule_id string, title string"), "someone", "nothing new", "2024-02-01 00:00:00")
    got = {(r.rule_id, r.version): json.loads(r.document) for r in R.history(store).collect()}
    assert sorted(got) == sorted((rule, k + 1) for rule, v in versions.items() for k in range(len(v)))
    # The versions as they were stored are those that the diffs give back.
    kept = {(r.rule_id, r.version): json.loads(r.document) for r in R.documents(store.table("policy_rules")).collect()}
    assert got == kept
    latest = {r.rule_id: (r.version or 1, r.title, r.tags, r.similarity_threshold) for r in store.rules().collect()}
    assert latest["r1"] == (4, "title 1 of 30", ["t"], 0.5) and latest["r4"] == (1, "title 4", ["t"], 0.5) and len(latest) == 5
    log = store.table("rule_revisions").collect()
    assert len(log) == 6 and len({r.revision_id for r in log}) == 6 and all("clause" not in r.diff for r in log)


def test_a_store_without_revisions(spark, tmp_path):
    empty = Store(spark, str(tmp_path / "store"))
    assert R.history(empty).collect() == []
    R.revise(empty, spark.createDataFrame([("r", "t")], "rule_id string, title string"), "a", "n", "2024-01-01 00:00:00")
    assert empty.table("rule_revisions").count() == 0
