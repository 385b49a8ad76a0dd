"""Contexts from a stream end as the batch builds them, whatever the order of arrival."""

import random

import pytest
from clausewright.operators import context
from clausewright.operators.align import align
from clausewright.streaming import contexts as S

DDL = "agreement_id long, name string, value string, ordinal long"


def arrivals(seed):
    rng = random.Random(seed)
    rows = [(a, rng.choice(["x", "y", "other"]), str(rng.randint(0, 50)), o) for a in range(25) for o in range(rng.randint(1, 7))]
    rows += [(a, n, "7", 100 + a) for a in range(0, 25, 3) for n in "xy"] + [(1, "x", None, 999), (None, "x", "1", 1), (2, None, "1", 1)]
    rng.shuffle(rows)
    return rows


def streamed(spark, folder, batches):
    (folder / "in").mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{folder}/in/{k}")
    out = None
    for k in range(len(batches)):  # each start goes on from the checkpoint with the next files
        source = spark.readStream.schema(DDL).parquet(f"{folder}/in/{'{' + ','.join(map(str, range(k + 1))) + '}'}")
        query = S.context_stream(source, ["x", "y"]).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        out = spark.read.parquet(f"{folder}/out")
    return out


def batch(spark, rows):
    """(agreement_id, fields) as ``context.build`` has them, where all fields are there."""
    held = {}
    for a, n, v, o in rows:
        if None not in (a, n, v) and n in "xy":
            held.setdefault(a, {})[n] = max(held.get(a, {}).get(n, (-1, "")), (o, v))
    return {a: {n: v for n, (_, v) in f.items()} for a, f in held.items() if len(f) == 2}


@pytest.mark.parametrize("seed", [1, 2])
def test_the_last_context_is_the_batch_one(spark, tmp_path, seed):
    rows = arrivals(seed)
    third = len(rows) // 3
    out = streamed(spark, tmp_path, [rows[:third], rows[third : 2 * third], rows[2 * third :]])
    got = {r.agreement_id: r.fields for r in S.latest(out).collect()}
    assert got == batch(spark, rows) and len(got) > 10
    built = context.build(spark.createDataFrame([r for r in rows if r[1] in ("x", "y")], DDL), spark.createDataFrame([], "agreement_id long, id string, label string, text string, ordinal long, embedding array<float>"))
    told = {r.agreement_id: {k: v.s for k, v in r.fields.items()} for r in built.filter("fields is not null").collect()}
    assert all(told[a] == f for a, f in got.items())
    # Once complete, then once for each batch that changes something.
    each = out.orderBy("agreement_id", "revision").collect()
    seen = {}
    for r in each:
        assert r.revision == len(seen.setdefault(r.agreement_id, [])) + 1 and set(r.fields) == {"x", "y"} and r.fields not in seen[r.agreement_id][-1:]
        seen[r.agreement_id].append(r.fields)
    assert max(map(len, seen.values())) > 1


def test_emitted_contexts_can_be_aligned(spark):
    emitted = spark.createDataFrame([(1, 1, {"x": "5", "y": "a"}), (1, 2, {"x": "50", "y": "a"}), (2, 1, {"x": "1", "y": "b"})], "agreement_id long, revision int, fields map<string,string>")
    rules = [{"rule_id": "r", "severity": "warn", "predicate": {"op": "field.gte", "args": ["x", 10]}}]
    got = align(S.contexts(S.latest(emitted)), rules)
    assert {r.agreement_id: r.outcome for r in got.collect()} == {1: "pass", 2: "fail"}


def test_winners_don_t_depend_on_the_order():
    rows = [("x", "b", 1), ("x", "a", 1), ("x", "c", 0), ("x", "z", None), ("y", None, 9)]
    ends = []
    for _ in range(20):
        random.shuffle(rows)
        held = {}
        S.latest_values(held, iter(rows))
        ends.append(held)
    assert all(h == {"x": [1, "b"]} for h in ends)
