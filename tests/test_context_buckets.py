"""Agreements share their states: a Python call and a state for a bucket, contexts as if each had its own."""

import datetime
import random
import time

import pytest
from clausewright.streaming import contexts as S


def started(spark, folder, batches, ddl, **how):
    """What went out, and the last progress, of one start for each batch; all starts share a checkpoint."""
    (folder / "in").mkdir()
    query = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/in/{k}")
        source = spark.readStream.schema(ddl).parquet(f"{folder}/in/*")
        query = S.context_stream(source, ["x", "y"], **how).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        assert query.exception() is None
    return spark.read.parquet(f"{folder}/out"), query.lastProgress


def test_many_agreements_take_few_states(spark, tmp_path):
    rng = random.Random(5)
    rows = [(a, rng.choice("xy"), str(rng.randint(0, 9)), rng.randint(0, 5)) for a in range(2000) for _ in range(6)]
    rows += [(-1, "x", str(v), v) for v in range(12000)] + [(-1, "y", "b", 0)]  # a large agreement, over more than one batch of Arrow's
    rng.shuffle(rows)
    third = len(rows) // 3
    batches = [rows[:third], rows[third : 2 * third], rows[2 * third :]]
    out, progress = started(spark, tmp_path, batches, "agreement_id long, name string, value string, ordinal long", buckets=7)
    assert sum(o.numRowsTotal for o in progress.stateOperators) <= 7
    assert S.BUCKETS <= 1 << 16

    held = {}
    for a, n, v, o in rows:
        own = held.setdefault(a, {})
        own[n] = max(own.get(n, (-1, "")), (o, v))
    last = {a: {n: v for n, (_, v) in f.items()} for a, f in held.items() if len(f) == 2}
    assert {r.agreement_id: r.fields for r in S.latest(out).collect()} == last and len(last) > 1500
    got = out.orderBy("agreement_id", "revision").collect()
    assert max(r.revision for r in got) == 3
    each = {}
    for r in got:
        each.setdefault(r.agreement_id, []).append(r.revision)
    assert all(v == list(range(1, len(v) + 1)) for v in each.values())


@pytest.mark.parametrize(
    "kind, ids",
    [
        ("string", ["", "1", "01", "ä\"'\\\n"]),
        ("binary", [b"\xff\x00", b"\xff", b""]),
        ("date", [datetime.date(1, 1, 1), datetime.date(2024, 2, 29)]),
        ("timestamp", [datetime.datetime(2024, 1, 1, 0, 0, 0, 1), datetime.datetime(2024, 1, 1)]),
        ("decimal(20,2)", None),
        ("double", [0.1, 1e300, 0.0]),
    ],
)
def test_ids_of_any_type_come_back(spark, tmp_path, kind, ids):
    from decimal import Decimal

    ids = ids or [Decimal("1.10"), Decimal("-123456789012345678.99")]
    rows = [(i, n, f"{k}{n}", k) for k, i in enumerate(ids) for n in "xy"]
    rows += [(-0.0, "x", "later", 9)] if kind == "double" else []
    out, _ = started(spark, tmp_path, [rows], f"agreement_id {kind}, name string, value string, ordinal long", buckets=1)
    assert out.schema["agreement_id"].dataType.simpleString() == kind
    want = {i: {n: f"{k}{n}" for n in "xy"} for k, i in enumerate(ids)}
    if kind == "double":
        want[0.0]["x"] = "later"
    assert {bytes(r[0]) if kind == "binary" else r[0]: r.fields for r in out.collect()} == want


def test_a_bucket_outlives_its_agreements():
    kept = {}
    assert S.take_in(kept, iter([iter([("1", "x", "a", 1), ("1", "y", "b", 1), ("2", "x", "a", 1)])]), ["x", "y"], 100) == ["1"]
    assert S.take_in(kept, iter([iter([("2", "x", "a", 1)]), iter([("2", "y", "c", 1)])]), ["x", "y"], 150) == ["2"]
    assert {a: (revision, until) for a, (revision, _, until) in kept.items()} == {"1": (1, 100), "2": (1, 150)}


@pytest.mark.parametrize("busy", [True, False])
def test_what_is_forgotten_begins_anew(spark, tmp_path, busy):
    ddl = "agreement_id long, name string, value string, ordinal long"
    arrive = lambda k, rows: spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    arrive(0, [(1, "x", "a", 9), (1, "y", "b", 9)])
    emitted = S.context_stream(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in/*"), ["x", "y"], forget="2 seconds", buckets=1)
    query = emitted.writeStream.format("memory").queryName(f"forgetful_{busy}").outputMode("append").start()
    try:

        def sent(agreement, n):
            end = time.time() + 60
            while time.time() < end and query.exception() is None:
                got = [(r.revision, r.fields["x"], r.fields["y"]) for r in spark.table(f"forgetful_{busy}").filter(f"agreement_id = {agreement}").collect()]
                if len(got) >= n:
                    return got
                time.sleep(0.2)
            raise AssertionError(query.exception())

        assert sent(1, 1) == [(1, "a", "b")]
        for k in range(1, 5):  # another one of the bucket goes on, or the bucket is forgotten as well
            time.sleep(1)
            if busy:
                arrive(k, [(2, "x", str(k), k), (2, "y", "b", 1)])
        sent(2, int(busy))
        arrive(5, [(1, "x", "c", 1), (1, "y", "d", 1)])  # of lower ordinals than what is forgotten
        assert sent(1, 2) == [(1, "a", "b"), (1, "c", "d")]
    finally:
        query.stop()
