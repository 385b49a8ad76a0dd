import os

from clausewright.llm import common


def test_scratch_tables_are_freed(spark):
    common.clear(spark)
    scratch = common.Scratch(spark, "test_common")
    for label in ("a", "b", "c"):
        scratch.table(spark.range(3), label)
    folder = scratch.root.removeprefix("file://")
    scratch.drop("a")
    assert sorted(os.listdir(folder)) == ["b", "c"]
    scratch.keep("c")
    assert os.listdir(folder) == ["c"] and scratch.read("c", spark.range(1)).count() == 3
    assert common.clear(spark) == 1 and not os.path.exists(folder)
    assert common.clear(spark) == 0


def test_other_sessions_keep_their_tables(spark):
    common.clear(spark)
    other = spark.newSession()
    kept = common.Scratch(other, "test_common").table(other.range(3), "a")
    common.Scratch(spark, "test_common").table(spark.range(3), "a")
    assert common.clear(spark) == 1 and kept.count() == 3 and common.clear(other) == 1


def test_broadcasts_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    texts = spark.createDataFrame([("x" * 100,), ("y" * 50,)], "t string")
    hinted = lambda: "broadcast" in common.small(texts, "t")._jdf.queryExecution().logical().toString().lower()
    assert hinted()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 149)
    assert not hinted()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 150)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert not hinted()
