"""Every query of the engine against its SQL, on the smallest tables."""

import decimal
import math
import sys

import duckdb
import pytest
from clausewright.plans import queries as plans

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else float(v)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    found = duck.execute(plans.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(str([plain(v) for v in row]) for row in found.fetchall())
    assert sorted(str([plain(r[c]) for c in columns]) for r in got.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("missing", ["clausewright.llm", "corpus_pipeline", "zstandard"])
def test_the_engine_works_without_what_is_optional(monkeypatch, missing):
    for name in [m for m in sys.modules if m == missing or m.startswith(("clausewright.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    with pytest.warns(UserWarning):
        made, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(plans.QUERIES) <= set(made) and set(plans.SQL) <= set(sql) and "pipeline" not in made
