"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from spindrift.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6) + 0.0
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    want = con.execute(ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert not set(QUERIES) - set(ORACLES) - {"glmm_2x2"}


def test_glmm_has_all_terms(spark):
    assert {r.term for r in QUERIES["glmm_2x2"](spark, DATA).collect()} == {"intercept", "base", "extension", "interaction", "item_sd"}
