"""Every query that SQL can express gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import pytest

from meritgrid.plans.registry import ORACLE_SQL, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*names).collect()), key=str)
    cursor = duck.execute(ORACLE_SQL[name])
    there = [c[0] for c in cursor.description]
    assert sorted(there) == names
    want = sorted(([plain(r[there.index(c)]) for c in names] for r in cursor.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 50
