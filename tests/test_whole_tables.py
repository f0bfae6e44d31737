"""Queries that once read a part of their tables: the same rows as SQL on tables with ids beyond any prefix."""

from __future__ import annotations

import os

import pytest

from meritgrid.plans.registry import ORACLE_SQL, QUERIES
from tests.test_oracles import plain

WIDE = os.environ.get("TEST_WIDE_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(WIDE), reason="no test tables here")

NAMES = ["coauthor_two_hop", "except_keys", "insert_missing", "jaccard_pairs", "judged_cross_pairs", "recall_set", "triangular_unjudged"]


@pytest.mark.parametrize("name", NAMES)
def test_whole_tables(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(WIDE):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{WIDE}/{f}'")
    df = QUERIES[name](spark, WIDE)
    cursor = con.execute(ORACLE_SQL[name])
    there = [c[0] for c in cursor.description]
    want = sorted(([plain(r[there.index(c)]) for c in sorted(there)] for r in cursor.fetchall()), key=str)
    got = sorted(([plain(v) for v in r] for r in df.select(*sorted(there)).collect()), key=str)
    assert got and got == want
