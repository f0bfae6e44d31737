"""What plans must not have: rows of a table in one partition, but for totals of a few buckets or a final result."""

from __future__ import annotations

import os

import pytest

from meritgrid.functions import positions
from meritgrid.plans.registry import QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.mark.parametrize(
    "name",
    ["percentile_below", "percentile_midpoint", "service_levels", "sliding_60s_count", "same_query_count", "ks_two_sample", "resolution_stats"],
)
def test_windows_over_everything_see_totals_only(spark, monkeypatch, name):
    monkeypatch.setattr(positions, "BUCKET_ROWS", 20)
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [plan[i + 1] for i, line in enumerate(plan) if "Exchange SinglePartition" in line]
    assert all("Aggregate(keys=[]" in line or "Aggregate(keys=[_bucket" in line for line in below), below
