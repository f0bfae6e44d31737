from __future__ import annotations

import math

import numpy as np
import pytest

from meritgrid.operators import learning
from meritgrid.operators.learning import _strata

PAIRS = "a long, b long"


def scores(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "uuid long, score double")


@pytest.mark.parametrize("listed", [0, 200_000])
def test_all_pairs_can_be_drawn(spark, monkeypatch, listed):
    monkeypatch.setattr(learning, "LISTED", listed)
    c = scores(spark, [i / 40 for i in range(40)])
    judged = spark.createDataFrame([(i + 1, i) for i in range(39)], PAIRS)
    rows = learning.sampled_pairs(c, judged, 100).collect()
    pairs = {(r["a"], r["b"]) for r in rows}
    assert len(rows) == len(pairs) == 100
    assert all(a < b and b - a > 1 and r["weight"] == round(1 / (1 + (b - a) / 40), 6) for r in rows for a, b in [(r["a"], r["b"])])
    assert sum(b - a > 4 for a, b in pairs) > 50
    assert learning.sampled_pairs(c, judged, 5000).count() == 40 * 39 // 2 - 39


@pytest.mark.parametrize("listed", [0, 200_000])
def test_close_pairs_come_first(spark, monkeypatch, listed):
    monkeypatch.setattr(learning, "LISTED", listed)
    c = scores(spark, [0.0 if i < 30 else 1000.0 for i in range(60)])
    rows = learning.sampled_pairs(c, spark.createDataFrame([], PAIRS), 60).collect()
    assert len(rows) == 60 and sum(r["weight"] == 1.0 for r in rows) >= 55


def test_strata_hold_every_pair_once(spark):
    values = sorted([0.0, 0.0, 0.5, 1.0, 1.0, 2.0, 3.0, 6.9, 7.0, 1e3, 1e9, -5.0])
    placed = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "p long, score double")
    got = [(r["p"], q, r["k"]) for r in _strata(placed, len(values), values[-1] - values[0]).collect() for q in range(r["low"], r["high"])]
    want = [(i + 1, j + 1, math.floor(math.log2(1 + values[j] - values[i]))) for i in range(len(values)) for j in range(i + 1, len(values))]
    assert sorted(got) == sorted(want)


def test_law_of_draws_is_that_of_listed_pairs(spark, monkeypatch):
    """Scores from 1 to 10^9: how many pairs of each stratum are drawn, against samples by times of all pairs."""
    monkeypatch.setattr(learning, "LISTED", 1000)
    rng = np.random.default_rng(1)
    values = np.concatenate([[1.0], 10 ** rng.uniform(0, 9, 700), rng.normal(50, 3, 300)])
    n_pairs = 1500
    left, right = np.triu_indices(len(values), 1)
    weight = 1 / (1 + np.abs(values[left] - values[right]))
    stratum = np.floor(np.log2(1 / weight)).astype(int)
    samples = [np.bincount(stratum[np.argpartition(rng.exponential(size=len(weight)) / weight, n_pairs)[:n_pairs]], minlength=32) for _ in range(40)]
    mean, spread = np.mean(samples, axis=0), np.std(samples, axis=0)
    none = spark.createDataFrame([], PAIRS)
    drawn = []
    for seed in (1, 2, 3):
        rows = learning.sampled_pairs(scores(spark, values), none, n_pairs, seed).collect()
        assert len({(r["a"], r["b"]) for r in rows}) == n_pairs
        assert all(r["weight"] == round(1 / (1 + abs(values[r["a"]] - values[r["b"]])), 6) for r in rows)
        gaps = [1 + abs(values[r["a"]] - values[r["b"]]) for r in rows]
        drawn.append(np.bincount(np.floor(np.log2(gaps)).astype(int), minlength=32))
    assert (np.abs(np.mean(drawn, axis=0) - mean) <= 4 * spread / math.sqrt(3) + 2).all()


def test_rows_without_a_score_and_small_tables(spark):
    none = spark.createDataFrame([], PAIRS)
    c = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (None, 2.0)], "uuid long, score double")
    assert learning.sampled_pairs(c, none, 5).count() == 0
    assert learning.sampled_pairs(c.limit(0), none, 5).count() == 0
    assert [tuple(r) for r in learning.sampled_pairs(scores(spark, [2, 2]), none, 5).collect()] == [(0, 1, 1.0)]


def test_no_cross_join(spark):
    plan = learning.sampled_pairs(scores(spark, range(50)), spark.createDataFrame([], PAIRS), 5)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
