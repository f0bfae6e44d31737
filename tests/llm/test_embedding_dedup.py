from __future__ import annotations

import numpy as np
import pytest

from meritgrid.llm import embedding_dedup as e

SCHEMA = "vec_id long, embedding array<double>, label int, rep long, n int, cells string"


def make(rng, n, size=16):
    rows, base = [], rng.standard_normal((20, size))
    for i in range(n):
        v = base[rng.integers(20)] + rng.standard_normal(size) * rng.choice([0.0, 0.1, 0.3])
        rows.append((i, (v * rng.choice([1.0, 3.0])).tolist(), int(rng.integers(3)), 1, 2, "x"))
    return rows


def brute_force(rows):
    ids = [r[0] for r in rows]
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= e.THRESHOLD) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    component = list(range(len(rows)))
    for _ in rows:
        component = [min([component[i], *(component[j] for j in np.flatnonzero(near[i]))]) for i in range(len(rows))]
    return {ids[i]: (int(near[i].sum()), ids[component[i]]) for i in range(len(rows))}


def test_against_brute_force(spark):
    rows = make(np.random.default_rng(1), 300)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute_force(rows)
    found, there = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert there > 300 and found >= 0.99 * there and all(got[i][0] <= want[i][0] for i in got)


@pytest.mark.parametrize(("tile", "small"), [(16, 4), (16, 64), (500, 4), (500, 200)])
def test_tiles(spark, monkeypatch, tile, small):
    """One cell of many distinct vectors, cut into tiles."""
    monkeypatch.setattr(e, "TILE", tile)
    monkeypatch.setattr(e, "SMALL", small)
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = [(i, (base + rng.standard_normal(16) * 0.05).tolist(), 1, 0, 0, "") for i in range(120)]
    got = e.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component_id"] for r in got} == {0} and {r["vec_id"]: r["n_links"] for r in got} == {i: n for i, (n, _) in brute_force(rows).items()}


def test_awkward_rows(spark):
    good = [1.0] * 16
    rows = [
        (1, None, 1),
        (2, [], 1),
        (3, [0.0] * 16, 1),
        (4, [float("nan")] + good[1:], 1),
        (5, [None] + good[1:], 1),
        (6, [float("inf")] + good[1:], 1),
        (7, good, None),
        (8, good, 1),
        (9, good, 1),
        (9, good, 1),
        (10, good, 2),
        (11, [2.0] * 16, 1),
        (12, good[:8], 1),
    ]
    got = e.near_duplicates(spark.createDataFrame([(*r, 0, 0, "") for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert all(by[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 10, 12))
    assert by[8] == (3, 8, True) and by[9] == (3, 8, False) and by[11] == (3, 8, False)
    assert e.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_labels_and_components_do_not_run_together(spark):
    rows = [(1, [1.0, 2.0], "x"), (2, [2.0], "x|1.0"), (3, [1.0, 2.0], "x"), (4, [2.0], "x|1.0|2"), (5, [1.0, 2.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (0, 4), 5: (0, 5)}
