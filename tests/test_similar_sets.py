"""Similar sets by lists that meet in blocks: F1 of round 4. What is shuffled are lists, not pairs."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from meritgrid.functions import joins
from meritgrid.operators import identity


def _plain(rows: set[tuple], least: float) -> dict[tuple, float]:
    sets: dict[int, set] = {}
    for u, w in rows:
        if u is not None:
            sets.setdefault(u, set()).add(w)
    shared = {(a, b): len((sets[a] & sets[b]) - {None}) for a, b in combinations(sorted(sets), 2)}
    found = {(a, b): k / (len(sets[a]) + len(sets[b]) - k) for (a, b), k in shared.items() if k}
    return {p: j for p, j in found.items() if j >= least - 1e-6}


def _found(spark, rows: set[tuple], least: float) -> dict[tuple, float]:
    df = spark.createDataFrame(sorted(rows, key=str) * 2, "uuid long, work long")
    return {(r["a"], r["b"]): r["jaccard"] for r in identity.similar_sets(df, least).collect()}


def _rows(seed: int, n: int, works: int) -> set[tuple]:
    """Sets of one to forty works; most hold the works 0 and 1."""
    rng = random.Random(seed)
    rows = {(u, int(works * rng.random() ** 2)) for u in range(n) for _ in range(rng.choice([1, 2, 8, 25, 40]))}
    return rows | {(u, 0) for u in range(n) if rng.random() < 0.8} | {(u, 1) for u in range(n) if rng.random() < 0.5}


@pytest.mark.parametrize("places, tile, keys, least", [(40, 1024, 100_000, 0.3), (200, 5, 100_000, 0.05), (1 << 19, 20, 50, 0.6)])
def test_the_pairs_of_a_plain_comparison(spark, monkeypatch, places, tile, keys, least):
    """Blocks that are cut, works in tiles, works that sets leave out, and all at once."""
    monkeypatch.setattr(joins, "PLACE_ROWS", places)
    monkeypatch.setattr(joins, "TILE", tile)
    monkeypatch.setattr(joins, "BROADCAST_KEYS", keys)
    rows = _rows(places, 90, 60) | {(3, None), (4, None), (None, 2)}
    assert _found(spark, rows, least) == _plain(rows, least)


@pytest.mark.parametrize("tile", [5, 1024])
def test_sizes_beyond_what_a_number_holds(spark, monkeypatch, tile):
    monkeypatch.setattr(joins, "TILE", tile)
    monkeypatch.setattr(identity, "SIZE_BITS", 3)
    monkeypatch.setattr(identity, "LEFT_OUT", 8)
    monkeypatch.setattr(identity, "LARGE", 7)
    rows = _rows(1, 70, 50)
    assert _found(spark, rows, 0.4) == _plain(rows, 0.4)


def test_no_sets(spark):
    assert _found(spark, set(), 0.5) == {} == _found(spark, {(1, 1), (2, None), (3, None)}, 0.5)


def test_pairs_are_not_shuffled(spark):
    """A thousand works of forty members each: 780,000 meetings, which were a row of a shuffle each."""
    def shuffled() -> int:
        none = spark._jvm.java.util.ArrayList()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    rng = random.Random(2)
    rows = {(u, w) for w in range(1000) for u in rng.sample(range(400), 40)}
    before = shuffled()
    _found(spark, rows, 0.2)
    made = shuffled() - before
    assert 0 < made < 300_000, made
