"""Cohorts reach every co-author, however many there are: F2 of round 4."""

from __future__ import annotations

import random

import pytest

from meritgrid.functions import joins
from meritgrid.operators import identity
from meritgrid.plans.registry import ORACLE_SQL


def _reached(seeds: list[int], rows: set[tuple], hops: int) -> set[tuple]:
    """Hop by hop over all pairs of authors of a work."""
    links = {(u, w) for u, w in rows if u is not None and w is not None}
    found = {u: (0, u) for u in seeds}
    for hop in range(1, hops + 1):
        last = {u: seed for u, (h, seed) in found.items() if h == hop - 1}
        new: dict[int, int] = {}
        for a, w in links:
            for b, v in links:
                if a in last and v == w and b not in found:
                    new[b] = min(last[a], new.get(b, last[a]))
        found |= {b: (hop, seed) for b, seed in new.items()}
    return {(u, hop, seed) for u, (hop, seed) in found.items()}


def test_a_work_of_many_authors_brings_all_of_them(spark):
    """Over fifty co-authors, and the last of them leads on to another work."""
    rows = {(u, 1) for u in range(120)} | {(119, 2), (500, 2), (501, 3), (None, 1), (0, None), (502, None)}
    authorship = spark.createDataFrame(sorted(rows, key=str), "uuid long, work long")
    seeds = spark.createDataFrame([(0,), (7,)], "uuid long")
    got = {tuple(r) for r in identity.cohort(seeds, authorship, 2).collect()}
    assert got == {(0, 0, 0), (7, 0, 7), *((u, 1, 0) for u in range(120) if u not in (0, 7)), (500, 2, 0)}


@pytest.mark.parametrize("hops", [1, 3])
def test_the_smallest_seed_of_the_first_hop(spark, monkeypatch, hops):
    monkeypatch.setattr(joins, "PLACE_ROWS", 50)
    rng = random.Random(hops)
    rows = {(rng.randrange(150), rng.randrange(130)) for _ in range(260)}
    seeds = [3, 50, 90]
    authorship = spark.createDataFrame(sorted(rows) * 2, "uuid long, work long")
    got = sorted(map(tuple, identity.cohort(spark.createDataFrame([(s,) for s in seeds], "uuid long"), authorship, hops).collect()))
    assert got == sorted(_reached(seeds, rows, hops))


def test_the_sql_has_no_cap():
    assert "QUALIFY" not in ORACLE_SQL["coauthor_two_hop"]
