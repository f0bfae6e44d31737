from __future__ import annotations

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from meritgrid.functions import joins, positions
from meritgrid.operators import cohort_log, identity, monitoring, sketches
from meritgrid.operators.index_store import StoredIndex, bucket

DAY = dt.date(2024, 1, 1)


@pytest.mark.parametrize(("tile", "keys"), [(7, 100_000), (7, 0), (1000, 100_000)])
def test_pairs_of_a_hot_key(spark, monkeypatch, tile, keys):
    monkeypatch.setattr(joins, "BROADCAST_KEYS", keys)
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(30)}", i, i * i % 11) for i in range(240)] + [(None, 1, 0), ("k1", None, 0)]
    df = spark.createDataFrame(rows, "k string, id long, v long")
    got = sorted(tuple(r) for r in joins.pairs_by_key(df, "k", "id", tile).collect())
    known = [(k, i, v) for k, i, v in rows if k is not None and i is not None]
    want = sorted((k, a, b, va, vb) for k, a, va in known for m, b, vb in known if k == m and a < b)
    assert got == want
    some = joins.pairs_by_key(df, "k", "id", tile, where=F.col("v_a") == F.col("v_b"))
    assert some.count() == sum(va == vb for *_, va, vb in want)


def test_no_place_gets_more_than_two_tiles(spark):
    n, tile = 3000, 100
    df = spark.createDataFrame([("hot", i) for i in range(n)] + [(f"k{i}", i) for i in range(2 * n)], "k string, id long")
    counts = df.groupBy("k").count()
    assert counts.agg(F.max("count")).first()[0] == n
    pairs = joins.pairs_by_key(df, "k", "id", tile)
    # the join's groups: at most two tiles a place, so the largest is a small part of the pairs
    tiles = pairs.groupBy(F.pmod(F.xxhash64("a"), F.lit(n // tile)), F.pmod(F.xxhash64("b"), F.lit(n // tile))).count()
    assert pairs.count() == n * (n - 1) // 2
    assert tiles.agg(F.max("count")).first()[0] <= 2 * (2 * tile) ** 2


def test_days_within_spans(spark):
    rng = random.Random(2)
    date = lambda k: DAY + dt.timedelta(days=k)
    spans = [(rng.choice("ab"), i, date(a := rng.randrange(-9000, 9000)), date(a + rng.choice([0, 1, 6, 100, 5000]))) for i in range(80)]
    spans += [("a", 900, None, date(0)), ("a", 901, date(3), None), ("b", 902, None, None), ("b", 903, date(5), date(4))]
    days = [(rng.choice("abc"), date(rng.randrange(-9000, 9000))) for _ in range(60)] + [("a", date(0)), ("b", date(4)), ("a", date(3))]
    s = spark.createDataFrame(spans, "k string, id long, first_day date, last_day date")
    d = spark.createDataFrame(sorted(set(days)), "k string, day date")
    got = sorted((r["k"], r["day"], r["id"]) for r in joins.days_in_spans(d, s, ["k"]).collect())
    want = sorted((k, x, i) for k, x in set(days) for m, i, a, b in spans if k == m and (a is None or a <= x) and (b is None or x <= b))
    assert got == want
    most = s.where("first_day <= last_day").select(F.max(F.size(joins.blocks_of_span(F.col("first_day"), F.col("last_day"))))).first()[0]
    assert most <= 2 * joins.DAY_BITS


LOG = "cohort string, uuid long, action string, ts timestamp, entry_id long, reason string"


def entries() -> list[tuple]:
    rng = random.Random(3)
    out = []
    for i in range(200):
        out.append((rng.choice("xy"), rng.randrange(12), rng.choice(["add", "add", "remove", "note"]), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 60)), i, rng.choice(["r", "q", None])))
    return [*out, ("x", 1, None, None, 999, None)]


def test_memberships_replay_the_log(spark):
    log = spark.createDataFrame(entries(), LOG)
    spans = cohort_log.memberships(log)
    days = [DAY + dt.timedelta(days=k) for k in range(-1, 62, 3)]
    asked = spark.createDataFrame([(c, d) for c in "xy" for d in days], "cohort string, day date")
    got = {(r["cohort"], r["day"], r["uuid"]) for r in cohort_log.members_on(spans, asked).collect()}
    want = set()
    for c in "xy":
        for d in days:
            inside: dict[int, bool] = {}
            for e in sorted((e for e in entries() if e[0] == c and e[3] and e[3].date() <= d and e[2] in ("add", "remove")), key=lambda e: (e[3], e[4])):
                inside[e[1]] = e[2] == "add"
            want |= {(c, d, u) for u, yes in inside.items() if yes}
    assert got == want
    assert cohort_log.memberships(log.limit(0)).count() == 0


def test_log_filters_and_summary(spark):
    log = spark.createDataFrame(entries(), LOG)
    got = cohort_log.log_of(log, cohort="x", reason="r", since=F.lit("2024-01-20").cast("timestamp")).collect()
    want = sorted((e for e in entries() if e[0] == "x" and e[5] == "r" and e[3] and e[3] >= dt.datetime(2024, 1, 20)), key=lambda e: (e[3], e[4]))
    assert [r["entry_id"] for r in got] == [e[4] for e in want]
    rows = {(r["cohort"], r["day"]): r for r in cohort_log.daily_summary(log).collect()}
    some = rows["x", want[0][3].date()]
    day = [e for e in entries() if e[0] == "x" and e[3] and e[3].date() == want[0][3].date()]
    assert (some["added"], some["removed"]) == (sum(e[2] == "add" for e in day), sum(e[2] == "remove" for e in day))
    assert some["reasons"] == {k: sum(e[5] == k for e in day) for k in {e[5] for e in day if e[5]}}


REQUESTS = "id long, ts timestamp, source string, latency double, success boolean"


def requests(seed: int, first: int, last: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(seed * 100_000 + i, dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(first, last), seconds=i % 86_000), rng.choice(["a", "b", None]), rng.lognormvariate(3, 1), rng.random() > 0.01) for i in range(n)]


def test_sketches_of_days_are_close_to_the_exact_levels(spark):
    old, new = requests(1, 0, 35, 12_000), requests(2, 35, 40, 3000)
    kept = sketches.with_days(sketches.daily_sketches(spark.createDataFrame(old, REQUESTS), "source"), sketches.daily_sketches(spark.createDataFrame(new, REQUESTS), "source"))
    kept = sketches.with_days(kept, sketches.daily_sketches(spark.createDataFrame(new, REQUESTS), "source"))  # a day that comes again
    day = DAY + dt.timedelta(days=39)
    asked = spark.createDataFrame([(day,)], "day date")
    got = {r["source"]: r for r in sketches.rolling(kept, asked, "source").collect()}
    inside = [r for r in old + new if r[1].date() > day - dt.timedelta(days=30)]
    exact = {r["source"]: r for r in monitoring.service_levels(spark.createDataFrame(inside, REQUESTS), "source").collect()}
    assert set(got) == set(exact) == {"a", "b", None}
    for k, e in exact.items():
        own = sorted(r[3] for r in inside if r[2] == k)
        assert (got[k]["requests"], got[k]["success_rate"], got[k]["budget_used_pct"]) == (e["requests"], e["success_rate"], e["budget_used_pct"])
        for p in (95, 99):
            rank = sum(v <= got[k][f"p{p}"] for v in own) / len(own)
            assert abs(rank - p / 100) < 0.015


def test_rolling_levels_copy_few_requests(spark, monkeypatch):
    """Exact levels of windows of days, of null keys and latencies too, out of many buckets."""
    monkeypatch.setattr(positions, "BUCKET_ROWS", 50)
    rows = [(*r[:3], None if r[0] % 97 == 0 else round(r[3]), r[4]) for r in requests(3, 0, 9, 3000)]
    made = spark.createDataFrame([(r[0], r[1].date(), r[2], None if r[3] is None else float(r[3]), r[4]) for r in rows], "id long, day date, source string, latency double, success boolean")
    got = {(r["as_of"], r["source"]): r for r in monitoring.rolling_levels(made, "source", 3).collect()}
    for (day, source), r in got.items():
        inside = [x for x in rows if day - dt.timedelta(days=3) < x[1].date() <= day and x[2] == source]
        values, n = sorted((x[3] is None, x[3] or 0) for x in inside), len(inside)
        want = [None if values[i][0] else values[i][1] for i in (math.floor((n - 1) * 0.95), math.floor((n - 1) * 0.99))]
        fails = sum(not x[4] for x in inside)
        assert (r["requests"], r["p95"], r["p99"], r["success_rate"]) == (n, *want, round(1 - fails / n, 6))
    assert len(got) == 27


def test_sketches_without_values(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "a", None, True)], REQUESTS)
    daily = sketches.daily_sketches(rows, "source")
    got = sketches.rolling(daily, rows.select(F.to_date("ts").alias("day")), "source").first()
    assert (got["requests"], got["p95"]) == (1, None)


def test_index_reads_and_rewrites_single_buckets(spark, tmp_path):
    path = str(tmp_path / "index")
    index = StoredIndex(spark, path, 8)
    entries_ = [(f"t{i % 40}", i) for i in range(400)]
    index.build(spark.createDataFrame([*entries_, (None, 1), ("t1", None)], "term string, uuid long"))
    found = index.lookup(["t3", "t4", "none"])
    assert sorted(tuple(r) for r in found.collect()) == sorted(e for e in entries_ if e[0] in ("t3", "t4"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "In(term" in plan
    assert index.lookup([]).count() == 0
    asked = spark.createDataFrame([(1, "t5"), (2, "none"), (3, "t5")], "q long, term string")
    assert index.join(asked).count() == 20

    def files() -> dict[str, float]:
        return {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}

    before = files()
    old = spark.createDataFrame([("t3", 3), ("t5", 5)], "term string, uuid long")
    new = spark.createDataFrame([("t9", 3), ("t5", 5)], "term string, uuid long")
    index.upsert(old, new)
    want = sorted([e for e in entries_ if e != ("t3", 3)] + [("t9", 3)])
    assert sorted((r["term"], r["uuid"]) for r in index.entries().collect()) == want
    touched = {r[0] for r in spark.createDataFrame([("t3",), ("t9",)], "t string").select(bucket(F.col("t"), 8)).collect()}
    same = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert same and all(files().get(f) == before[f] for f in same)
    index.upsert(index.entries().where("term = 't7'"), old.limit(0))
    assert index.lookup(["t7"]).count() == 0 and index.entries().count() == len(want) - 10
    index.upsert(index.entries(), old.limit(0))
    assert not files()


def test_pairs_are_counted_in_places_that_grow_in_number(spark, monkeypatch):
    """what a task groups is bounded, whatever the number of shuffle partitions."""
    monkeypatch.setattr(joins, "PLACE_ROWS", 200)
    rng = random.Random(5)
    rows = sorted({(rng.randrange(60), rng.randrange(40)) for _ in range(700)})
    df = spark.createDataFrame(rows, "uuid long, work long")
    sets = {u: {w for x, w in rows if x == u} for u in {u for u, _ in rows}}
    similar = identity.similar_sets(df, 0.3)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert {(r["a"], r["b"]): r["jaccard"] for r in similar.collect()} == {k: v for k, v in want.items() if v >= 0.3}
    edges = identity.coauthors(df, 3)
    near = {a: sorted(b for b in sets if a != b and sets[a] & sets[b])[:3] for a in sets}
    assert sorted(map(tuple, edges.collect())) == sorted((a, b) for a, bs in near.items() for b in bs)
    some = identity.coauthors(df, 3, df.where("uuid < 5"))
    assert sorted(map(tuple, some.collect())) == sorted((a, b) for a, bs in near.items() if a < 5 for b in bs)
    for made in (similar, edges):
        plan = made._jdf.queryExecution().executedPlan().toString()
        places = [int(k) for k in re.findall(r"hashpartitioning\(a#\d+L?, b#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)]
        assert places and min(places) > 10
