from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meritgrid.operators import logs
from meritgrid.sources.records import archetypes

SCHEMA = "id bigint, ts timestamp, v string"


def rows(spark, own):
    return spark.createDataFrame(own, SCHEMA)


def at(day: int, hour: int = 1) -> dt.datetime:
    return dt.datetime(2024, 1, day, hour)


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    log = logs.DayLog(spark, str(tmp_path / "log"), SCHEMA, "ts", ["id"])
    assert log.read().count() == 0
    first = rows(spark, [(1, at(1), "a"), (2, at(1), "b"), (3, at(2), "c"), (None, at(2), "x"), (4, None, "y")])
    log.append(first)
    log.append(first)
    log.append(rows(spark, [(2, at(1), "other"), (5, at(2), "e"), (1, at(3), "same id, other day"), (5, at(2), "e")]))
    got = sorted((r["id"], r["ts"].day, r["v"]) for r in log.read().collect())
    assert got == [(1, 1, "a"), (1, 3, "same id, other day"), (2, 1, "b"), (3, 2, "c"), (5, 2, "e")]
    some = log.read("2024-01-02", "2024-01-02")
    assert sorted(r["id"] for r in some.collect()) == [3, 5]
    assert "PartitionFilters: [isnotnull(_day" in some._jdf.queryExecution().executedPlan().toString()


def test_a_snapshot_replaces_that_of_its_day(spark, tmp_path):
    log = logs.DayLog(spark, str(tmp_path / "log"), SCHEMA, "ts", ["id"])
    log.put(rows(spark, [(1, at(1), "a"), (2, at(1), "b"), (1, at(2), "c")]))
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "log").rglob("*2024-01-02*/*.parquet")}
    log.put(rows(spark, [(1, at(1, 5), "new")]))
    assert sorted((r["id"], r["ts"].day, r["v"]) for r in log.read().collect()) == [(1, 1, "new"), (1, 2, "c"), (2, 1, "b")]
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "log").rglob("*2024-01-02*/*.parquet")}


def test_archetypes(spark):
    schema = "archetype_id string, pmids array<string>, nct_ids array<string>, grant_ids array<string>, in_scope boolean"
    wanted = [("A", ["1", "2"], ["n"], None, True), ("B", [], [], ["g"], True), ("C", ["7", "8"], ["m"], None, True), ("D", None, None, None, None), ("E", ["9"], None, None, False)]
    stored = [("pmid", "1"), ("pmid", "2"), ("nct_id", "n"), ("grant_id", "g"), ("nct_id", "7"), ("pmid", "1")]
    got = {r["archetype_id"]: r for r in logs.archetype_coverage(spark.createDataFrame(wanted, schema), spark.createDataFrame(stored, "type string, id string")).collect()}
    assert {k: (r["expected"], r["coverage"], r["passes"]) for k, r in got.items()} == {"A": (3, 1.0, True), "B": (1, 1.0, True), "C": (3, 0.0, False), "D": (0, 1.0, True), "E": (1, 0.0, True)}
    assert got["C"]["missing"] == ["nct_id:m", "pmid:7", "pmid:8"]


def test_recall(spark):
    results = spark.createDataFrame([("q", dt.date(2024, 1, 8), 0.7), ("q", dt.date(2024, 1, 1), 0.76), ("r", dt.date(2024, 1, 8), 0.95), ("s", dt.date(2024, 1, 8), 0.75), ("s", dt.date(2024, 1, 1), 0.8)], "query string, run_date date, recall double")
    day = lambda k: F.lit(dt.date(2024, 1, k))
    assert {r["query"]: (r["delta"], r["alert"]) for r in logs.recall_trend(results, day(8), day(1)).collect()} == {"q": (-0.06, True), "s": (-0.05, False)}
    assert {r["run_date"].day: (r["mean_recall"], r["passes"]) for r in logs.recall_passes(results).collect()} == {8: (pytest.approx(0.8), True), 1: (pytest.approx(0.78), False)}


def test_trails_show_the_latest_and_count_all(spark):
    people = spark.createDataFrame([("a", "A"), ("b", "B")], "uuid string, name string")
    scores = spark.createDataFrame([("a", k, k * 0.1) for k in range(5)] + [("a", None, 9.0)], "uuid string, day int, score double")
    got = {r["uuid"]: r for r in logs.trails(people, {"scores": (scores, "day")}, 2).collect()}
    assert (got["a"]["n_scores"], [r["day"] for r in got["a"]["scores"]]) == (6, [4, 3])
    assert (got["b"]["n_scores"], got["b"]["scores"]) == (0, [])


def test_gates(spark):
    decided = spark.createDataFrame([("allowed",), ("rejected_phi",), ("allowed",)], "decision string")
    assert logs.gate_totals(decided).first().asDict() == {"checked": 3, "allowed": 2, "rejected_phi": 1, "stripped": 0, "excluded_opt_out": 0}
    fields = spark.createDataFrame([("m", None), (None, None)], "gender string, race string")
    assert {r["field"]: r["n"] for r in logs.stripped_fields(fields, ["gender", "race"]).collect()} == {"gender": 1, "race": 0}
    assert logs.stripped_fields(fields, []).count() == 0


def test_archetypes_on_file(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("archetype_id: a\nname: A\nexpected: {pmids: [1, '2'], nct_ids: [N1]}\n")
    (tmp_path / "b.yaml").write_text("archetype_id: b\nin_scope: false\nexpected: {grant_ids: [g]}\n")
    (tmp_path / "c.yaml").write_text("")
    known = archetypes(spark, str(tmp_path))
    stored = spark.createDataFrame([("pmid", "1"), ("pmid", "2"), ("nct_id", "N1")], "type string, id string")
    got = {r["archetype_id"]: (r["coverage"], r["passes"]) for r in logs.archetype_coverage(known, stored).collect()}
    assert got == {"a": (1.0, True), "b": (0.0, True)}
    assert [r["archetype_id"] for r in archetypes(spark, str(tmp_path), in_scope_only=True).collect()] == ["a"]
