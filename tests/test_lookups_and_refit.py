from __future__ import annotations

import random

import pytest
import yaml

from meritgrid.operators import classify, learning, lookups, monitoring, routing


def test_roster_members_are_narrowed_where_possible(spark):
    members = spark.createDataFrame([("Ann Lee", "Lund University", "x"), ("ANN LEE", "Oslo", "y"), ("Bo", None, "z"), (None, "Oslo", "w")], "name string, institution string, roster_type string")
    asked = [(1, "ann lee", None), (2, "ann lee", "lund"), (3, "Ann Lee", "Paris"), (4, "bo", "Paris"), (5, "no one", None), (6, "ANN LEE", "")]
    got: dict[int, list[str]] = {}
    for r in lookups.roster_members(spark.createDataFrame(asked, "id long, asked_name string, asked_institution string"), members).collect():
        got.setdefault(r["id"], []).append(r["roster_type"])
    assert {k: sorted(v) for k, v in got.items()} == {1: ["x", "y"], 2: ["x"], 3: ["x", "y"], 4: ["z"], 6: ["x", "y"]}


def test_containing_equals_a_plain_search(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abÄ ") for _ in range(rng.randrange(8))) for _ in range(60)] + [None, "xyz"]
    asked = ["a", "ab", "ba ", "äb", "abab", "q", "", None, "XY"]
    q = spark.createDataFrame(list(enumerate(asked)), "id long, asked string")
    t = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    got = sorted((r["id"], r["n"]) for r in lookups.containing(q, t, "asked", "text").collect())
    assert got == sorted((i, n) for i, a in enumerate(asked) for n, x in enumerate(texts) if a and x and a.lower() in x.lower())


def test_retractions(spark):
    notices = spark.createDataFrame([("1", ["Ann Lee", "Bo Ek"], "fraud"), ("2", ["ann leeds"], "error"), ("3", None, "none")], "pmid string, authors array<string>, reason string")
    asked = spark.createDataFrame([(1, "ann LEE"), (2, "ek"), (3, "zz")], "id long, author string")
    assert sorted((r["id"], r["pmid"]) for r in lookups.retractions_of_authors(asked, notices).collect()) == [(1, "1"), (1, "2"), (2, "1")]
    by = lookups.retractions_of_papers(spark.createDataFrame([(7, "2"), (8, "9")], "id long, pmid string"), notices)
    assert [tuple(r) for r in by.collect()] == [(7, "2", "error")]


def test_mix_flags(spark):
    rows = spark.createDataFrame([("a", 10, 9, 2, 2, 1, 0), ("b", 0, 0, 0, 0, 0, 0)], "uuid string, n_papers int, n_papers_in int, n_trials int, n_trials_in int, n_grants int, n_grants_in int")
    got = {r["uuid"]: (round(r["confidence"], 6), r["ambiguous"]) for r in classify.mix_flags(rows).collect()}
    assert got == {"a": (0.75, False), "b": (0.0, True)}


def test_cohort_is_the_last_resort(spark):
    first = spark.createDataFrame([("q1", True, ["t", "p"], "low_confidence_ranking"), ("q2", True, ["t"], "low_confidence_ranking"), ("q3", False, ["t"], "normal")], "query string, collapsed boolean, terms array<string>, flag string")
    scores = spark.createDataFrame([("q1", 0.2), ("q2", 0.01), ("q3", 0.0)], "query string, score double")
    got = {r["query"]: (r["collapsed"], r["terms"], r["flag"], r["retries"]) for r in routing.collapsed_again(first, scores).collect()}
    assert got == {"q1": (False, ["t", "p"], "expanded", 1), "q2": (True, [], "cohort_fallback", 2), "q3": (False, ["t"], "normal", 0)}


def test_changes_cover_the_metrics_of_either_side(spark):
    side = lambda rows: spark.createDataFrame(rows, "metric string, value double")
    got = {r["metric"]: r["delta"] for r in monitoring.metric_changes(side([("a", 10.0), ("b", 5.5)]), side([("b", 2.0), ("c", 1.25)])).collect()}
    assert got == {"a": 10.0, "b": 3.5, "c": -1.25}
    rows = spark.createDataFrame([("1", ["x", "x", "y"]), ("2", ["y", None]), ("3", None)], "uuid string, sources array<string>")
    assert {r["metric"]: r["value"] for r in monitoring.source_shares(rows).collect()} == {"per_source_x": 33.33, "per_source_y": 66.67}


def test_vector_shifts(spark):
    vector = lambda rows: spark.createDataFrame(rows, "specialty string, parameter string, value double")
    old, new = vector([("s", "a", 0.5), ("s", "b", 0.2), ("s", "z", 0.0)]), vector([("s", "a", 0.55), ("s", "c", 0.3), ("s", "z", 0.005)])
    got = {r["parameter"]: (r["change"], r["change_pct"], r["exceeds"]) for r in routing.vector_shifts(old, new).collect()}
    assert got == {"a": (0.05, 10.0, False), "b": (0.2, 100.0, True), "c": (0.3, 100.0, True), "z": (0.005, 0.0, False)}


def pairs(spark, alpha: float, n: int = 3000):
    rng = random.Random(4)
    rows = []
    for _ in range(n):
        a, b = ([rng.uniform(0.05, 1) for _ in range(3)] for _ in range(2))
        x, y = (s[0] ** alpha * s[1] ** 1.0 * s[2] ** 0.4 for s in (a, b))
        rows.append((*a, *b) if rng.random() < x / (x + y) else (*b, *a))
    return spark.createDataFrame(rows, "wq double, wt double, wr double, lq double, lt double, lr double")


@pytest.fixture
def folder(tmp_path):
    weights = {"f1_rcr": 0.6, "f3_leadership": 0.4}
    vector = {"version": 1, "specialty": "s", "created": "2024-01-01", "weights": weights, "exponents": {"alpha": 0.7, "beta": 1.0, "gamma": 0.4}, "exponent_bounds": {"alpha": [0.3, 1.5]}}
    (tmp_path / "s_v1.yaml").write_text(yaml.safe_dump(vector))
    return str(tmp_path)


def latest(spark, folder):
    rows = routing.latest_vectors(routing.weight_vectors(spark, folder)).collect()
    return {r["version"] for r in rows}, {r["parameter"]: r["value"] for r in rows}


def test_from_judgments_to_a_written_version_and_back(spark, folder):
    done = learning.refit(pairs(spark, 1.2), folder, "s", "2024-02-01")
    assert done["action"] == "manual" and "staging" in done["path"]
    assert latest(spark, folder)[0] == {1}
    routing.approve(done["path"])
    versions, values = latest(spark, folder)
    assert versions == {2} and abs(values["exponent.alpha"] - 1.2) < 0.2 and values["f1_rcr"] == 0.6
    routing.roll_back(folder, "s", "2024-03-01")
    versions, values = latest(spark, folder)
    assert versions == {3} and values["exponent.alpha"] == 0.7
    few = learning.refit(pairs(spark, 0.7, 5), folder, "s", "2024-04-01")
    assert few["action"] == "blocked" and few["path"] is None and latest(spark, folder)[0] == {3}
    with pytest.raises(FileNotFoundError):
        learning.refit(pairs(spark, 0.7, 5), folder, "other", "2024-04-01")
