"""Routing by specialty, weights on file, readers of landed lists, and people, on small fixtures."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from meritgrid.operators import identity, monitoring, routing, store
from meritgrid.sources import records

VECTOR = {
    "version": 1,
    "specialty": "clinician",
    "created": "2026-01-02",
    "weights": {"f1_rcr": 0.4, "f7_clinician": 0.6},
    "exponents": {"alpha": 0.7, "beta": 1.0, "gamma": 0.4},
    "exponent_bounds": {"alpha": [0.3, 1.2]},
}


def test_weights_on_file(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "clinician_v1.yaml").write_text(yaml.safe_dump(VECTOR))
    vector = routing.read_vector(str(tmp_path / "clinician_v1.yaml"))
    second = routing.write_vector(vector, (0.71239, 1.1, 0.15), str(tmp_path), "2026-02-03")
    assert second.endswith("clinician_v2.yaml") and routing.read_vector(second)["exponents"]["alpha"] == 0.7124
    assert routing.write_vector(vector, (0.7, 1.0, 0.4), str(tmp_path), "2026-02-03", staging=True).endswith("staging/clinician_v3_pending.yaml")
    table = routing.weight_vectors(spark, str(tmp_path))
    assert table.count() == 10 and routing.latest_vectors(table).select("version").distinct().collect()[0][0] == 2
    jumps = monitoring.jumps(table, "specialty", "parameter").collect()
    assert [(r["parameter"], r["severity"]) for r in jumps] == [("exponent.gamma", "critical")]
    (tmp_path / "bad_v1.yaml").write_text(yaml.safe_dump(VECTOR | {"weights": {"f1_rcr": 0.4}}))
    with pytest.raises(ValueError, match="add up"):
        routing.weight_vectors(spark, str(tmp_path))


def test_selected_specialty(spark):
    rows = [({"a": 0.2, "b": 0.5, "c": 0.5}, None), ({"a": 0.9}, "b"), ({"x": 0.9, "a": 0.1}, "zz"), ({}, None), (None, None)]
    df = spark.createDataFrame(rows, "d map<string,double>, q string")
    assert [r[0] for r in df.select(routing.selected_specialty(F.col("d"), F.col("q"), ["a", "b"])).collect()] == [
        "b",
        "b",
        "translational",
        "translational",
        "translational",
    ]


def test_collapse_without_scores_and_reassignment(spark):
    q = spark.createDataFrame([(1, ["T1", "T2"]), (2, ["T1"]), (3, [])], "query int, terms array<string>")
    scores = spark.createDataFrame([(1, 0.04), (1, 0.01), (2, 0.05)], "query int, score double")
    parents = spark.createDataFrame([("T1", "P"), ("T2", "P")], "term string, parent string")
    got = {r["query"]: (r["collapsed"], r["terms"], r["flag"]) for r in routing.collapsed(q, scores, parents).collect()}
    assert got == {1: (True, ["P", "T1", "T2"], "low_confidence_ranking"), 2: (False, ["T1"], "normal"), 3: (True, [], "low_confidence_ranking")}
    schema = "uuid int, specialty string, confidence double, probabilities map<string,double>"
    before = spark.createDataFrame([(1, "a", 0.6, {"a": 0.6, "b": 0.4}), (2, "a", 0.6, {"a": 0.6})], schema)
    now = spark.createDataFrame([(1, "c", 0.5, {"a": 0.5, "c": 0.5}), (2, "a", 0.9, {"a": 0.9})], schema)
    rows = routing.reassigned(before, now).collect()
    assert [(r["uuid"], r["shift"], r["major"]) for r in rows] == [(1, 0.5, True)]
    runs = spark.createDataFrame(
        [(dt.date(2026, 1, i), 100, 9 if i == 2 else 1, 0) for i in range(1, 11)],
        "run_date date, total int, reassigned int, major int",
    )
    assert [r["stable"] for r in routing.reassignment_rates(runs).orderBy("run_date").collect()] == [True] + [False] * 7 + [True] * 2


def test_landed_lists(spark, tmp_path):
    def land(name: str, content: dict) -> str:
        (tmp_path / name).write_text(json.dumps(content))
        return str(tmp_path / name)

    ratios = records.citation_ratios(
        spark,
        land(
            "r.json",
            {"data": [{"pmid": 7, "year": 2001, "relative_citation_ratio": 1.5}, {"pmid": 7, "year": 2003, "relative_citation_ratio": 2.5, "is_research_article": True}]},
        ),
    )
    assert [(r["pmid"], r["rcr"], r["citation_count"], r["is_research_article"]) for r in ratios.collect()] == [("7", 2.5, 0, True)]
    notices = {"message": {"items": [{"title": ["A"], "author": [{"given": "Ann", "family": "Lo"}, {"family": "Roe"}], "DOI": "10/x", "container-title": ["J"], "issued": {"date-parts": [[2020, 2, 30]]}}, {"issued": {"date-parts": [[2020, 3, 1]]}}]}}
    got = {r["doi"]: r for r in records.retractions(spark, land("n.json", notices)).collect()}
    assert got["10/x"]["authors"] == [
        "Ann Lo",
        "Roe",
    ] and got["10/x"]["retraction_date"] is None and got[None]["retraction_date"] == dt.date(2020, 3, 1) and got[None]["title"] == ""
    work = {"results": [{"id": "https://x/W1", "publication_date": "2020-01-02", "authorships": [{"author": {"display_name": "Ann"}, "author_position": "first"}, {"author": {"display_name": " Bo "}, "author_position": "middle"}], "grants": [{"award_id": "1", "funder_display_name": "F"}, {"award_id": "2"}, {}]}, {"id": "https://x/W2", "authorships": []}]}
    people = records.work_people(records.works(spark, land("w.json", work))).collect()
    assert [(p["name"], p["grant_ids"], p["pmids"], p["confidence"]) for p in people] == [("Bo", ["F-1", "2"], [], 0.65)]
    authors = records.work_authors(
        spark,
        land(
            "a.json",
            {"results": [{"id": "A", "display_name": "Ann", "orcid": "https://orcid.org/0", "affiliations": [{"id": "I", "display_name": "U", "country_code": "CH"}]}]},
        ),
    ).first()
    assert (authors["orcid"], authors["works_count"], authors["institutions"][0]["country_code"]) == ("0", 0, "CH")
    funder = records.funders(spark, land("f.json", {"results": [{"id": "F", "display_name": "Fund", "works_count": 3}]})).first()
    assert (funder["grants_count"], funder["works_count"]) == (0, 3)
    (tmp_path / "m.csv").write_text("name,institution,finding_date,finding\nAnn Lo,U,2020-01-02,falsified\n,U,,\n")
    assert [r["name"] for r in records.misconduct_findings(spark, str(tmp_path / "m.csv")).collect()] == ["Ann Lo"]
    assert records.misconduct_findings(spark, str(tmp_path / "none.csv")).count() == 0


def test_people_terms_and_medians(spark):
    people = spark.createDataFrame(
        [(" Ann Lo", 1, ["g1"]), ("Bea LO", 2, ["g2", "g1"]), ("Cy", 3, [])],
        "full_name string, seq int, grant_ids array<string>",
    )
    assert sorted(map(tuple, identity.merged_people(people).collect())) == [("cy", "Cy", []), ("lo", " Ann Lo", ["g1", "g2"])]
    terms = spark.createDataFrame(
        [(1, 0, "Lung", False), (1, 1, "Heart", False), (1, 2, "LUNG", True)],
        "uuid int, pos int, descriptor string, major boolean",
    )
    assert sorted(tuple(r) for r in identity.merged_terms(terms).collect()) == [(1, "Heart", False, 2), (1, "LUNG", True, 1)]
    own = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "z"), (3, "a"), (3, "b")], "uuid int, pmid string")
    ratios = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 9.0)], "pmid string, rcr double")
    assert sorted(map(tuple, identity.median_ratio(own, ratios).collect())) == [(1, 2.0), (2, 0.0), (3, 1.5)]


def test_sessions_and_disputes(spark):
    t = dt.datetime(2026, 1, 1, 12)
    sessions = spark.createDataFrame(
        [("a", 19, t), ("a", 20, t), ("b", 0, t + dt.timedelta(minutes=59)), ("b", 0, t + dt.timedelta(minutes=60))],
        "reviewer string, judgments int, started timestamp",
    )
    ended = spark.createDataFrame([("b", t), ("b", t - dt.timedelta(hours=5))], "reviewer string, ended timestamp")
    assert sorted((r["reviewer"], r["judgments"], r["allowed"]) for r in store.may_continue(sessions, ended).collect()) == [
        ("a", 19, True),
        ("a", 20, False),
        ("b", 0, False),
        ("b", 0, True),
    ]
    disputes = spark.createDataFrame(
        [(1, "u", "q", "integrity_concern"), (2, "u", None, "other"), (3, "u", None, "other")],
        "dispute int, uuid string, query string, category string",
    )
    decisions = spark.createDataFrame([(1, False, 1), (1, True, 2), (2, True, 1), (2, False, 3)], "dispute int, confirmed boolean, decided_at int")
    assert [(r["dispute"], r["direction"]) for r in store.dispute_feedback(disputes, decisions).collect()] == [(1, "flag")]
