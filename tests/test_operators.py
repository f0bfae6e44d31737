"""Operators on small fixtures with known results."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meritgrid.functions import positions
from meritgrid.operators import closeness, features, identity, integrity, learning, monitoring, privacy, ranking, store
from meritgrid.streaming import events


def one(df):
    return df.collect()[0].asDict()


def test_positions_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(positions, "BUCKET_ROWS", 10)
    rows = [(i, None if i % 50 == 0 else float(i % 7)) for i in range(500)]
    got = positions.numbered(spark.createDataFrame(rows, "k long, v double"), ["v", "k"]).collect()
    want = {k: p for p, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])), start=1)}
    assert {r["k"]: r["position"] for r in got} == want and {r["n_rows"] for r in got} == {500}


def test_percentiles(spark):
    df = spark.createDataFrame([(f"u{i}", float(i)) for i in range(100)], "uuid string, raw double")
    p = {r["uuid"]: r["percentile"] for r in positions.midpoint_percentile(df, "raw", "uuid").collect()}
    assert p["u0"] < 0.02 and p["u99"] > 0.98
    assert one(positions.midpoint_percentile(df.limit(1), "raw", "uuid"))["percentile"] == 0.5
    assert one(positions.span_percentile(df.limit(1), "raw", "uuid"))["percentile"] == 0.0


def test_order_statistics(spark):
    rows = [(k, float(v), i) for k, n in (("a", 10), ("b", 1), ("c", 57)) for i, v in enumerate(range(n, 0, -1))]
    df = spark.createDataFrame(rows, "k string, v double, id int").repartition(3)
    places = {"p90": F.least(F.floor(F.col("_n") * 0.9), F.col("_n") - 1), "low": F.lit(0)}
    got = {r["k"]: (r["p90"], r["low"]) for r in positions.order_statistics(df, ["k"], ["v", "id"], "v", places).collect()}
    assert got == {"a": (10.0, 1.0), "b": (1.0, 1.0), "c": (52.0, 1.0)}


@pytest.mark.parametrize("rows", [3, 20_000])
def test_running_sums_and_nulls(spark, monkeypatch, rows):
    """With one bucket and with many, nulls first, a frequent value cut by the next column."""
    monkeypatch.setattr(positions, "BUCKET_ROWS", rows)
    data = [(None if i % 5 == 0 else float(i % 3), i, i % 4) for i in range(200)]
    df = spark.createDataFrame(data, "v double, id int, w int").repartition(4)
    got = {r["id"]: r["s"] for r in positions.running_sums(df, ["v", "id"], {"s": F.col("w")}).collect()}
    want, total = {}, 0
    for _, i, w in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want[i] = total
        total += w
    assert got == want
    placed = {r["id"]: r["position"] for r in positions.numbered(df, ["v", "id"]).collect()}
    assert [i for i, _ in sorted(placed.items(), key=lambda x: x[1])] == list(want)
    shares = {r["id"]: r["percentile"] for r in positions.below_share(df, "v").collect()}
    known = [r for r in data if r[0] is not None]
    want_shares = {i: None if v is None else sum(x[0] < v for x in known) / len(known) for v, i, _ in data}
    assert shares.keys() == want_shares.keys() and all(shares[i] == pytest.approx(w, abs=6e-5) if w is not None else shares[i] is None for i, w in want_shares.items())


def test_sliding_counts_of_a_busy_customer(spark):
    rng = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, c, t0 + dt.timedelta(seconds=rng.randrange(300))) for i in range(400) for c in ["hot" if i % 3 else f"c{i % 7}"]]
    got = {r["id"]: r["in_window"] for r in events.sliding_counts(spark.createDataFrame(rows, "id int, customer string, ts timestamp")).collect()}
    want = {i: sum(k == c and 0 <= (t - u).total_seconds() <= 60 for _, k, u in rows) for i, c, t in rows}
    assert got == want and len(got) == len(rows)


def test_citation_impact(spark):
    rows = [("a", 1.5, 1.0, None)] * 10 + [("a", 1.5, 0.7, None)] * 5 + [
        ("b", 2.0, 1.0, "Editorial"),
        ("b", 2.0, 1.0, "Letter"),
        ("b", 2.0, 1.0, "Journal Article"),
        ("c", 0.0, 1.0, None),
    ]
    got = {r["uuid"]: r for r in features.citation_impact(spark.createDataFrame(rows, "uuid string, rcr double, author_weight double, article_type string")).collect()}
    assert got["a"]["eligible_paper_count"] == 15 and not got["a"]["low_confidence"]
    assert got["b"]["eligible_paper_count"] == 1 and got["b"]["low_confidence"]
    assert got["c"]["eligible_paper_count"] == 0 and got["c"]["mean_rcr_log"] == 0.0
    assert got["a"]["top_rcr_log"] == pytest.approx(math.log(1.5 + 1e-9))


def test_lineage_and_translational(spark):
    df = spark.createDataFrame([("a", 8, 4, 0.95)], "uuid string, traceable_trainee_count int, r01_trainee_count int, aft_link_confidence double")
    assert one(features.lineage(df))["composite"] == pytest.approx(0.76)
    df = spark.createDataFrame([("a", 2, 3, True)], "uuid string, fda_submission_count int, phase2plus_trial_count int, is_nccn_panel_member boolean")
    assert one(features.translational(df))["composite"] == pytest.approx(0.7233, abs=1e-3)


def test_clinician(spark):
    schema = "uuid string, is_board_certified boolean, has_moc boolean, certification_count int, has_active_license boolean, has_disciplinary_action boolean, action_severity string, hospital_tier int, specialty_rank int, trial_pi_count int, trial_phases array<int>, total_procedures int, procedure_volume_available boolean"
    rows = [
        ("a", True, False, 3, True, True, "probation", 2, 3, 4, [2, 3], 0, False),
        ("b", False, True, 1, False, False, None, 9, None, 0, [], 900, True),
    ]
    got = {r["uuid"]: r for r in features.clinician(spark.createDataFrame(rows, schema)).collect()}
    a, b = got["a"], got["b"]
    assert (
        a["board_certification_score"],
        a["license_score"],
        a["hospital_tier_score"],
        a["trial_pi_score"],
        a["procedure_volume_confidence"],
    ) == (0.9, 0.5, 0.9, 1.0, 0.3)
    assert (
        b["board_certification_score"],
        b["license_score"],
        b["hospital_tier_score"],
        b["procedure_volume_score"],
        b["coverage_caveat"],
    ) == (0.0, 0.0, 0.2, 1.0, None)


def test_topical_fit(spark):
    art = spark.createDataFrame(
        [("same", 1.0, ["x", "y"]), ("part", 1.0, ["x", "z"]), ("none", 1.0, ["q"])],
        "uuid string, w double, terms array<string>",
    )
    got = {r["uuid"]: r["topical_fit"] for r in ranking.topical_fit(ranking.topic_vectors(art, F.col("w")), ranking.query_vector({"x": 1.0, "y": 1.0})).collect()}
    assert got["same"] == pytest.approx(1.0) and got["part"] == pytest.approx(0.5) and "none" not in got


def test_recency(spark):
    today = dt.date(2024, 1, 1)
    rows = [
        ("new", today, 1.0, 1.0, False, ["x"]),
        ("old", dt.date(2000, 1, 1), 1.0, 1.0, False, ["x"]),
        ("other", today, 1.0, 1.0, False, ["z"]),
        ("pre", today, 1.0, 1.0, True, ["x"]),
        *([("many", today, 1.0, 1.0, False, ["x"])] * 12),
        ("future", dt.date(2054, 1, 1), 1.0, 1.0, False, ["x"]),
    ]
    df = spark.createDataFrame(rows, "uuid string, published date, role_weight double, type_weight double, is_preprint boolean, terms array<string>")
    got = {r["uuid"]: r["recency"] for r in ranking.recency(df, ["x"], F.lit(today)).collect()}
    assert got["new"] > 0.2 and got["old"] < 0.05 and got["other"] == 0 and got["pre"] < got["new"] and got["many"] > 0.95 and 0 <= got["future"] <= 1


def test_ranked(spark):
    rows = [(f"u{i}", 0.0 if i == 3 else 1.0, i / 10, 0.5, 0.5, i == 9) for i in range(10)]
    df = spark.createDataFrame(rows, "uuid string, integrity double, quality double, topical double, recency double, is_hard_zero boolean")
    top = ranking.ranked(df, 3).collect()
    assert [r["uuid"] for r in top] == ["u8", "u7", "u6"] and [r["rank"] for r in top] == [1, 2, 3]
    every = ranking.ranked(df).collect()
    assert len(every) == 8 and sorted(r["rank"] for r in every) == list(range(1, 9))


def test_score_bands(spark):
    df = spark.createDataFrame([("u", 1.0, 0.8, 0.6, 0.5)], "uuid string, integrity double, quality double, topical double, recency double")
    r = one(ranking.score_bands(df, (0.7, 1.0, 0.4), [[0.02, 0, 0], [0, 0.02, 0], [0, 0, 0.02]]))
    draws = np.random.default_rng(42).multivariate_normal((0.7, 1.0, 0.4), np.eye(3) * 0.02, size=200)
    for i, b in enumerate(ranking.EXPONENT_BOUNDS.values()):
        draws[:, i] = np.clip(draws[:, i], *b)
    want = np.percentile(0.8 ** draws[:, 0] * 0.6 ** draws[:, 1] * 0.5 ** draws[:, 2], [2.5, 50, 97.5])
    assert [r["low"], r["median"], r["high"]] == pytest.approx(list(want))


def test_hard_gate_ladder(spark):
    people = spark.createDataFrame(
        [
            ("1", "Ann Lee", "77", ["x"]),
            ("2", "Bo Ray", None, ["x"]),
            ("3", "Cy Dee", None, ["x"]),
            ("4", "Di Fox", None, ["x", "y"]),
            ("5", "Ed Gow", None, ["x"]),
            ("6", "Flo Hay", None, ["x", "y"]),
        ],
        "uuid string, name string, npi string, terms array<string>",
    )
    leie = spark.createDataFrame(
        [("none", "none", "77", None), ("Ed", "Gow", None, dt.date(2020, 1, 1))],
        "first_name string, last_name string, npi string, reinstate_date date",
    )
    ofac = spark.createDataFrame([("X", ["BO RAY"])], "primary_name string, aliases array<string>")
    ori = spark.createDataFrame([("cy dee", dt.date(2020, 1, 1)), ("Ed Gow", dt.date(2001, 1, 1))], "name string, finding_date date")
    notices = spark.createDataFrame([("4", "p", "data were fabricated"), ("6", "q", "an honest error")], "uuid string, pmid string, notice string")
    rows = integrity.recent_finding(integrity.listed(integrity.excluded(people, leie), ofac), ori, F.lit(dt.date(2024, 1, 1)))
    got = {r["uuid"]: r for r in integrity.hard_gate(rows, notices, ["x", "y"]).collect()}
    assert [got[u]["rules_evaluated"] for u in "123456"] == [1, 2, 3, 4, 5, 5]
    assert got["5"]["leie_excluded"] is None and not got["5"]["is_zero"] and got["4"]["reason"] == "retraction (fabrication) in subdomain"


def test_phi_and_fields(spark):
    rows = [
        ("a", "123-45-6789", ""),
        ("b", "id 123456789", ""),
        ("c", "my ssn is 123456789", ""),
        ("d", "on 1980-02-03", "1980-02-03"),
        ("e", "MRN: 12345", ""),
    ]
    got = {(r["uuid"], r["field"], r["pattern"]) for r in privacy.phi_scan(spark.createDataFrame(rows, "uuid string, note string, patient string"), "uuid", ["note", "patient"]).collect()}
    assert ("a", "note", "ssn_dashed") in got and ("c", "note", "ssn_nodash") in got and ("d", "patient", "dob_iso") in got and (
        "e",
        "note",
        "mrn_pattern",
    ) in got
    assert not [g for g in got if g[0] == "b"] and ("d", "note", "dob_iso") not in got
    assert [privacy.field_blocked(n) for n in ("Age", "dosage", "page_count", "gender_code", "name")] == [True, False, True, True, False]


def test_phi_as_sql_reads_it(spark):
    """Words end before an umlaut, a vertical tab is no white space, the long s and the Kelvin sign are letters."""
    duckdb = pytest.importorskip("duckdb")
    texts = ["130 die st\u00f6en", "von 3280 zuch st\u00dfbe", "12 Main \u017ft", "12 Main St", "12\x0bMain St", "\u00e4123-45-6789\u00fc", "a@b.co\u212a \u00e9x@y.de",
        "x1980-02-03", "MRN\x0b12345 \u00e4MRN 123456\u00fc", "\u017fsn is\n123456789\u00fc", "(212) 555-1234\u00e4"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, patient string")
    got = {(r["id"], r["pattern"]): r["matches"] for r in privacy.phi_scan(rows, "id", ["patient"]).collect()}
    con, want = duckdb.connect(), {}
    for i, text in enumerate(texts):
        for name, pattern in privacy.PHI_PATTERNS.items():
            found = con.execute("SELECT regexp_extract_all(?, ?)", [text, f"(?i){pattern}"]).fetchone()[0]
            if found and (name != "ssn_nodash" or i == 9):
                want[i, name] = found
    assert len(want) > 8 and got == want


def test_name_ratio(spark):
    pairs = [("john smith", "john smith", 1.0), ("abc", "xyz", 0.0), ("john smith", "jon smith", round(200 * 9 / 19) / 100), ("", "", 1.0)]
    got = spark.createDataFrame(pairs, "a string, b string, want double").select(closeness.name_ratio("a", "b").alias("r"), "want").collect()
    assert all(r["r"] == r["want"] for r in got)


def test_link(spark):
    art = spark.createDataFrame(
        [("a1", ["Jane Roe"], "r1", None, ["Al Poe"], ["t1"], 2010), ("a2", ["Zed Qux"], None, None, [], [], None)],
        "artifact_id string, names array<string>, ror_id string, parent_ror_id string, coauthors array<string>, terms array<string>, year int",
    )
    cand = spark.createDataFrame(
        [("u1", ["Jane Roe"], ["r1"], ["t1"], 2005, 2015), ("u2", ["Jane Doe"], ["r2"], ["t9"], 2005, 2015)],
        "uuid string, names array<string>, rors array<string>, terms array<string>, first_year int, last_year int",
    )
    got = {r["artifact_id"]: r for r in identity.link(art, cand).collect()}
    assert got["a1"]["uuid"] == "u1" and got["a1"]["action"] == "auto-link" and got["a2"]["uuid"] is None and got["a2"]["confidence"] == 0.0


def test_organisations(spark):
    names = spark.createDataFrame([("Stanford University", "r1"), ("Mayo Clinic", "r2")], "canonical_name string, ror_id string")
    aliases = spark.createDataFrame([("stanford", "Stanford University")], "alias string, canonical_name string")
    raw = spark.createDataFrame([("Stanford",), ("mayo  clinic",), ("Stanford Univ.",), ("",), ("zzzz",)], "affiliation string")
    got = {r["affiliation"]: (r["ror_id"], r["matched_via"]) for r in identity.resolve_organisations(raw, names, aliases).collect()}
    assert got["Stanford"] == (
        "r1",
        "alias",
    ) and got["mayo  clinic"] == (
        "r2",
        "exact",
    ) and got["Stanford Univ."] == ("r1", "fuzzy") and got[""] == (None, None) and got["zzzz"][1] == "fuzzy-low"


def test_get_or_create_and_merge(spark):
    records = spark.createDataFrame(
        [("1", {"orcid": "o1", "npi": "n1"}), ("2", {"npi": "n2"}), ("3", {})],
        "id string, strong_keys map<string,string>",
    )
    registry = spark.createDataFrame([("npi", "n1", "known")], "key_type string, key_value string, uuid string")
    got = {r["id"]: r for r in identity.get_or_create(records, registry, ["orcid", "npi"]).collect()}
    assert got["1"]["uuid"] == "known" and not got["1"]["is_new"] and got["2"]["is_new"] and got["3"]["uuid"]


def test_drift(spark):
    days = [("s", dt.date(2024, 1, 1) + dt.timedelta(i), 100) for i in range(15)] + [("s", dt.date(2024, 1, 16), 60)]
    got = {r["day"]: r for r in monitoring.drift(spark.createDataFrame(days, "source string, day date, n long")).collect()}
    assert got[dt.date(2024, 1, 15)]["severity"] is None and got[dt.date(2024, 1, 15)]["deviation"] == 0
    assert got[dt.date(2024, 1, 16)]["severity"] == "critical" and got[dt.date(2024, 1, 2)]["mean"] == 0


def test_histogram_at_the_edges_of_bins(spark):
    """Values that a product before the quotient puts into the next bin."""
    values = [k / 5 for k in range(51)]
    got = {r["bin"]: r["n"] for r in monitoring.histogram(spark.createDataFrame([("a", v) for v in values], "k string, v double"), "v", "k").collect()}
    want: dict[int, int] = {}
    for v in values:
        at = min(math.floor((v - 0.0) / ((10.0 - 0.0) / 50)) + 1, 50)
        want[at] = want.get(at, 0) + 1
    product = {min(int(50 * v / 10.0) + 1, 50) for v in values}
    assert got == want and set(got) != product


def test_jumps(spark):
    rows = [("p", 1, 1.0), ("p", 2, 1.3), ("p", 3, 3.0), ("q", 1, 0.0), ("q", 2, 0.5), ("r", 2, 1.0), ("r", 10, 1.1)]
    got = {(r["parameter"], r["version"]): r["severity"] for r in monitoring.jumps(spark.createDataFrame(rows, "parameter string, version int, value double"), "parameter").collect()}
    assert got == {("p", 2): "warning", ("p", 3): "critical", ("q", 2): "critical"}


def test_kappa(spark):
    full = spark.createDataFrame([("a", "a"), ("b", "b")], "x string, y string")
    assert one(monitoring.pooled_kappa(full, "x", "y"))["kappa"] == 1.0
    assert one(monitoring.pooled_kappa(full.limit(1), "x", "y"))["kappa"] is None


def test_exponents_are_recovered(spark):
    rng = np.random.default_rng(7)
    w, other = rng.uniform(0.05, 1, (2000, 3)), rng.uniform(0.05, 1, (2000, 3))
    gap = (np.log(w) - np.log(other)) @ np.array([0.8, 1.1, 0.5])
    wins = rng.uniform(size=2000) < 1 / (1 + np.exp(-gap))
    rows = [tuple(map(float, [*(a if k else b), *(b if k else a)])) for a, b, k in zip(w, other, wins, strict=True)]
    fit = learning.fit_exponents(spark.createDataFrame(rows, "wq double, wt double, wr double, lq double, lt double, lr double"))
    assert fit.exponents == pytest.approx((0.8, 1.1, 0.5), abs=0.15) and learning.cold_start(fit) == "ready"
    none = learning.fit_exponents(spark.createDataFrame([], "wq double, wt double, wr double, lq double, lt double, lr double"))
    assert none.exponents == learning.START and learning.deployment(learning.START, none) == "blocked"


def test_store(spark):
    t = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "k int, v string, created string")
    c = spark.createDataFrame([(2, "B", "t1"), (3, "c", "t1")], "k int, v string, created string")
    assert sorted(map(tuple, store.upsert(t, c, ["k"], keep=["created"]).collect())) == [(1, "a", "t0"), (2, "B", "t0"), (3, "c", "t1")]
    assert sorted(r["k"] for r in store.delete(t, c, ["k"]).collect()) == [1]
    log = spark.createDataFrame(
        [("u", "opt_out", 1, 1), ("u", "opt_in", 2, 2), ("u", "opt_out", 3, 3), ("w", "opt_in", 1, 4)],
        "uuid string, action string, ts int, seq int",
    )
    assert [r["uuid"] for r in privacy.opted_out(log).collect()] == ["u"]
