from __future__ import annotations

import random

from pyspark.sql import functions as F

from meritgrid.operators import expansion, results


def test_lookup_terms_and_expansion(spark):
    q = spark.createDataFrame([(1, "KRAS inhibitors for lung cancer"), (2, "zzz qqqq")], "id int, query string")
    got = {r["id"]: r["t"] for r in q.select("id", expansion.lookup_terms(F.col("query")).alias("t")).collect()}
    assert got[1] == [
        "KRAS inhibitors for lung cancer",
        "KRAS inhibitors",
        "inhibitors for",
        "for lung",
        "lung cancer",
        "KRAS",
        "inhibitors",
        "lung",
        "cancer",
    ]
    v = spark.createDataFrame([(x,) for x in ("Lung Cancer, small cell", "Lung", "Proto KRAS gene", "Heart")], "label string")
    r = {x["id"]: x for x in expansion.expand(q, v).collect()}
    assert r[1]["terms"] == ["Lung Cancer, small cell", "Proto KRAS gene", "Lung"] and r[1]["confidence"] == 0.8
    assert r[2]["terms"] == ["Qqqq"] and r[2]["confidence"] == 0.3


def test_expansion_against_a_plain_loop(spark):
    rng = random.Random(1)
    parts = ["Brain", "Tumors", "Cardiology", "Non-Small", "Cell", "Lung", "Carcinoma,", "of", "é"]
    labels = sorted({" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(40)})
    asked = ["tumor", "cardio", "non-small", "cell lung", "of", "zzzz", "small cell carcinoma", "  brain, tumors  ", "é", "ardi olog"]
    q = spark.createDataFrame(list(enumerate(asked)), "id int, query string")
    got = {r["id"]: r["terms"] for r in expansion.expand(q, spark.createDataFrame([(x,) for x in labels], "label string")).collect()}
    terms = {r["id"]: r["t"] for r in q.select("id", expansion.lookup_terms(F.col("query")).alias("t")).collect()}
    for i, text in enumerate(asked):
        found: list[str] = []
        for term in terms[i]:
            for label in [x for x in labels if term.lower() in x.lower()][:5]:
                if label.lower() not in [f.lower() for f in found]:
                    found.append(label)
        assert got[i] == (found or [w.strip(".,;:!?()").capitalize() for w in text.split() if len(w.strip(".,;:!?()")) > 3])


def test_validation_and_method(spark):
    t = spark.createDataFrame([(1, ["Lung", "nothing", "DRUG"], None), (2, [], ["x"])], "id int, terms array<string>, override array<string>")
    v = spark.createDataFrame([("mesh", "lung"), ("chembl", "drug"), ("other", "nothing")], "name string, label string")
    r = {x["id"]: x for x in expansion.validate(t, v).collect()}
    assert r[1]["valid"] == ["Lung", "DRUG"] and r[1]["rejected"] == ["nothing"] and r[2]["valid"] == []
    method, low = expansion.expansion_method(F.col("override"), F.col("terms"), F.col("terms"))
    assert [(x["m"], x["l"]) for x in t.orderBy("id").select(method.alias("m"), low.alias("l")).collect()] == [("llm", False), ("override", False)]


def test_diagnosis_codes(spark):
    codes = spark.createDataFrame([("C34.1",), ("c341",), ("C34.99",), ("Z99",)], "code string")
    table = spark.createDataFrame([("C34.1", "upper lobe"), ("C34", "lung")], "code string, term string")
    got = {r["code"]: (r["term"], r["via"]) for r in expansion.diagnosis_terms(codes, table).collect()}
    assert got == {"C34.1": ("upper lobe", "exact"), "c341": ("upper lobe", "undotted"), "C34.99": ("lung", "prefix")}


def test_shown(spark):
    ranked = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.4)], "rank int, uuid string, score double")
    art = spark.createDataFrame(
        [("a", "pmid", str(i), float(i)) for i in range(5)] + [("c", "pmid", "9", 1.0)],
        "uuid string, kind string, identifier string, contribution double",
    )
    bands = spark.createDataFrame([("a", 0.4, 0.6)], "uuid string, low double, high double")
    homes = spark.createDataFrame([("b", "Uni")], "uuid string, affiliation string")
    r = {x["uuid"]: x for x in results.shown(ranked, art, bands, homes).collect()}
    assert [x["identifier"] for x in r["a"]["artifacts"]] == ["4", "3", "2"] and r["a"]["artifacts"][0]["url"] == "https://pubmed.ncbi.nlm.nih.gov/4"
    assert r["a"]["affiliation"] == "Unknown" and r["b"]["low"] == 0.4 * 0.88 and r["b"]["artifacts"] is None


def test_export(spark, tmp_path):
    results.write_csv(spark.createDataFrame([('say "hi", now', 1)], "a string, b int").coalesce(1), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_text() == '"a","b"\n"say ""hi"", now","1"\n'


def test_specialty_model(spark):
    rng = random.Random(1)
    rows = []
    for i in range(90):
        kind = ("clinician", "drug_discovery", "basic")[i % 3]
        base = dict.fromkeys(results.FEATURES, 0.0) | {"total_papers": rng.randrange(5, 50)}
        base |= {
            "has_npi": 1.0,
            "procedure_volume": rng.randrange(100, 900),
        } if kind == "clinician" else {"total_patents": rng.randrange(60, 99)} if kind == "drug_discovery" else {"total_grants": rng.randrange(60, 90)}
        rows.append((f"u{i}", kind, *(float(base[f]) for f in results.FEATURES)))
    df = spark.createDataFrame(rows, ["uuid", "specialty", *results.FEATURES])
    model = results.train_specialty(df.where("uuid < 'u6'"), trees=3, depth=2)
    got = results.classify_specialty(model, df.drop("specialty")).join(df.select("uuid", F.col("specialty").alias("want")), "uuid")
    assert got.where("specialty = want").count() >= 85
