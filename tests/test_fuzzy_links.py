from __future__ import annotations

import random

import pytest

from meritgrid.operators import identity
from meritgrid.operators.closeness import lcs
from meritgrid.plans.rule_queries import fuzzy_link

ART = "artifact_id string, names array<string>, ror_id string, parent_ror_id string, coauthors array<string>, terms array<string>, year int"
CAND = "uuid string, names array<string>, rors array<string>, terms array<string>, first_year int, last_year int"


def test_names_without_a_common_word(spark):
    art = spark.createDataFrame([("a", ["Jon Smyth"], None, None, [], [], 2010)], ART)
    cand = spark.createDataFrame([("u1", ["John Smith"], [], [], 2005, 2015), ("u2", ["Kay Lo"], [], [], 2005, 2015)], CAND)
    row = identity.link(art, cand).first()
    assert (row["uuid"], row["action"], round(row["confidence"], 6)) == ("u1", "review", 0.562857)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)

    def name() -> str:
        return rng.choice(["Jon", "John", "Jane", "Zoë", "x" * 70, "y" * 230]) + " " + rng.choice(["Smith", "Smyth", "Roe", "Rowe", ""])

    def some(values: list[str], n: int) -> list[str]:
        return [rng.choice(values) for _ in range(rng.randrange(n))]

    arts = [(f"a{i}", [name() for _ in range(rng.randrange(1, 3))], rng.choice([None, "r1", "r2"]), rng.choice([None, "r3"]), [name() for _ in range(rng.randrange(2))], some(["t1", "T2", "t3"], 3), rng.choice([None, 1980, 2010])) for i in range(30)]
    cands = [(f"u{i}", [name() for _ in range(rng.randrange(1, 3))], some(["r1", "r2", "r3"], 3), some(["T1", "t2", "t4"], 3), rng.choice([None, 2000]), rng.choice([None, 2012])) for i in range(40)]

    def score(a: tuple, c: tuple) -> float:
        low = lambda x: {v.lower() for v in x}
        jac = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
        ratio = lambda x, y: round(200 * lcs(x, y) / (len(x) + len(y))) / 100
        place = 0.0 if a[2] is None else 1.0 if a[2] in c[2] else 0.5 if a[3] in c[2] else 0.0
        year, first, last = a[6], c[4], c[5]
        time = 0.5 if None in (year, first, last) else 1.0 if first <= year <= last else max(0.0, 1 - min(abs(year - first), abs(year - last)) / 20)
        parts = [(0.35, max(ratio(x.lower(), y.lower()) for x in a[1] for y in c[1])), (0.25, place), (0.10, time)]
        parts += [(0.15, jac(low(a[4]), low(c[1])))] * bool(a[4]) + [(0.15, jac(low(a[5]), low(c[3])))] * bool(a[5] and c[3])
        return sum(w * f for w, f in parts) / sum(w for w, _ in parts)

    got = {r["artifact_id"]: r for r in identity.link(spark.createDataFrame(arts, ART), spark.createDataFrame(cands, CAND)).collect()}
    assert len(got) == len(arts)
    for a in arts:
        best = max(score(a, c) for c in cands)
        row = got[a[0]]
        if best >= 0.5:
            assert abs(row["confidence"] - best) < 1e-9
            assert row["uuid"] == min(c[0] for c in cands if score(a, c) > best - 1e-9)
        else:
            assert (row["uuid"], row["confidence"], row["action"]) == (None, 0.0, "reject")


def test_all_customers_are_candidates(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(600, 0)], "s_suppkey long, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(0, "x")], "n_nationkey int, n_name string").write.parquet(f"{d}/nation.parquet")
    spark.createDataFrame(
        [(u, "c", 0, "s", 0.0) for u in (1, 600, 999)],
        "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double",
    ).write.parquet(f"{d}/customer.parquet")
    assert [tuple(r)[:2] for r in fuzzy_link(spark, d).collect()] == [(600, "600")]


def test_organisations_against_all_names(spark):
    """As a comparison with every name gives them."""
    rng = random.Random(7)
    words = ["North", "South", "River", "Stone", "University", "Institute", "Clinic", "of", "Medicine", "é"]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(40)})
    texts = ["North Rivr Univ", "Stonne Clinc", "south", "xyz", "INST of Medicine", names[3].upper()]
    raw = spark.createDataFrame([(t,) for t in texts], "affiliation string")
    table = spark.createDataFrame([(n, f"r{i}") for i, n in enumerate(names)], "canonical_name string, ror_id string")
    none = spark.createDataFrame([], "alias string, canonical_name string")
    got = {r["affiliation"]: (r["canonical_name"], r["confidence"]) for r in identity.resolve_organisations(raw, table, none).collect()}
    for t in texts:
        x = " ".join(identity.ABBREVIATIONS.get(w, w) for w in t.lower().split())
        ratios = [1.0 if n.lower() == t.lower() else round(200.0 * lcs(x, n.lower()) / (len(x) + len(n))) / 100.0 for n in names]
        assert got[t] == (names[ratios.index(max(ratios))], max(ratios))


def test_links_need_no_product_of_both_sides(spark):
    art = spark.createDataFrame([("a", ["Jon Smyth"], "r1", None, ["Al B"], ["t"], 2010)], ART)
    cand = spark.createDataFrame([("u1", ["John Smith"], ["r1"], ["t"], 2005, 2015)], CAND)
    plan = identity.link(art, cand)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert identity.link(art, cand.limit(0)).first()["action"] == "reject"
    assert identity.link(art.limit(0), cand).count() == 0


def test_crowded_organisations_give_the_same_links(spark, monkeypatch):
    """Where many candidates share an organisation and years, the closest names are searched for: far fewer pairs, the
    same links, of those without names, co-authors or terms too."""
    rng = random.Random(8)
    made = lambda: [f"customer {rng.randrange(300)} {rng.choice(['smith', 'smythe'])}" for _ in range(rng.randrange(3))]
    pick = lambda values: [rng.choice(values) for _ in range(rng.randrange(3))]
    arts = [(f"a{i}", made(), rng.choice([None, "r1", "r2"]), rng.choice([None, "r3"]), made() if i % 5 == 0 else [], pick(["t1", "t2"]) if i % 4 == 0 else [], rng.choice([None, 1980, 2010])) for i in range(60)]
    cands = [(f"u{i}", made(), pick(["r1", "r2", "r3"]), pick(["t1", "t3"]), rng.choice([None, 2000]), rng.choice([None, 2012])) for i in range(120)]
    found, pairs = [], []
    shared = identity._sharing
    monkeypatch.setattr(identity, "_sharing", lambda *a: pairs.append(shared(*a).distinct().cache()) or pairs[-1])
    for crowd in (10**9, 3):
        monkeypatch.setattr(identity, "CROWD", crowd)
        links = identity.link(spark.createDataFrame(arts, ART), spark.createDataFrame(cands, CAND))
        found.append(sorted((r["artifact_id"], r["uuid"] or "", r["confidence"], r["action"]) for r in links.collect()))
    assert found[0] == found[1]
    assert pairs[1].count() < 0.7 * pairs[0].count()
