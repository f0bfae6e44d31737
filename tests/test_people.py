from __future__ import annotations

import random

from pyspark.sql import functions as F

from meritgrid.functions.graph import named_components
from meritgrid.operators.people import merged_people, resolve_people

RECORDS = "id string, strong_keys map<string,string>"
STORED = "uuid string, strong_keys map<string,string>"
LINKS = "id string, uuid string"


def groups_of(nodes: list[str], edges: list[tuple[str, str]]) -> set[frozenset[str]]:
    parent = {n: n for n in nodes}

    def top(n: str) -> str:
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        parent[top(a)] = top(b)
    out: dict[str, set[str]] = {}
    for n in nodes:
        out.setdefault(top(n), set()).add(n)
    return {frozenset(v) for v in out.values()}


def sample(seed: int, n: int = 80) -> tuple[list, list, list]:
    rng = random.Random(seed)

    def keys() -> dict[str, str] | None:
        return {t: f"{rng.randrange(n // 2)}" for t in ("orcid", "era", "npi") if rng.random() < 0.35} or rng.choice([None, {}, {"orcid": None}])

    records = [(f"i{k}", keys()) for k in range(n)]
    stored = [(f"u{k}", keys()) for k in range(n // 4)]
    links = [(f"i{rng.randrange(n)}", f"u{rng.randrange(n // 3)}") for _ in range(n // 10)] + [("i1", None), (None, "u1")]
    return records, stored, links


def expected(records, stored, links) -> set[frozenset[str]]:
    nodes = [f"record {i}" for i, _ in records] + [f"stored {u}" for u, _ in stored]
    holders: dict[tuple[str, str], str] = {}
    edges = []
    for name, own in [*((f"record {i}", k) for i, k in records), *((f"stored {u}", k) for u, k in stored)]:
        for kv in (own or {}).items():
            if kv[1] is not None:
                edges.append((name, holders.setdefault(kv, name)))
    edges += [(f"record {i}", f"stored {u}") for i, u in links if f"record {i}" in nodes and f"stored {u}" in nodes]
    return groups_of(nodes, edges)


def found(df) -> tuple[set[frozenset[str]], dict[str, str]]:
    uuid = {f"{r['kind']} {r['id']}": r["uuid"] for r in df.collect()}
    out: dict[str, set[str]] = {}
    for k, u in uuid.items():
        out.setdefault(u, set()).add(k)
    return {frozenset(v) for v in out.values()}, uuid


def frames(spark, records, stored, links, n=3):
    return spark.createDataFrame(records, RECORDS).repartition(n), spark.createDataFrame(stored, STORED).repartition(n), spark.createDataFrame(links, LINKS)


def test_people_are_components_whatever_the_order(spark):
    rng = random.Random(9)
    records, stored, links = sample(2)
    groups, first = found(resolve_people(*frames(spark, records, stored, links)))
    assert groups == expected(records, stored, links)
    for part in groups:
        known = sorted(k.removeprefix("stored ") for k in part if k.startswith("stored "))
        assert {first[k] for k in part} == ({known[0]} if known else {first[next(iter(part))]})
    for side in (records, stored, links):
        rng.shuffle(side)
    assert found(resolve_people(*frames(spark, records, stored, links, 7)))[1] == first


def test_a_later_batch_meets_what_is_stored(spark):
    records, _, _ = sample(5)
    none = spark.createDataFrame([], STORED), spark.createDataFrame([], LINKS)
    whole, _ = found(resolve_people(spark.createDataFrame(records, RECORDS), *none))
    half = spark.createDataFrame(records[:40], RECORDS)
    before = resolve_people(half, *none)
    stored = half.join(before.select("id", "uuid"), "id").where("strong_keys is not null").select("uuid", F.explode("strong_keys").alias("t", "v")).where("v is not null")
    # stored people of several values of one key have a row a value
    rows = stored.distinct().select("uuid", F.create_map("t", "v").alias("strong_keys"))
    _, later = found(resolve_people(spark.createDataFrame(records[40:], RECORDS), rows, none[1]))
    first = found(before)[1]
    final = {f"record {i}": later.get(f"record {i}") or later.get(f"stored {first[f'record {i}']}", first[f"record {i}"]) if f"record {i}" in first else later[f"record {i}"] for i, _ in records}
    out: dict[str, set[str]] = {}
    for k, u in final.items():
        out.setdefault(u, set()).add(k)
    assert {frozenset(v) for v in out.values()} == whole


def test_merged_rows(spark):
    schema = "kind string, id string, strong_keys map<string,string>, names array<string>, refs array<string>, populations array<string>, specialties map<string,double>, confidence double"
    rows = [
        ("record", "1", {"orcid": "a"}, ["B", "A"], ["p1"], ["x"], {"s": 0.2}, 0.5),
        ("record", "2", {"orcid": "b", "npi": "9"}, ["A", None], None, ["y", "x"], {"s": 0.7, "t": 0.1}, None),
        ("stored", "u", {"npi": "9"}, [], ["p2", "p1"], None, None, 0.9),
        ("record", "3", None, None, None, None, None, None),
    ]
    people = spark.createDataFrame([("record", "1", "u"), ("record", "2", "u"), ("stored", "u", "u"), ("record", "3", "v")], "kind string, id string, uuid string")
    got = {r["uuid"]: r.asDict() for r in merged_people(spark.createDataFrame(rows, schema), people).collect()}
    assert got["u"] == {
        "uuid": "u", "n_records": 2, "n_stored": 1, "confidence": 0.9, "names": ["A", "B"], "refs": ["p1", "p2"], "populations": ["x", "y"],
        "strong_keys": {"npi": "9", "orcid": "a"}, "conflicts": 1, "specialties": {"s": 0.7, "t": 0.1},
    }
    assert got["v"]["names"] is None and got["v"]["n_records"] == 1


def test_components_of_named_nodes(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)] + [(f"c{i}", f"c{i + 1}") for i in range(70)] + [("z", "z")]
    nodes = sorted({n for e in edges for n in e})
    got: dict[str, set[str]] = {}
    for r in named_components(spark.createDataFrame(edges, "a string, b string")).collect():
        got.setdefault(r["component"], set()).add(r["id"])
    assert all(k == min(v) for k, v in got.items())
    assert {frozenset(v) for v in got.values()} == groups_of(nodes, edges)


def test_a_key_of_many_and_no_rows(spark):
    records = [(f"i{k}", {"orcid": "same"}) for k in range(300)] + [("j", {"npi": " "})]
    groups, _ = found(resolve_people(*frames(spark, records, [], [])))
    assert sorted(map(len, groups)) == [1, 300]
    assert resolve_people(*frames(spark, [], [], [])).count() == 0
