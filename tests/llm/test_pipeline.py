from __future__ import annotations

import random

import pytest

from meritgrid.llm.components import components
from tests.llm.cases import empty, prose, table


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 1), (5, 5), *((i, i + 1) for i in range(20, 60)), *((100, i) for i in range(101, 140))]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | dict.fromkeys(range(20, 61), 20) | dict.fromkeys(range(100, 140), 100)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_components_of_random_graphs(spark, monkeypatch, most):
    """Against a plain search; few edges at once and, with `most` 0, salted moves."""
    from meritgrid.functions import graph as module

    monkeypatch.setattr(module, "BROADCAST_ROWS", most)
    monkeypatch.setattr(module, "EDGES_AT_ONCE", 8)
    rng = random.Random(most)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1000 + (i * 7) % 64) for i in range(64)]
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want: dict[int, int] = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = {r["id"]: r["component"] for r in components(df).collect()}
    assert got == {i: c for i, c in want.items() if near[i] != {i}}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    junk = "$$$ BUY !!! click | win | "
    rows, labels = [], []
    for i in range(90):
        if i % 6 == 5:
            text = " ".join([junk] * 12) + str(i)
        elif i % 6 == 4 and i > 4:
            text = prose(i - 4, 60) + " end"
        else:
            text = prose(i, 60) + ("\nThis very line stands in a good many documents here." if i % 2 else "")
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 0 if i % 6 == 5 else 1, 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, n, seen = docs.columns, [], {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        seen[name] = out.collect()
        n.append(len(seen[name]))
        if name != "best_fit_packing":
            assert out.columns == columns
            docs = spark.createDataFrame(seen[name], docs.schema)
    assert n[0] == 75 and n[1] == n[0] and n[2] == n[1] and n[3] < n[2]
    lines = [line for r in seen["line_dedup"] for line in r["text"].split("\n")]
    assert lines.count("This very line stands in a good many documents here.") == 1
    kept = {r["doc_id"] for r in seen["ngram_jaccard"]}
    assert 0 in kept and not [i for i in kept if i % 6 == 4 and i > 4 and i - 4 in kept]
    assert {r["doc_id"] for r in seen["best_fit_packing"]} == kept
    assert corpus_pipeline.run(spark, folder).count() == n[4]


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, rows in (("awkward", table(spark)), ("empty", empty(spark))):
        folder = f"{tmp_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(
            [(1, None, 1), (None, 1, 0), (1, 1, 1), (5, 0, None), (5, 1, 0)],
            "doc_id long, quality int, toxic int",
        ).write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            out = function(spark, docs, folder)
            assert out.columns == docs.columns and out.count() <= docs.count(), stage
        n = corpus_pipeline.run(spark, folder).count()
        assert n == 0 if name == "empty" else n > 0
