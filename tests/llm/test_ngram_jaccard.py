from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from meritgrid.llm import ngram_jaccard
from meritgrid.llm.ngram_jaccard import jaccard_components, jaccard_stage, shingles
from tests.llm.cases import awkward, empty, prose, table


def sets(docs: list[tuple[int, str]], k: int) -> dict[int, frozenset]:
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(zip(*(w[j:] for j in range(k)), strict=False))
    return out


def brute_force(docs: list[tuple[int, str]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    s = sets(docs, k)
    parent = {i: i for i in s}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in s:
        for j in s:
            if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s[i]), root(i)) for i in s}


@pytest.mark.parametrize("crowd", [64, 2])
@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 80)])
def test_against_brute_force(spark, k, percent, crowd, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "CROWD", crowd)
    monkeypatch.setattr(ngram_jaccard, "TILE", 8)
    rng = random.Random(k)
    docs = []
    for i in range(150):
        if docs and rng.random() < 0.6:
            words = rng.choice(docs)[1].split()
            for _ in range(rng.randrange(0, 3 + len(words) // 30)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(9)}"
            docs.append((i, "Common boiler plate line here. " * (rng.random() < 0.3) + " ".join(words)))
        else:
            docs.append((i, prose(i, rng.choice([1, 2, 8, 11, 40, 200]))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df, words=k, threshold=str(percent / 100)).collect()}
    assert got == brute_force(docs, k, percent)
    assert sum(i != c for i, (_, c) in got.items()) > 10


@pytest.mark.parametrize(("often", "columns", "pairs"), [(32, 4096, 1 << 21), (2, 3, 7), (0, 5, 1), (1000, 4, 2)])
def test_shared_counts(monkeypatch, often, columns, pairs):
    for name, value in (("OFTEN", often), ("COLUMNS_AT_ONCE", columns), ("PAIRS_AT_ONCE", pairs)):
        monkeypatch.setattr(ngram_jaccard, name, value)
    rng = np.random.default_rng(4)
    a, b = ([np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(n)] for n in (9, 14))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert ngram_jaccard._shared(a, b).tolist() == want


def test_a_crowd_leaves_a_forest():
    """Many sets that all link are no more edges than sets."""
    base = np.arange(100, dtype=np.uint64)
    rows = [(i, 100, i, np.append(base[1:], np.uint64(1000 + i))) for i in range(200)]
    x, y = ngram_jaccard._joined_tiles(rows, rows, True, ngram_jaccard.Fraction("0.9"))
    assert sorted(x.tolist()) == list(range(1, 200)) and set(y.tolist()) == {0}


def test_awkward_rows(spark):
    rows = jaccard_components(table(spark), words=3, threshold="0.9").collect()
    assert len(rows) == len(awkward())
    by = {r["doc_id"]: r for r in rows}
    assert (by[2]["n_shingles"], by[3]["n_shingles"], by[4]["n_shingles"], by[5]["n_shingles"]) == (0, 0, 0, 1)
    assert by[7]["component_id"] == 1 and by[10]["component_id"] == 1 and by[3]["component_id"] == 3
    assert by[None]["component_id"] is None
    out = jaccard_stage(spark, table(spark), "")
    assert out.columns == table(spark).columns
    assert sorted(str(r["doc_id"]) for r in out.collect()).count("1") == 3 and 7 not in [r["doc_id"] for r in out.collect()]


def test_empty(spark):
    assert jaccard_components(empty(spark), words=3, threshold="0.9").count() == 0


def test_texts_with_one_id_are_documents_of_their_own(spark):
    base = {k: [f"{k}{i}" for i in range(40)] for k in "ab"}
    a, b = (" ".join(base[k]) for k in "ab")
    rows = [(8, a), (8, b), (9, a + " zz"), (10, b + " yy"), (11, "something else")]
    for n in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_components(docs, words=3, threshold="0.9").collect()}
        assert got == {(8, 38): 8, (9, 39): 8, (10, 39): 8, (11, 1): 11}


def test_stage_removes_by_id_and_text(spark):
    text, own = prose(1, 60), prose(2, 60)
    rows = [(1, text), (20, text), (20, own), (21, None), (None, text), (22, own), (1, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r[0] or 0, r[1] or "") for r in jaccard_stage(spark, docs, "").collect()))
    assert got == sorted([(1, text), (1, text), (20, own), (21, ""), (0, text)])


def test_shingles_are_those_of_each_text(spark):
    texts = [prose(i, i) for i in range(12)] + [None, "", "a b", "A b a b a b a b"]
    values, first = shingles(pa.record_batch({"t": pa.array(texts, pa.string())}), "t", 3)
    seen: dict[tuple[str, ...], int] = {}
    for t, x, y in zip(texts, first[:-1], first[1:], strict=True):
        w = (t or "").lower().split()
        want = {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()
        assert len(want) == y - x
        for v in values[x:y].tolist():
            seen.setdefault(v, 0)
    every = {tuple(w[i : i + 3]) for t in texts if (w := (t or "").lower().split()) for i in range(max(len(w) - 2, 1))}
    assert len(seen) == len(every)


def test_keys_of_one_passage_are_one_crowd(spark, monkeypatch):
    """A passage has many keys, of nearly the same documents; their sets travel a few times, not once a key."""
    monkeypatch.setattr(ngram_jaccard, "CROWD", 4)
    sent = []
    fetched = ngram_jaccard._fetched
    monkeypatch.setattr(ngram_jaccard, "_fetched", lambda ids, *more: (sent.append(ids.count()), fetched(ids, *more))[1])
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(400)]
    docs = [(i, " ".join(passage + [f"own{i}x{k}" for k in range(rng.randrange(56, 84))])) for i in range(60)]
    docs += [(100 + i, docs[i][1] + " end") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df, words=3, threshold="0.8").collect()}
    assert got == brute_force(docs, 3, 80)
    assert 0 < max(sent) <= 4 * len(docs)
