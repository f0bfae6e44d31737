from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from meritgrid.llm.lm_scoring import backoff_scores, numbers, packed, unnumbers, unpacked
from tests.llm.cases import awkward, empty, prose, table


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def grams_of(w, order):
    return Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))


def brute_force(docs, order):
    words = {i: words_of(t) for i, t in docs}
    counts = sum((grams_of(w, order) for w in words.values()), Counter())
    total = sum(map(len, words.values()))
    out = {}
    for doc, w in words.items():
        own = grams_of(w, order)
        others = lambda g: counts[g] - own[g]  # noqa: B023, E731
        score = 0.0
        for i in range(len(w)):
            for k in range(min(i + 1, order), 0, -1):
                gram = tuple(w[i - k + 1 : i + 1])
                if k == 1:
                    score += math.log(max(others(gram), 1) / max(total - len(w), 1))
                elif others(gram) > 0:
                    score += math.log(others(gram) / others(gram[:-1]))
                    break
                else:
                    score += math.log(0.4)
        out[doc] = (len(w), score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_brute_force(spark, order):
    docs = [(i, prose(i, i % 40)) for i in range(60)] + [(60, prose(3, 700)), (61, prose(5, 5)), (62, prose(9, 9) + " " + prose(9, 9))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_force(docs, order)
    for size in (800, None):
        got = {r["id"]: (r["n_words"], r["total"]) for r in backoff_scores(df, order=order, group_bytes=size).collect()}
        assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()}
        assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-6) for i in want)


def test_long_texts(spark):
    """Two texts of 20 MB and a short one: the long ones are groups of their own."""
    long = prose(1, 4000) + " "
    text = long * (20_000_000 // len(long))
    df = spark.createDataFrame([(1, text), (2, text), (3, prose(1, 50))], "doc_id long, text string").repartition(3)
    rows = {r["id"]: r for r in backoff_scores(df, group_bytes=4 << 20).collect()}
    assert rows[1]["n_words"] == rows[2]["n_words"] > 3_000_000 and rows[1]["total"] == pytest.approx(rows[2]["total"])
    assert rows[3]["score"] > -3


def test_blocks():
    values = np.unique(np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (unpacked(packed(values)) == values).all() and (unnumbers(numbers(values)) == values).all()
    assert len(unpacked(packed(values[:0]))) == 0


def test_awkward_rows(spark):
    rows = backoff_scores(table(spark)).collect()
    assert len(rows) == len(awkward())
    assert all(r["n_words"] or (r["total"], r["score"]) == (0, 0) for r in rows)
    assert backoff_scores(empty(spark)).count() == 0


def test_rows_without_an_id_are_spread_over_groups(spark):
    rows = [(None, prose(i, 200)) for i in range(60)] + [(1, prose(i, 200)) for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = backoff_scores(docs, group_bytes=8000).collect()
    want = backoff_scores(docs).collect()
    assert sorted((r["id"] or 0, r["n_words"], round(r["total"], 6)) for r in got) == sorted((r["id"] or 0, r["n_words"], round(r["total"], 6)) for r in want)
