from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from meritgrid.llm.arrowtext import mix64, text_bytes, words
from meritgrid.llm.periodic_runs import find_runs, op13_periodic_runs, planted, runs
from tests.llm.cases import empty, prose, table


def plain_runs(w: list, least: int = 12) -> list[tuple[int, int, int]]:
    """Every period by itself; of equal stretches the smallest period."""
    best: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // 2 + 1):
        s = 0
        while s < len(w) - q:
            e = s
            while e < len(w) - q and w[e] == w[e + q]:
                e += 1
            if e > s and e - s + q >= max(least, 2 * q):
                best.setdefault((s, e + q), q)
            s = max(e, s + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(w: list[str], found: list[tuple[int, int, int]]) -> str:
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sequences(seed: int) -> list[list[int]]:
    rng = random.Random(seed)
    thue = [bin(i).count("1") & 1 for i in range(130)]
    a, fib = [0], [0, 1]
    while len(fib) < 130:
        a, fib = fib, fib + a
    out = [thue, fib, [7] * 60, [], [1]]
    for _ in range(40):
        n, k = rng.randrange(1, 150), rng.choice([1, 2, 3, 40])
        w = [rng.randrange(k) for _ in range(n)]
        at, p = rng.randrange(n), 1 + rng.randrange(n) // 4
        out.append([w[i] if i < at else w[at + (i - at) % p] for i in range(n)] if rng.random() < 0.6 else w)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("least", [4, 5, 12, 13])
def test_runs_equal_every_period_by_itself(least):
    docs = sequences(least)
    first = np.cumsum([0, *map(len, docs)])
    s, e, q = runs(mix64(np.array([x for d in docs for x in d], np.uint64)), first, least)
    of = np.searchsorted(first, s, side="right") - 1
    for k, d in enumerate(docs):
        got = [(int(a - first[k]), int(b - a), int(c)) for a, b, c in zip(s[of == k], e[of == k], q[of == k], strict=True)]
        assert got == plain_runs(d, least)


def test_long_texts_of_two_words_keep_their_structure():
    thue = np.array([bin(i).count("1") & 1 for i in range(1 << 14)], np.uint64)
    s, e, q = runs(mix64(thue), np.array([0, len(thue)]))
    assert len(s) and (e - s < 3 * q).all()  # no overlaps in this sequence
    values = mix64(np.arange(30_000, dtype=np.uint64) % np.uint64(777))
    assert [x.tolist() for x in runs(values, np.array([0, 30_000]))] == [[0], [30_000], [777]]


def test_words_of_a_long_text_by_blocks_equal_those_at_once(monkeypatch):
    import meritgrid.llm.arrowtext as at

    texts = pa.array([prose(1, 400), None, "x" * 900, "", prose(2, 300) + " ", " \n" + "y" * 500 + "\tz"])
    whole = words(*text_bytes(texts))
    monkeypatch.setattr(at, "BLOCK_BYTES", 97)
    blockwise = words(*text_bytes(texts))
    assert (whole[0] == blockwise[0]).all() and (whole[1] == blockwise[1]).all()


def test_query_equals_a_plain_version(spark, tmp_path):
    rows = [(i, prose(i, 1 + i * 7 % 90)) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "a b a b a b a b a b a b a"), (204, "A b a b a b a b a b a b a"), (205, "x " * 40 + prose(3, 20) + " y" * 12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert any(r["n_runs"] for i, r in got.items() if i < 150)
    for i, text in rows:
        w = (text or "").split()
        order = planted(i, len(w))
        w = w if order is None else [w[k] for k in order]
        found = plain_runs(w)
        r = got[i]
        best = min(found, key=lambda f: (-f[1], f[0], f[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, found).encode()).hexdigest()


def test_awkward_rows(spark):
    docs = table(spark).withColumnRenamed("key", "runs")
    out = find_runs(docs)
    assert out.columns == [*docs.columns, "runs_1", "collapsed"]
    assert out.count() == docs.count()
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert all(not r["runs_1"] and r["collapsed"] == "" for (i, t), r in got.items() if t is None or not t.strip())
    assert got[8, next(t for i, t in got if i == 8 and t.startswith("line"))]["runs_1"] == []
    assert find_runs(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        find_runs(docs, min_length=3)


def test_a_long_text_collapses(spark):
    text = prose(5, 150_000) + " the same five words here" * 20_000
    row = find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(row["runs"]) >= 1 and max(r["length"] for r in row["runs"]) >= 100_000
    assert len(row["collapsed"].split()) < 150_100
