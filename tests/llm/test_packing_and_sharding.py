from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from meritgrid.llm.best_fit_packing import best_fit, pack
from meritgrid.llm.sharding import shard
from tests.llm.cases import awkward, empty, prose, table


def plain_best_fit(sizes, sources, clusters, capacity):
    bins = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        fits = [b for b in bins if b["left"] >= size and b["left"] > 0 and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        if fits:
            target = min(fits, key=lambda b: b["left"])
        else:
            bins.append(target := {"left": capacity, "s": set(), "c": set()})
        target["left"] -= size
        target["s"].add(source)
        target["c"].add(cluster)
    return sorted(b["left"] for b in bins)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_leaves_what_plain_best_fit_leaves(seed):
    rng = np.random.default_rng(seed)
    n, capacity = 400, 1000
    sizes = np.sort(rng.choice(np.arange(1, 1000), n, replace=False))[::-1].astype(np.int64)
    sources = np.array([None if x == 0 else f"s{x}" for x in rng.integers(0, 90 if seed % 2 else 3, n)], dtype=object)
    clusters = np.array([f"c{x}" for x in rng.integers(0, 200, n)], dtype=object)
    bins, offsets = best_fit(sizes, sources, clusters, capacity)
    left = sorted(capacity - int(sizes[bins == b].sum()) for b in range(bins.max() + 1))
    assert min(left) >= 0
    for b in range(bins.max() + 1):
        for keys in (sources, clusters):
            held = [k for k in keys[bins == b] if k is not None]
            assert len(held) == len(set(held))
        at = np.argsort(offsets[bins == b])
        assert (offsets[bins == b][at] == np.concatenate([[0], np.cumsum(sizes[bins == b][at])[:-1]])).all()
    assert len(left) == len(plain_best_fit(sizes.tolist(), sources.tolist(), clusters.tolist(), capacity))


def test_pack_awkward_rows(spark):
    rows = pack(table(spark), capacity=512).collect()
    pieces = Counter()
    for r in rows:
        pieces[r["id"]] += r["size"]
    want = Counter()
    for doc, text, *_ in awkward():
        want[doc] += len((text or "").encode())
    assert pieces == want and set(pieces) | {d for d, s in want.items() if not s} == set(want)
    held = Counter()
    for r in rows:
        held[r["bin_id"]] += r["size"]
    assert max(held.values()) <= 512
    assert len({r["id"] for r in rows}) == len({r[0] for r in awkward()})
    assert pack(empty(spark)).count() == 0


def test_shards_match_the_mixture(spark):
    rows = [(i, prose(i, i % 30), None if i % 50 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = shard(df, shards=7, seed=1).collect()
    assert sorted(r["id"] for r in out) == list(range(1200))
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    counts = [len(v) for v in by.values()]
    assert len(by) == 7 and max(counts) - min(counts) <= 1
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    source = {i: s for i, _, s in rows}
    for s, n in Counter(source.values()).items():
        for v in by.values():
            assert abs(sum(source[r["id"]] == s for r in v) - n / 7) <= 2
    text = {i: t.encode() for i, t, _ in rows}
    assert all(r["text_crc32"] == zlib.crc32(text[r["id"]]) and r["size"] == len(text[r["id"]]) + 8 for r in out)
    assert sorted(map(tuple, shard(df.repartition(5), shards=7, seed=1).collect())) == sorted(map(tuple, out))


def plain_shards(rows, shards, seed):
    """Rank by seeded hash within the source, sort by fractional rank, cut."""

    def order(row):
        doc, text, source = row
        h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), seed=42)
        if doc is not None:
            h = xxhash.xxh64_intdigest(doc.to_bytes(8, "little", signed=True), seed=h)
        body = (text or "").encode()
        return h >> 1, (doc is not None, doc or 0), len(body) + 8, zlib.crc32(body)

    by: dict[str, list] = {}
    for row in rows:
        by.setdefault("" if row[2] is None else f"={row[2]}", []).append(row)
    line = []
    for source, own in by.items():
        own.sort(key=order)
        line += [((i + 0.5) / len(own), source, order(row), row[0]) for i, row in enumerate(own)]
    line.sort(key=lambda x: x[:3])
    n, out = len(line), []
    for at, (_, _, (_, _, size, crc), doc) in enumerate(line):
        shard_of = at * shards // n
        out.append((doc, size, crc, shard_of, at - -(-shard_of * n // shards)))
    return out


@pytest.mark.parametrize(("n", "shards", "seed"), [(1200, 7, 1), (1000, 24, 2024), (5, 24, 0)])
def test_shards_against_plain_ranks(spark, n, shards, seed):
    rows = [(i, prose(i, i % 30), None if i % 50 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(n)]
    rows += [(7, "again", "hot"), (7, "again", "hot"), (7, "other", "hot"), (8, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, shard(df, shards=shards, seed=seed).collect()), key=key) == sorted(plain_shards(rows, shards, seed), key=key)


def test_shard_awkward_rows(spark):
    out = shard(table(spark), shards=3).collect()
    assert len(out) == len(awkward()) and {r["size"] for r in out if r["id"] == 2} == {8}
    assert shard(empty(spark), shards=3).count() == 0
