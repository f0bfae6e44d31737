"""Language-model scores by stupid backoff, computed relationally.

The n-grams of all documents are counted over the whole table and joined back to the documents, where each word
scores log(count of the longest known n-gram that ends there / count of its first n - 1 words), less `BACKOFF`
for every shorter n-gram that had to be tried. A document's own n-grams do not vouch for it: all counts are those
of the other documents, exactly (the table's less its own), and an n-gram is known if another document has it.
A single word scores its count over the number of all words of the others; one that nobody else has counts as
seen once. A document's sum is over its words, its score the sum over their number, so that documents of any
length compare. Words are runs of bytes other than ASCII white space, A-Z in lower case; n-grams are 64-bit hashes
and do not cross documents.

The plan is that of a count query joined to its own rows: partial counts by group of documents, a shuffle by hash
partition of the n-gram, totals, a shuffle back by group, sums by document. What differs is the row: a row for each
of some hundred million n-grams a GB would be a dozen times the input in either shuffle, so a row is a block, the
sorted distinct n-grams of one order that one group has in one partition, as compressed differences with their
counts. Adding up blocks, and looking up a word's n-gram in its group's blocks, is array work and done in numpy
(`_answers`, `Group`); which blocks meet is left to Spark.

A group takes texts of `group_bytes` in all. By default that is the root of the table's size times a constant, not
under 8 MB, and there are as many partitions as groups: blocks then keep some hundred n-grams, and groups times
partitions stays in proportion to the table (100 TB: 500,000 groups of 200 MB). A text over that size is a group of
its own. A frequent n-gram or a hot source is one entry of a group's block.

Defined results: null and empty texts have no words, and sum and score 0; a single document has nobody to vouch
for it, each word counts as seen once among none; rows with equal ids are scored one by one, and vouch for each
other; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgrid.llm.arrowtext import SPACE, mix64, slices, text_bytes, words
from meritgrid.llm.frames import modest_batches

ORDER = 3
BACKOFF = float(np.log(0.4))
#: Texts of a group: at least so many bytes, and the root of the table's bytes times so many.
GROUP_BYTES, GROUP_GROWTH = 8 << 20, 400


def _shrink(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def _grow(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed(values: np.ndarray) -> bytes:
    """A sorted array of hashes as compressed differences, byte by byte."""
    rises = np.diff(values, prepend=np.uint64(0))
    return _shrink(rises.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    rises = np.frombuffer(_grow(data), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
    return np.cumsum(rises, dtype=np.uint64)


def numbers(values: np.ndarray) -> bytes:
    return _shrink(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes())


def unnumbers(data: bytes) -> np.ndarray:
    return np.frombuffer(_grow(data), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, docs): the ids and texts of one group out of a few megabytes of rows, compressed."""
    for whole in batches:
        for batch in slices(whole, "t"):
            ids, texts, groups = (c.to_pylist() for c in batch.columns)
            by: dict[int, list[int]] = {}
            for i, g in enumerate(groups):
                by.setdefault(g, []).append(i)
            blobs = [_shrink(pickle.dumps([(ids[i], texts[i]) for i in rows]), 3) for rows in by.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int64()), pa.array(blobs, pa.binary())], ["grp", "docs"])


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts and each text's first, a megabyte of text at a time."""
    found, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for part in slices(pa.record_batch({"t": pa.array(texts, pa.large_string())}), "t"):
        hashes, first = words(*text_bytes(part.column(0)))
        found.append(hashes)
        sizes.append(np.diff(first))
    return np.concatenate(found), np.cumsum(np.concatenate(sizes))


class Group:
    """The n-grams of a group of documents, an order at a time: `keys` are the distinct ones, `counts` how often each
    occurs, `at` which of them ends at each word (-1 where the document has fewer words so far) and `own` how often the
    word's document has it."""

    def __init__(self, blobs: list[bytes]):
        docs = [d for b in blobs for d in pickle.loads(_grow(b))]
        self.ids = [i for i, _ in docs]
        self.hashes, self.first = _words([t or "" for _, t in docs])
        self.doc = np.repeat(np.arange(len(docs), dtype=np.int32), np.diff(self.first))
        self.place = (np.arange(len(self.hashes)) - self.first[self.doc]).astype(np.int32)

    def orders(self, order: int, located: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """(keys, counts) of each order, and (at, own) if `located`."""
        gram = mix64(self.hashes)
        for k in range(order):
            if k:
                before = np.zeros_like(gram)
                before[1:] = gram[:-1]
                gram = mix64(before * np.uint64(0x9E3779B97F4A7C15) + self.hashes + np.uint64(k))
            valid = np.flatnonzero(self.place >= k)
            if not located:
                yield np.unique(gram[valid], return_counts=True)
                continue
            keys, inverse, counts = np.unique(gram[valid], return_inverse=True, return_counts=True)
            at, own = np.full(len(gram), -1, np.int32), np.ones(len(gram), np.int32)
            at[valid] = inverse
            again = valid[counts[inverse] > 1]
            pairs = at[again].astype(np.int64) * len(self.ids) + self.doc[again]
            _, which, times = np.unique(pairs, return_inverse=True, return_counts=True)
            own[again] = times[which]
            yield keys, counts, at, own

    def scores(self, totals: list[np.ndarray], all_words: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of words of each document and the sum of its words' scores."""
        n = np.diff(self.first)
        if not len(self.hashes):
            return n, np.zeros(len(n))
        rest = np.log(np.maximum(all_words - n, 1))[self.doc]
        value, context = -rest, np.zeros(0)
        for k, (_, _, at, own) in enumerate(self.orders(len(totals), True)):
            others = np.where(at >= 0, totals[k].astype(np.int64)[at] - own, 0)
            log = np.log(np.maximum(others, 1))
            if k == 0:
                value += log
            else:
                known = np.flatnonzero(others > 0)
                value[(at >= 0) & (others <= 0)] += BACKOFF
                value[known] = log[known] - context[known - 1]
            context = log
        return n, np.bincount(self.doc, value, len(n))


def _bounds(parts: int) -> np.ndarray:
    """The least hash of each partition but the first."""
    return np.arange(1, parts, dtype=np.uint64) * np.uint64((2**64 - 1) // parts)


_REQUEST = [("part", pa.int64()), ("grp", pa.int64()), ("k", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]


def _requests(parts: int, order: int):
    """Rows (part, grp, k, keys, counts) of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(parts)

        def asked(grp: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            for k, (keys, counts) in enumerate(Group(blobs).orders(order, False)):
                cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
                used = np.flatnonzero(np.diff(cuts)).tolist()
                for some in (used[i : i + 512] for i in range(0, len(used), 512)):
                    blocks = [packed(keys[cuts[p] : cuts[p + 1]]) for p in some], [numbers(counts[cuts[p] : cuts[p + 1]]) for p in some]
                    columns = [some, [grp] * len(some), [k] * len(some), *blocks]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _REQUEST, strict=True)], [n for n, _ in _REQUEST])

        now, blobs = None, []
        for batch in batches:
            for grp, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if grp != now and blobs:
                    yield from asked(now, blobs)
                    blobs = []
                now = grp
                blobs.append(blob)
        if blobs:
            yield from asked(now, blobs)

    return run


def _answers(table: pa.Table) -> pa.Table:
    """Totals over all groups of the n-grams of one partition and order, for each request in its order."""
    keys = [unpacked(x.as_py()) for x in table["keys"]]
    counts = np.concatenate([unnumbers(x.as_py()) for x in table["counts"]])
    sizes = np.cumsum([len(x) for x in keys])[:-1]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(inverse, counts).astype(np.int64)[inverse]
    blocks = pa.array([numbers(x) for x in np.split(totals, sizes)], pa.binary())
    return pa.table([table["grp"], table["k"], table["part"], blocks], ["grp", "k", "part", "totals"])


def _scored(order: int, all_words: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        g = Group(docs["docs"].to_pylist())
        place = sorted(zip(answers["k"].to_pylist(), answers["part"].to_pylist(), range(answers.num_rows), strict=True))
        totals = [np.concatenate([np.zeros(0, np.uint64), *(unnumbers(answers["totals"][i].as_py()) for o, _, i in place if o == k)]) for k in range(order)]
        n, total = g.scores(totals, all_words)
        return pa.table([pa.array(g.ids, pa.int64()), pa.array(n, pa.int64()), pa.array(total, pa.float64())], ["id", "n_words", "total"])

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for whole in batches:
        for batch in slices(whole, "t"):
            raw, offsets = text_bytes(batch.column(0))
            begins = ~SPACE[raw]
            begins[1:] &= SPACE[raw[:-1]]
            edges = offsets[1:-1]
            edges = edges[(edges < len(raw)) & (edges > 0)]
            edges = np.unique(edges)
            total += int(begins.sum()) + int((~SPACE[raw[edges]] & ~SPACE[raw[edges - 1]]).sum())
    yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])


def backoff_scores(
    docs: DataFrame,
    *,
    order: int = ORDER,
    group_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: id, n_words, total (sum of natural logarithms), score (total per word)."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    all_bytes = plain.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    all_words = plain.select("t").mapInArrow(_word_counts, "n long").agg(F.sum("n")).first()[0] or 0
    size = group_bytes or max(GROUP_BYTES, int((GROUP_GROWTH * all_bytes) ** 0.5))
    groups = max(1, -(-all_bytes // size))
    h = F.xxhash64("id", "t", F.lit(3))  # ids may be null, or the same in many rows
    own_group = -1 - h.bitwiseAND(F.lit(2**62 - 1))
    grp = F.when(F.octet_length("t") > size, own_group).otherwise(F.pmod(h, F.lit(groups))).alias("grp")
    chunks = plain.select("id", "t", grp).mapInArrow(_chunks, "grp long, docs binary").repartition("grp")
    requests = chunks.sortWithinPartitions("grp").mapInArrow(_requests(groups, order), "part long, grp long, k int, keys binary, counts binary")
    answers = requests.groupBy("part", "k").applyInArrow(_answers, "grp long, k int, part long, totals binary")
    scored = chunks.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_scored(order, all_words), "id long, n_words long, total double")
    return scored.select("id", "n_words", "total", (F.col("total") / F.greatest("n_words", F.lit(1))).alias("score"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return backoff_scores(docs).select(F.col("id").alias("doc_id"), "n_words", F.round("total", 4).alias("total"), F.round("score", 6).alias("score"))
