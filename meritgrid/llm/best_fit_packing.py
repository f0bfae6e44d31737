"""Conflict-constrained best-fit packing of documents into bins of a fixed size.

Two documents conflict when they share a source or a cluster of duplicates; no bin holds two that conflict.
Bins are kept in order of their residual space and carry bitmaps of the sources and clusters in them. A
document, larger ones first, goes to the tightest bin that has room and shares no bit: the search starts at
the smallest residual that fits and moves on to the next until a bin is compatible, or opens a new bin.

A text of more than `capacity` bytes is cut: every full piece fills a bin alone, the rest is packed. An empty
text has nothing that could conflict. Bitmaps are exact, not hashed: each group numbers its own sources, and
the clusters that occur in it more than once, and uses as many 64-bit words as it needs.

Documents are dealt by a hash of id and text into groups of about `group_docs`, each packed in one task: the
group has the same size however large the table or one source is, only ids and sizes travel, and each group
leaves at most a few bins unfilled.

Defined results: null text counts as empty, a null source or cluster conflicts with nothing, rows with equal
ids are packed like any others, equal sizes are taken in order of id, an empty table gives no rows, and other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPACITY = 8192
GROUP_DOCS = 8192
STRIDE = 64


def _bits(keys: np.ndarray, shared_only: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Word and bit of each key (null and, if asked, single keys: word 0 and no bit), and the number of words."""
    codes, _ = pd.factorize(keys)
    if shared_only and len(codes):
        counts = np.bincount(codes[codes >= 0], minlength=1) if (codes >= 0).any() else np.zeros(1, int)
        lone = (codes >= 0) & (counts[np.maximum(codes, 0)] < 2)
        codes = np.where(lone, -1, codes)
        left, codes[codes >= 0] = np.unique(codes[codes >= 0], return_inverse=True)
    bit = np.where(codes >= 0, np.uint64(1) << (np.maximum(codes, 0) % 64).astype(np.uint64), np.uint64(0))
    return np.maximum(codes, 0) // 64, bit.astype(np.uint64), int(codes.max(initial=0)) // 64 + 1


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and its offset there; items come in the order in which they are packed."""
    n = len(sizes)
    sw, sb, s_words = _bits(sources, False)
    cw, cb, c_words = _bits(clusters, True)
    in_source, in_cluster = np.zeros((s_words, n), np.uint64), np.zeros((c_words, n), np.uint64)
    residual, order = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_bins = made = 0
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(n):
        size, sources_of, clusters_of = sizes[k], in_source[sw[k]], in_cluster[cw[k]]
        at, found, stride = int(np.searchsorted(residual[:open_bins], size)), -1, STRIDE
        while at < open_bins:
            here = order[at : min(at + stride, open_bins)]
            free = ((sources_of[here] & sb[k]) | (clusters_of[here] & cb[k])) == 0
            first = int(free.argmax())
            if free[first]:
                found = at + first
                break
            at, stride = at + stride, stride * 4
        if found >= 0:
            target, left = order[found], residual[found]
            residual[found : open_bins - 1] = residual[found + 1 : open_bins].copy()
            order[found : open_bins - 1] = order[found + 1 : open_bins].copy()
            open_bins -= 1
        else:
            target, left = made, capacity
            made += 1
        bins[k], offsets[k] = target, capacity - left
        sources_of[target] |= sb[k]
        clusters_of[target] |= cb[k]
        left -= size
        if left > 0:
            at = int(np.searchsorted(residual[:open_bins], left))
            residual[at + 1 : open_bins + 1] = residual[at:open_bins].copy()
            order[at + 1 : open_bins + 1] = order[at:open_bins].copy()
            residual[at], order[at] = left, target
            open_bins += 1
    return bins, offsets


def pack(
    docs: DataFrame,
    *,
    capacity: int = CAPACITY,
    group_docs: int = GROUP_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
) -> DataFrame:
    """One row per piece: id, piece, start (byte of the text), size, bin_id, bin_offset.

    Without `cluster_col` equal texts are the clusters.
    """
    groups = max(1, -(-docs.count() // group_docs))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.xxhash64(F.col(text_col)).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"),
        size.alias("size"),
        F.when(size > 0, F.col(source_col).cast("string")).alias("source"),
        F.when(size > 0, cluster).alias("cluster"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit(8), F.col(text_col)), F.lit(groups)).alias("grp"),
    )
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, piece long, start long, size long, bin_id long, bin_offset long"

    def run(table: pa.Table) -> pa.Table:
        grp, sizes = table["grp"][0].as_py(), table["size"].to_numpy()
        full, rest = sizes // capacity, sizes % capacity
        by = pa.table({"rest": rest, "id": table["id"]})
        taken = pc.sort_indices(by, sort_keys=[("rest", "descending"), ("id", "ascending")]).to_numpy().astype(np.int64)
        taken = taken[(rest[taken] > 0) | (sizes[taken] == 0)]
        source, cluster = (np.array(table[c].to_pylist(), dtype=object) for c in ("source", "cluster"))
        bins, offsets = best_fit(rest[taken], source[taken], cluster[taken], capacity)
        whole = np.repeat(np.arange(len(sizes)), full)
        number = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        row, piece = np.concatenate([taken, whole]), np.concatenate([full[taken], number])
        return pa.table(
            {
                "id": table["id"].take(pa.array(row)),
                "piece": piece,
                "start": piece * capacity,
                "size": np.concatenate([rest[taken], np.full(len(whole), capacity)]),
                "bin_id": (grp << 32) + np.concatenate([bins, bins.max(initial=-1) + 1 + np.arange(len(whole))]),
                "bin_offset": np.concatenate([offsets, np.zeros(len(whole), np.int64)]),
            }
        )

    return rows.groupBy("grp").applyInArrow(run, schema)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return pack(docs).withColumnRenamed("id", "doc_id")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: where every piece of every document goes."""
    return pack(docs).withColumnRenamed("id", "doc_id")
