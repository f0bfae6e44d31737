"""Compression classifier of text quality.

Two zstandard dictionaries are built, one from texts labelled good and one from texts labelled bad. A
text is cut into short blocks, each block is compressed with either dictionary, and the difference of the
two sizes over the text's length says which kind it resembles. A logistic curve, fitted on labelled texts
that neither dictionary has seen, turns the difference (and the good size itself, so that text that any
dictionary shrinks to nothing is told from prose) into a probability.

The model is fitted on a bounded sample of labelled rows: at most `docs_per_class` texts of either class,
those with the smallest hashes of their id, of at most `max_bytes` each. Scoring covers whole texts.

Defined results: a null text scores as an empty one; an empty text gets the curve's value at no difference
and a ratio of 1; rows are scored one by one, so ties and repeated rows are harmless and null ids or labels
only keep a row out of the sample; a document labelled both good and bad teaches neither; a name that is taken
gets a number; extra columns pass through; an empty table gives an empty result. If
either class has fewer than `MIN_DOCS` usable texts there is nothing to tell apart: every text then scores
the share of good labels, or 1.0 without any label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meritgrid.llm.arrowtext import slices
from meritgrid.llm.frames import free_name, modest_batches

BLOCK = 512
DICTIONARY_BYTES = 112_640
LEVEL = 3
MIN_DOCS = 8
THRESHOLD = 0.7


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


@dataclass(frozen=True)
class QualityModel:
    """Both dictionaries and the curve; without dictionaries every text scores `constant`."""

    good: bytes = b""
    bad: bytes = b""
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    constant: float = 1.0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), self.constant)
        z = (features(self.good, self.bad, texts) - np.array(self.mean)) / np.array(self.scale)
        return sigmoid(self.weights[0] + z @ np.array(self.weights[1:]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary; the texts themselves where there are too few of them to train one."""
    cut = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, cut).as_bytes()
    except zstandard.ZstdError:
        return b"".join(cut)[-DICTIONARY_BYTES:]


_compressors: dict[bytes, zstandard.ZstdCompressor] = {}


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """One per dictionary and worker process: preparing a dictionary costs more than a text."""
    if content not in _compressors:
        if len(_compressors) >= 8:
            _compressors.clear()
        prepared = zstandard.ZstdCompressionDict(content)
        prepared.precompute_compress(level=LEVEL)
        _compressors[content] = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=prepared, write_content_size=False, write_dict_id=False
        )
    return _compressors[content]


def features(good: bytes, bad: bytes, texts: list[bytes]) -> np.ndarray:
    by_good, by_bad = compressor(good).compress, compressor(bad).compress
    out = np.empty((len(texts), 2))
    for i, text in enumerate(texts):
        if not text:
            out[i] = 0.0, 1.0
            continue
        cut = blocks(text)
        g = sum([len(by_good(b)) for b in cut])
        out[i] = (sum([len(by_bad(b)) for b in cut]) - g) / len(text), g / len(text)
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps, halved while they do not help."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    ridge = 1e-3 * len(x) * np.eye(x.shape[1])

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + at @ ridge @ at / 2)

    for _ in range(60):
        p = sigmoid(x @ beta)
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge, x.T @ (weight * (p - y)) + ridge @ beta)
        before = loss(beta)
        while loss(beta - step) > before and np.abs(step).max() > 1e-9:
            step /= 2
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    docs_per_class: int = 1500,
    max_bytes: int = 65_536,
) -> QualityModel:
    """Fit on a bounded sample of the labelled rows: `docs_per_class` ids of either class travel, with one text each of
    `max_bytes` at most (of an id's several texts the least)."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")
    )
    usable = usable.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    totals = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.col("id")), F.col("id")
    ids = [
        (r["id"], y) for y in sorted(totals) for r in usable.where(F.col("y") == y).orderBy(*order).limit(docs_per_class).collect()
    ]
    constant = totals.get(1, 0) / sum(totals.values()) if totals else 1.0
    if not ids:
        return QualityModel(constant=constant)
    chosen = docs.sparkSession.createDataFrame(
        ids,
        T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("y", T.IntegerType())]),
    )
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
        .where(F.col("t").isNotNull() & (F.octet_length("t") > 0) & (F.octet_length("t") <= max_bytes))
        .join(F.broadcast(chosen), "id")
        .groupBy("id", "y")
        .agg(F.min("t").alias("t"))
        .collect()
    )
    rows.sort(key=lambda r: (r["y"], str(r["id"]), r["t"]))
    by_class = {y: list(dict.fromkeys(r["t"].encode() for r in rows if r["y"] == y)) for y in (0, 1)}
    if min(map(len, by_class.values())) < MIN_DOCS:
        return QualityModel(constant=constant)
    taught = {y: [t for i, t in enumerate(v) if i % 3] for y, v in by_class.items()}
    held = {y: v[::3] for y, v in by_class.items()}
    good, bad = dictionary(taught[1]), dictionary(taught[0])
    x = features(good, bad, held[1] + held[0])
    y = np.repeat([1.0, 0.0], [len(held[1]), len(held[0])])
    weight = np.repeat([totals[1] / len(held[1]), totals[0] / len(held[0])], [len(held[1]), len(held[0])])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    beta = logistic((x - mean) / scale, y, weight / weight.mean())
    return QualityModel(good, bad, tuple(mean), tuple(scale), tuple(beta), constant)


def score(docs: DataFrame, model: QualityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` and a column of scores from 0 to 1, higher for text like the good labels; map only, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, score_col = docs.columns.index(text_col), free_name(docs, score_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, text_col)):
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            made = pa.array(shared.value.scores(texts), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(score_col, T.DoubleType())]))


def learnable(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that a model may learn from: crc32 of the id as text modulo 4 is not 2."""
    return rows.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, learnable(labels))
    return score(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score at least the threshold; columns as they came."""
    modest_batches(spark)
    model = fit(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    name = free_name(docs, "score")
    return score(docs, model, score_col=name).where(F.col(name) >= THRESHOLD).drop(name)
