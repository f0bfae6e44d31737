"""Measures what tests do not assert, on a folder of tables: python -m tests.llm.measure DIR

Accuracy of op4 and op10 on held-out rows, recall of op7 and equality of op2 against brute force, bin fill of op8,
balance of op9, and how the copies that op2 finds fare in the pipeline. Prints one line each.
"""

from __future__ import annotations

import sys
import tempfile

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meritgrid.llm import embedding_dedup
from meritgrid.llm.best_fit_packing import CAPACITY
from meritgrid.llm.language_id import fit
from meritgrid.llm.quality_classifier import learnable
from meritgrid.llm.queries import QUERIES


def language(spark: SparkSession, d: str) -> str:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op4_language_id"](spark, d).where("held_out").join(docs, "doc_id").where("lang is not null")
    right, n = rows.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    model = fit(learnable(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")))
    return f"held-out texts in their language: {right} of {n}; of calibration texts rejected {model.lost:.4f} in their language, passed {model.passed:.4f} without it"


def quality(spark: SparkSession, d: str) -> str:
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality").where("quality is not null")
    rows = QUERIES["op10_quality_classifier"](spark, d).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    good, bad = (rows.score[rows.quality == q].to_numpy() for q in (1, 0))
    area = np.mean([(g > bad).mean() + (g == bad).mean() / 2 for g in good]) if len(good) and len(bad) else float("nan")
    return f"held-out labels right: {(rows.predicted == rows.quality).mean():.4f} of {len(rows)}, area under the curve {area:.4f}"


def embeddings(spark: SparkSession, d: str) -> str:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").where("label is not null").toPandas()
    there = 0
    for _, part in rows.groupby("label"):
        v = np.stack([np.asarray(x, np.float64) for x in part.embedding])
        v = v[np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)]
        unit = v / np.linalg.norm(v, axis=1)[:, None]
        there += sum(int((unit[i : i + 512] @ unit.T >= embedding_dedup.THRESHOLD).sum()) for i in range(0, len(unit), 512)) - len(unit)
    found = QUERIES["op7_embedding_dedup"](spark, d).agg(F.sum("n_links")).first()[0]
    return f"links found: {found} of {there}, recall {found / max(there, 1):.4f}"


def packing(spark: SparkSession, d: str) -> str:
    bins = QUERIES["op8_best_fit_packing"](spark, d).groupBy("bin_id").agg(F.sum("size").alias("s"))
    n, used = bins.agg(F.count(F.lit(1)), F.sum("s")).first()
    return f"bins: {n}, filled {used / (n * CAPACITY):.4f}; {-(-used // CAPACITY)} would hold the bytes"


def sharding(spark: SparkSession, d: str) -> str:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source")
    rows = QUERIES["op9_sharding"](spark, d).join(docs, "doc_id").groupBy("shard", "source").count().toPandas()
    spread = rows.groupby("source")["count"].agg(["min", "max"])
    return f"rows of a source in its fullest shard less those in its emptiest: at most {int((spread['max'] - spread['min']).max())}"


def copies(spark: SparkSession, d: str) -> str:
    import corpus_pipeline

    groups = QUERIES["op2_ngram_jaccard"](spark, d).where("doc_id <> component_id").select("doc_id").cache()
    kept = corpus_pipeline.run(spark, d).select("doc_id", "size").groupBy("doc_id").agg(F.sum("size").alias("size")).cache()
    left = kept.join(groups, "doc_id")
    n, bytes_ = left.agg(F.count(F.lit(1)), F.sum("size")).first()
    return f"copies that op2 finds: {groups.count()}; still rows after the pipeline: {n}, of {bytes_ or 0} of {kept.agg(F.sum('size')).first()[0]} bytes"


def main(d: str) -> None:
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", f"{folder}/local")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for measure in (language, quality, embeddings, packing, sharding, copies):
        print(f"{measure.__name__}: {measure(spark, d)}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
