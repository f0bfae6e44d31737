"""From raw documents to packed training sequences, in five stages.

Each stage is written as Parquet into the session's shared folder and read again before the next, so a lost
executor repeats a stage's tasks, not the pipeline; a stage's table goes once the next one is written. All stages
but the last return the columns of `documents`. A document that loses all its lines to earlier ones goes with them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meritgrid.llm.best_fit_packing import packing_stage
from meritgrid.llm.components import shared_folder
from meritgrid.llm.language_id import language_stage
from meritgrid.llm.line_dedup import line_stage
from meritgrid.llm.ngram_jaccard import jaccard_stage
from meritgrid.llm.quality_classifier import quality_stage

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", jaccard_stage),
    ("best_fit_packing", packing_stage),
]

#: No SQL: compression by dictionaries and the language models have none.
ORACLE_SQL: str | None = None


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole `documents` table."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return docs
