"""Proportional stratified interleaving into shards.

Rows are shuffled by a seeded hash and ranked within their source; a row's fractional rank (rank - 1/2) /
rows of the source puts it on a line from 0 to 1 on which every source is spread evenly. The line is sorted
and cut into shards whose row counts differ by one at most, so every shard has the mixture of the whole.

Both ranks are exact and neither needs a source, or the table, in one task: rows fall into buckets of the
(uniform) hash or fraction, buckets are counted, running sums of the counts give every bucket its offset,
and rows are numbered inside their bucket only. Text is read for its length and checksum; what is shuffled
is a few numbers a row.

Defined results: a null source is a source of its own, null text has no bytes and checksum 0, and ids may be
null or repeat (ties fall to size, then checksum; rows that agree in all of these are interchangeable); an empty
table gives an empty result; other columns are not read, so they may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_ROWS = 500
MOST_BUCKETS = 100_000


def _number(rows: DataFrame, group: list[str], bucket: str, order: list[Column], name: str, total: str | None) -> DataFrame:
    """Numbers rows from 0 along (bucket, order) within `group`; `total` gets the group's size."""
    counts = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*group)
    offsets = counts.select(
        *group,
        bucket,
        (F.sum("_n").over(whole.orderBy(bucket)) - F.col("_n")).alias("_before"),
        *([F.sum("_n").over(whole).alias(total)] if total else []),
    )
    numbered = rows.withColumn("_i", F.row_number().over(W.partitionBy(*group, bucket).orderBy(*order)) - 1)
    return numbered.join(offsets, [*group, bucket]).withColumn(name, F.col("_before") + F.col("_i")).drop("_before", "_i", bucket)


def shard(
    docs: DataFrame,
    *,
    shards: int,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of `docs`: id, size, text_crc32, shard, slot (position in the shard from 0)."""
    n = docs.count()
    buckets = max(1, min(-(-n // BUCKET_ROWS), MOST_BUCKETS))
    unit = F.shiftrightunsigned(F.col("h"), 10) * F.lit(2.0**-53)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("s"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 1).alias("h"),
    ).withColumn("b", F.floor(unit * buckets))
    ties = [F.col(c) for c in ("h", "id", "size", "text_crc32")]
    ranked = _number(rows, ["s"], "b", ties, "rank", "of")
    spread = ranked.withColumn("f", (F.col("rank") + 0.5) / F.col("of")).withColumn("b", F.floor(F.col("f") * buckets))
    placed = _number(spread, [], "b", [F.col("f"), F.col("s"), *ties], "at", None)
    return placed.withColumn("shard", F.floor(F.col("at") * shards / F.lit(float(max(n, 1)))).cast("int")).select(
        "id", "size", "text_crc32", "shard", (F.col("at") - F.ceil(F.col("shard") * n / F.lit(float(shards)))).alias("slot")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return shard(docs, shards=24, seed=20_24).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
