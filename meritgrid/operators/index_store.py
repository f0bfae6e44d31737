"""An inverted index on disk: terms to ids, in buckets that are read and rewritten one by one.

Entries are dealt by a hash of their term into buckets, each a partition of the table with its rows in order of terms.
A lookup names its buckets in the filter, so others are not opened, and within one the files' statistics leave out row
groups. A change rewrites the buckets of the terms that came or went and leaves every other file as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class StoredIndex:
    """(term, uuid) below a path, in so many buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _write(self, entries: DataFrame, mode: str) -> None:
        dealt = entries.where("term is not null and uuid is not null").distinct().withColumn("bucket", bucket(F.col("term"), self.buckets))
        ordered = dealt.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "term", "uuid")
        ordered.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(self.path)

    def build(self, entries: DataFrame) -> None:
        """Writes the index anew out of (term, uuid)."""
        self._write(entries.select("term", "uuid"), "static")

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def lookup(self, terms: Sequence[str]) -> DataFrame:
        """(term, uuid) of some terms; only their buckets are read."""
        wanted = self.spark.range(1).select(F.array_distinct(F.array(*(bucket(F.lit(t),
            self.buckets) for t in terms))).alias("b")).first()["b"] if terms else []
        return self.entries().where(F.col("bucket").isin(wanted) & F.col("term").isin(list(terms))).select("term", "uuid")

    def join(self, queries: DataFrame, term: str = "term") -> DataFrame:
        """Rows of `queries` with the uuids of their terms, for any number of queries."""
        asked = queries.withColumn("bucket", bucket(F.col(term), self.buckets)).withColumnRenamed(term, "term")
        return asked.join(self.entries(), ["bucket", "term"]).drop("bucket")

    def upsert(self, before: DataFrame, after: DataFrame) -> None:
        """Replaces the entries (term, uuid) of the people in `before` by those in `after`; people in neither stay."""
        old, new = before.select("term", "uuid"), after.select("term", "uuid")
        gone, come = old.join(new, ["term", "uuid"], "left_anti"), new.join(old, ["term", "uuid"], "left_anti")
        touched = [r["bucket"] for r in gone.unionByName(come).where("term is not null").select(bucket(F.col("term"),
            self.buckets).alias("bucket")).distinct().collect()]
        if not touched:
            return
        kept = self.entries().where(F.col("bucket").isin(touched)).select("term", "uuid").join(gone, ["term", "uuid"], "left_anti")
        after_all = kept.unionByName(come.where(bucket(F.col("term"), self.buckets).isin(touched)))
        filled = after_all.where("term is not null and uuid is not null").distinct().withColumn("bucket", bucket(F.col("term"), self.buckets))
        emptied = set(touched) - {r["bucket"] for r in filled.select("bucket").distinct().collect()}
        self._write(after_all, "dynamic")
        for b in emptied:  # a bucket without rows is not written, so its files have to go
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
