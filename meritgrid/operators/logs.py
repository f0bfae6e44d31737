"""Logs and snapshots on disk, a partition a day, and what is read out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A fall of recall that is told, the recall that is asked for, a year of weekly snapshots, shares of an
# archetype's artifacts that have to be there.
RECALL_DROP, RECALL_GOAL = 0.05, 0.80
YEAR_OF_WEEKS = 52
ARCHETYPE_SHARE = 0.95


class DayLog:
    """Rows below a path with a partition a day of their time. Rows without a time or key are not kept."""

    def __init__(self, spark: SparkSession, path: str, schema: str, time: str, keys: list[str]):
        self.spark, self.path, self.schema, self.time, self.keys = spark, path, schema, time, keys

    def _there(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def read(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """All rows, or those of the days from `since` to `until`; other days are not opened."""
        schema = f"{self.schema}, _day date"
        rows = self.spark.read.schema(schema).parquet(self.path) if self._there() else self.spark.createDataFrame([], schema)
        for day, test in ((since, F.col("_day") >= F.lit(since).cast("date")), (until, F.col("_day") <= F.lit(until).cast("date"))):
            rows = rows if day is None else rows.where(test)
        return rows.drop("_day")

    def _own(self, rows: DataFrame) -> DataFrame:
        known = rows.where(F.col(self.time).isNotNull())
        for k in self.keys:
            known = known.where(F.col(k).isNotNull())
        return known.withColumn("_day", F.to_date(self.time)).dropDuplicates(["_day", *self.keys])

    def _stored(self, new: DataFrame) -> DataFrame:
        days = [r["_day"] for r in new.select("_day").distinct().collect()]
        return self.spark.read.schema(f"{self.schema}, _day date").parquet(self.path).where(F.col("_day").isin(days))

    def append(self, rows: DataFrame) -> None:
        """Adds rows whose keys the same days do not have yet, so a batch that comes again adds nothing."""
        new = self._own(rows)
        if self._there():
            new = new.join(self._stored(new).select("_day", *self.keys), ["_day", *self.keys], "left_anti")
        new.repartition("_day").write.mode("append").partitionBy("_day").parquet(self.path)

    def put(self, rows: DataFrame) -> None:
        """Adds rows and replaces those of the same day and keys; only the days of the new rows are rewritten."""
        new = self._own(rows)
        if self._there():
            kept = self._stored(new).join(new.select("_day", *self.keys), ["_day", *self.keys], "left_anti")
            new = new.unionByName(kept.select(*new.columns))
        new.repartition("_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_day").parquet(self.path)


def recall_trend(results: DataFrame, now: Column, before: Column) -> DataFrame:
    """(query, now, before, delta, alert) of the queries that have a recall (query, run_date, recall) on both days."""
    on = lambda day, name: results.where(F.col("run_date") == day).select("query", F.col("recall").alias(name))
    both = on(now, "now").join(on(before, "before"), "query")
    delta = F.col("now") - F.col("before")
    return both.withColumn("delta", F.round(delta, 6)).withColumn("alert", F.round(delta, 9) < -RECALL_DROP)


def recall_passes(results: DataFrame, goal: float = RECALL_GOAL) -> DataFrame:
    """(run_date, mean_recall, passes): whether the mean over a day's queries reaches the goal."""
    mean = results.where("recall is not null").groupBy("run_date").agg(F.round(F.avg("recall"), 9).alias("mean_recall"))
    return mean.withColumn("passes", F.col("mean_recall") >= goal)


def latest_snapshots(snapshots: DataFrame, key: str, day: str, limit: int = YEAR_OF_WEEKS) -> DataFrame:
    """Each key's most recent snapshots, with their place, the latest first."""
    return snapshots.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc(day)))).where(F.col("place") <= limit)


def archetype_coverage(archetypes: DataFrame, artifacts: DataFrame, share: float = ARCHETYPE_SHARE) -> DataFrame:
    """(archetype_id, expected, found, coverage, missing, passes): which of an archetype's artifacts (pmids, nct_ids,
    grant_ids) are among the stored (type, id). One that expects nothing has a coverage of 1; out of scope ones pass."""
    kinds = (("pmid", "pmids"), ("nct_id", "nct_ids"), ("grant_id", "grant_ids"))

    def named(kind: str, column: str) -> Column:
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("id")))

    one = [named(*k) for k in kinds]
    long = archetypes.select("archetype_id", F.explode(F.concat(*one)).alias("a")).select("archetype_id", "a.*").distinct()
    seen = long.join(artifacts.select("type", "id").distinct().withColumn("_is", F.lit(True)), ["type", "id"], "left")
    counted = seen.groupBy("archetype_id").agg(
        F.count(F.lit(1)).alias("expected"), F.count("_is").alias("found"),
        F.array_sort(F.collect_list(F.when(F.col("_is").isNull(), F.concat_ws(":", "type", "id")))).alias("missing"),
    )
    joined = archetypes.select("archetype_id", "in_scope").join(counted, "archetype_id", "left")
    expected, found = F.coalesce("expected", F.lit(0)), F.coalesce("found", F.lit(0))
    coverage = F.when(expected == 0, 1.0).otherwise(found / expected)
    return joined.select(
        "archetype_id", expected.alias("expected"), found.alias("found"), F.round(coverage, 6).alias("coverage"),
        F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), (~F.coalesce("in_scope",
            F.lit(True)) | (coverage >= share)).alias("passes"),
    )


def gate_totals(decided: DataFrame) -> DataFrame:
    """One row over a gate's decisions: checked, and how many had each of them."""
    names = {"allowed": "allowed", "rejected_phi": "rejected_phi", "stripped": "stripped", "excluded_opt_out": "excluded_opt_out"}
    return decided.agg(F.count(F.lit(1)).alias("checked"), *(F.count_if(F.col("decision") == d).alias(n) for d, n in names.items()))


def stripped_fields(rows: DataFrame, blocked: list[str]) -> DataFrame:
    """(field, n): in how many rows each field that is not to be kept has a value."""
    if not blocked:
        return rows.sparkSession.createDataFrame([], "field string, n long")
    counts = rows.agg(*(F.count(c).alias(c) for c in blocked))
    return counts.select(F.explode(F.create_map(*(x for c in blocked for x in (F.lit(c), F.col(c))))).alias("field", "n"))


def trails(candidates: DataFrame, parts: dict[str, tuple[DataFrame, str]], most: int = 1000) -> DataFrame:
    """`candidates` (uuid, ...) with an array of structs for each of `parts`, name: (rows with uuid, column of order), the
    latest first, and `n_<name>`, how many there are. Of more than `most` rows the latest are shown: this is a view."""
    out = candidates
    for name, (rows, order) in parts.items():
        own = [c for c in rows.columns if c != "uuid"]
        place = F.row_number().over(W.partitionBy("uuid").orderBy(F.desc_nulls_last(order), *own))
        counts = rows.groupBy("uuid").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        shown = rows.withColumn("_p", place).where(F.col("_p") <= most)
        listed = shown.groupBy("uuid").agg(F.array_sort(F.collect_list(F.struct("_p", F.struct(*own).alias("row")))).alias("_l"))
        listed = listed.select("uuid", F.transform("_l", lambda x: x["row"]).alias(name))
        empty = F.array().cast(listed.schema[name].dataType)
        out = out.join(counts, "uuid", "left").join(listed, "uuid", "left")
        out = out.withColumns({f"n_{name}": F.coalesce(f"n_{name}", F.lit(0)), name: F.coalesce(name, empty)})
    return out
