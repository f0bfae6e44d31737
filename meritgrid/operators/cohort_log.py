"""A cohort's log of additions and removals as memberships in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meritgrid.functions.joins import days_in_spans


def memberships(log: DataFrame) -> DataFrame:
    """(cohort, uuid, since, until): stretches of membership out of (cohort, uuid, action, ts, entry_id), in order of time,
    then entry. A second addition and a removal of a non-member change nothing; a membership that was not ended has no
    `until`. Other actions are not looked at."""
    own = W.partitionBy("cohort", "uuid").orderBy("ts", "entry_id")
    acts = log.where(F.col("action").isin("add", "remove") & F.col("ts").isNotNull())
    turns = acts.withColumn("_before", F.coalesce(F.lag("action").over(own), F.lit("remove"))).where("action <> _before")
    spans = turns.withColumn("until", F.lead("ts").over(own)).where("action = 'add'")
    return spans.select("cohort", "uuid", F.col("ts").alias("since"), "until")


def members_on(spans: DataFrame, days: DataFrame) -> DataFrame:
    """(cohort, day, uuid): who is a member at the end of each asked (cohort, day)."""
    whole = spans.select("cohort", "uuid", F.to_date("since").alias("first_day"), F.date_sub(F.to_date("until"), 1).alias("last_day"))
    whole = whole.where("last_day is null or last_day >= first_day")
    return days_in_spans(days, whole, ["cohort"]).select("cohort", "day", "uuid").distinct()


def log_of(log: DataFrame, *, cohort: str | None = None, uuid: str | None = None, reason: str | None = None,
    since: Column | None = None) -> DataFrame:
    """Entries of a cohort, a candidate or for a reason, from a time on; the filters reach the scan. In order of time,
    ties by entry."""
    out = log
    for name, value in (("cohort", cohort), ("uuid", uuid), ("reason", reason)):
        out = out if value is None else out.where(F.col(name) == value)
    out = out if since is None else out.where(F.col("ts") >= since)
    return out.orderBy("ts", "entry_id")


def daily_summary(log: DataFrame) -> DataFrame:
    """(cohort, day, added, removed, net, reasons): a day's entries; `reasons` counts each."""
    day = F.to_date("ts").alias("day")
    counts = log.groupBy("cohort", day).agg(F.count_if(F.col("action") == "add").alias("added"),
        F.count_if(F.col("action") == "remove").alias("removed"))
    reasons = log.groupBy("cohort", day, "reason").agg(F.count(F.lit(1)).alias("n")).where("reason is not null")
    listed = reasons.groupBy("cohort", "day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    return counts.withColumn("net", F.col("added") - F.col("removed")).join(listed, ["cohort", "day"], "left")
