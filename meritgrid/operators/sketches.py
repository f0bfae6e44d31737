"""Rolling quantiles out of one mergeable sketch a day and key.

A day's requests become a row with counts and a sketch of a few kilobytes. A window of days is the merged sketches of
its days, so a new day is read once, and old requests never again. The exact path (`monitoring.service_levels`) stays;
with `SIZE` entries a level the rank of a quantile is off by less than a hundredth, with odds of 99 in 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritgrid.operators.monitoring import SLO_SUCCESS

SIZE, DAYS = 400, 30


def daily_sketches(rows: DataFrame, *keys: str, time: str = "ts", value: str = "latency", success: str | None = "success") -> DataFrame:
    """(day, keys, n, fails, sketch) of each day's values; rows without a value count in n and fails only."""
    fails = F.count_if(~F.col(success)) if success else F.lit(0).cast("long")
    return rows.groupBy(F.to_date(time).alias("day"), *keys).agg(
        F.count(F.lit(1)).alias("n"), fails.alias("fails"), F.kll_sketch_agg_double(F.col(value).cast("double"), SIZE).alias("sketch")
    )


def with_days(kept: DataFrame, new: DataFrame) -> DataFrame:
    """Kept sketches and those of new days; a day that comes again replaces what is kept of it."""
    return kept.join(new.select("day").distinct(), "day", "left_anti").unionByName(new)


def rolling(sketches: DataFrame, days: DataFrame, *keys: str, window: int = DAYS, points: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """(day, keys, requests, fails, p95, p99, success_rate, budget_used_pct) of the `window` days up to each asked day."""
    asked = days.select(F.col("day").alias("_day")).distinct()
    dates = F.explode(F.sequence(F.col("_day"), F.date_sub("_day", window - 1), F.expr("interval -1 day")))
    merged = sketches.join(asked.select("_day", dates.alias("day")), "day").groupBy(F.col("_day").alias("day"), *keys).agg(
        F.sum("n").alias("requests"), F.sum("fails").alias("fails"), F.kll_merge_agg_double("sketch", SIZE).alias("s")
    )
    known = F.kll_sketch_get_n_double("s") > 0
    at = [F.when(known, F.kll_sketch_get_quantile_double("s", F.lit(p))).alias(f"p{round(100 * p)}") for p in points]
    rate = 1 - F.col("fails") / F.col("requests")
    used = F.col("fails") / ((1 - SLO_SUCCESS) * F.col("requests")) * 100
    return merged.select("day", *keys, "requests", "fails", *at, F.round(rate, 6).alias("success_rate"), F.round(used, 4).alias("budget_used_pct"))
