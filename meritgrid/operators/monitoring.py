"""What watches over the engine: drift, spikes, jumps, trends, distributions, agreement, coverage, service levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meritgrid.functions.positions import in_buckets, numbered, order_statistics, running_sums, settled

# Windows and thresholds of the alerts.
DRIFT_ROWS, DRIFT_DROP, DRIFT_Z = 14, 0.30, 2.0
SPIKE_DAYS, SPIKE_WARN, SPIKE_CRITICAL = 14, 3, 5
JUMP_PERCENT = 25.0
BINS = 50
KS_WARN, KS_CRITICAL = 0.1, 0.3
SLO_SUCCESS = 0.999
DEFAULT_BUDGET = 1000.0
COVERED_STATES = ["CA", "NY", "TX", "FL", "IL", "PA", "OH", "NC", "GA", "MI"]


def drift(daily: DataFrame) -> DataFrame:
    """(source, day, n) with the mean and deviation of the 14 rows before, drop, z score and alert: critical for a
    drop of 30 %, warning for a z score of 2. Fewer than two rows before give no baseline and no alert."""
    before = W.partitionBy("source").orderBy("day").rowsBetween(-DRIFT_ROWS, -1)
    n = F.count("n").over(before)
    rows = daily.withColumn("mean", F.when(n >= 2, F.avg("n").over(before)).otherwise(0.0)).withColumn(
        "deviation",
        F.when(n >= 2, F.stddev_samp("n").over(before)).otherwise(0.0),
    )
    drop = F.when(F.col("mean") > 0, (F.col("mean") - F.col("n")) / F.col("mean")).otherwise(0.0)
    z = F.when((F.col("mean") > 0) & (F.col("deviation") > 0), (F.col("mean") - F.col("n")) / F.col("deviation")).otherwise(0.0)
    rows = rows.withColumn("drop", drop).withColumn("z", z)
    return rows.withColumn("severity", F.when((F.col("mean") > 0) & (F.col("drop") >= DRIFT_DROP), "critical").when(F.col("z") >= DRIFT_Z, "warning"))


def daily_counts(events: DataFrame, time: str, *keys: str) -> DataFrame:
    return events.groupBy(*keys, F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def spikes(daily: DataFrame, *keys: str) -> DataFrame:
    """(keys, day, n) with the mean over the days present among the 14 before, and severity: warning above three
    times that mean, critical above five times. The frame is of days, on counts already added up by day."""
    day = F.unix_date("day")
    frame = W.partitionBy(*keys).orderBy(day).rangeBetween(-SPIKE_DAYS, -1)
    rows = daily.withColumn("mean", F.avg("n").over(frame))
    level = F.when(F.col("n") > SPIKE_CRITICAL * F.col("mean"), "critical").when(F.col("n") > SPIKE_WARN * F.col("mean"), "warning")
    return rows.withColumn("severity", level)


def summary_days(events: DataFrame, time: str, end: str, days: int = 7) -> DataFrame:
    """(day, event_type, n) for each type and each of so many days up to `end`, days without events with 0."""
    types = events.select("event_type").distinct()
    wanted = types.select("event_type", F.explode(F.sequence(F.date_sub(F.lit(end).cast("date"), days - 1), F.lit(end).cast("date"))).alias("day"))
    low = F.date_sub(F.lit(end).cast("date"), days - 1)
    counts = daily_counts(events.where(F.to_date(time).between(low, F.lit(end).cast("date"))), time, "event_type")
    return wanted.join(counts, ["day", "event_type"], "left").select("day", "event_type", F.coalesce("n", F.lit(0)).alias("n"))


def jumps(values: DataFrame, *keys: str, version: str = "version", value: str = "value") -> DataFrame:
    """Changes of a parameter from one version to the next of more than 25 %, critical over 50 %. From zero any
    value over 0.01 counts as a change of 100 %."""
    order = W.partitionBy(*keys).orderBy(version)
    rows = values.withColumns({"old_value": F.lag(value).over(order), "old_version": F.lag(version).over(order)}).where("old_value is not null")
    zero = F.abs("old_value") < 1e-10
    change = F.when(zero, F.when(F.abs(value) > 0.01, 100.0)).otherwise(F.abs(F.col(value) - F.col("old_value")) / F.abs("old_value") * 100.0)
    found = rows.withColumn("change", change).where(F.col("change") > JUMP_PERCENT)
    return found.withColumn(
        "severity",
        F.when(F.col("change") > 2 * JUMP_PERCENT, "critical").otherwise("warning"),
    ).withColumn("change", F.round("change", 2))


def trends(snapshots: DataFrame, key: str, day: str, value: str, least: int = 4, last: int = 1000) -> DataFrame:
    """(key, slope, n): the least-squares slope over the last so many snapshots of each key that has enough."""
    recent = snapshots.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(F.desc(day)))).where(F.col("_k") <= last)
    slope = F.regr_slope(F.col(value), F.unix_date(F.to_date(day)).cast("double"))
    return recent.groupBy(key).agg(slope.alias("slope"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def latest_drop(snapshots: DataFrame, key: str, day: str, value: str, threshold: float) -> DataFrame:
    """Keys whose latest value fell by more than the threshold since the one before; twice that is critical."""
    order = W.partitionBy(key).orderBy(F.desc(day))
    rows = snapshots.select(
        key,
        day,
        F.col(value).alias("value"),
        F.lead(value).over(order).alias("previous"),
        F.row_number().over(order).alias("_k"),
    ).where("_k = 1")
    drop = F.col("previous") - F.col("value")
    return rows.withColumn("drop", drop).where(F.col("drop") > threshold).withColumn(
        "severity",
        F.when(F.col("drop") > 2 * threshold, "critical").otherwise("warning"),
    ).drop("_k")


def histogram(scores: DataFrame, value: str, key: str, bins: int = BINS) -> DataFrame:
    """(key, bin, n) with bins of equal width from the smallest to the largest value, which is in the last bin;
    one value only gets bins half a unit to either side. A value is placed by widths of a bin, as `width_bucket`, which
    multiplies before it divides, puts some values at a bin's edge elsewhere."""
    ends = scores.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    same = F.col("_lo") == F.col("_hi")
    ends = ends.select(
        key,
        F.when(same, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("lo"),
        F.when(same, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("hi"),
    )
    at = F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) + 1
    placed = scores.join(ends, key).select(key, "lo", "hi", F.least(at, F.lit(bins)).alias("bin"))
    return placed.groupBy(key, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def ks_statistic(values: DataFrame, side: str, value: str) -> DataFrame:
    """One row: the largest distance between the empirical distributions of the two sides (0 and 1), and severity.
    Values are counted before they are ordered, and the running counts are those of buckets of values."""
    counts = values.groupBy(value).agg(F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) == 1).alias("b"))
    running = running_sums(counts, [value], {"_a": F.col("a"), "_b": F.col("b")})
    shown = running.select((F.col("_a") + F.col("a")).alias("a"), (F.col("_b") + F.col("b")).alias("b"))
    totals = shown.agg(F.max("a").alias("na"), F.max("b").alias("nb")).first()
    share = lambda c: F.col(c) / F.lit(float(max(totals[f"n{c}"] or 0, 1)))
    d = F.round(F.max(F.abs(share("a") - share("b"))), 6)
    return shown.agg(d.alias("ks")).withColumn("severity", F.when(F.col("ks") > KS_CRITICAL, "critical").when(F.col("ks") > KS_WARN, "warning"))


def pooled_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: agreement of two raters beyond chance, with chance from both raters' pooled choices; null for fewer
    than two pairs."""
    n = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("agree"))
    pooled = pairs.select(F.explode(F.array(a, b)).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    chance = pooled.agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("squares"), F.sum("k").alias("total"))
    joined = n.withColumn("_j", F.lit(1)).join(chance.withColumn("_j", F.lit(1)), "_j")
    po, pe = F.col("agree") / F.col("n"), F.col("squares") / (F.col("total").cast("double") * F.col("total"))
    kappa = F.when(F.col("n") < 2, None).when(F.abs(1 - pe) < 1e-10, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return joined.select("n", "agree", F.round(kappa, 6).alias("kappa"))


def reviewer_kappa(judgments: DataFrame) -> DataFrame:
    """(r1, r2, n, kappa) of every two reviewers, r1 < r2, over the items that both judged, each by the last word of
    (reviewer, item, choice, seq); null where chance alone would agree always."""
    last = judgments.groupBy("item", "reviewer").agg(F.max_by("choice", "seq").alias("choice"))
    both = last.toDF("item", "r1", "c1").join(last.toDF("item", "r2", "c2"), "item").where("r1 < r2")
    cells = both.groupBy("r1", "r2", "c1", "c2").agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy("r1", "r2").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("c1") == F.col("c2"), F.col("n")).otherwise(0)).alias("agree"))
    left = cells.groupBy("r1", "r2", F.col("c1").alias("c")).agg(F.sum("n").alias("x"))
    right = cells.groupBy("r1", "r2", F.col("c2").alias("c")).agg(F.sum("n").alias("y"))
    chance = left.join(right, ["r1", "r2", "c"]).groupBy("r1", "r2").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    po, pe = F.col("agree") / F.col("n"), F.coalesce("xy", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return total.join(chance, ["r1", "r2"], "left").select("r1", "r2", "n", F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"))


def overlapping_pairs(judgments: DataFrame) -> DataFrame:
    """Pairs (unordered) that more than one reviewer judged, without repeats shown on purpose."""
    pair = F.array_sort(F.array("a", "b"))
    return judgments.where(~F.col("is_reshow")).groupBy(pair.alias("pair")).agg(F.countDistinct("reviewer").alias("reviewers")).where("reviewers > 1")


def reshown_pairs(judgments: DataFrame) -> DataFrame:
    pair = F.array_sort(F.array("a", "b"))
    return judgments.groupBy("reviewer", pair.alias("pair")).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def merge_accuracy(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: hits, false and missed merges, precision, recall, F1 over pairs (a, b, is_match)."""
    p = predicted.select("a", "b", F.col("is_match").alias("p")).dropDuplicates(["a", "b"])
    t = truth.select("a", "b", F.col("is_match").alias("t")).dropDuplicates(["a", "b"])
    both = p.join(t, ["a", "b"], "full_outer").select(F.coalesce("p", F.lit(False)).alias("p"), F.coalesce("t", F.lit(False)).alias("t"))
    counts = both.agg(
        F.sum((F.col("p") & F.col("t")).cast("long")).alias("tp"),
        F.sum((F.col("p") & ~F.col("t")).cast("long")).alias("fp"),
        F.sum((~F.col("p") & F.col("t")).cast("long")).alias("fn"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = counts.withColumn(
        "precision",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")),
    ).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", F.round(f1, 6)).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


def exclusive_quantile(df: DataFrame, value: str, p: float) -> Column:
    """Not an aggregate of Spark's: see `coverage`, which uses it on numbered rows."""
    place = (F.col("_n") + 1) * F.lit(p)
    low = F.greatest(F.lit(1), F.least(F.floor(place), F.col("_n") - 1))
    share = place - low
    at = lambda i: F.max(F.when(F.col("_p") == i, F.col(value)))
    return at(low) + (at(low + 1) - at(low)) * F.max(share)


def coverage(candidates: DataFrame) -> DataFrame:
    """One row over (uuid, strong_keys, linkage_confidence, n_papers, n_grants, n_trials): shares in per cent and
    the 5, 50 and 95 % points of confidence by the exclusive rule, from exact positions."""
    share = lambda test: F.round(100.0 * F.count_if(test) / F.count(F.lit(1)), 2)
    keys = F.map_contains_key("strong_keys", "orcid") | F.map_contains_key("strong_keys", "era_commons")
    total = F.col("n_papers") + F.col("n_grants") + F.col("n_trials")
    placed = numbered(candidates, ["linkage_confidence", "uuid"], "_p", "_n")
    return placed.agg(
        F.count(F.lit(1)).alias("total_candidates"),
        share(keys).alias("strong_key_pct"),
        share(F.col("linkage_confidence") >= 0.7).alias("probabilistic_linkage_pct"),
        share(F.col("n_papers") > 0).alias("pubmed_pct"),
        share(F.col("n_grants") > 0).alias("reporter_pct"),
        share(F.col("n_trials") > 0).alias("ctgov_pct"),
        share(total < 3).alias("thin_record_pct"),
        *(F.round(exclusive_quantile(placed, "linkage_confidence", p), 4).alias(n) for n, p in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95))),
    )


def service_levels(requests: DataFrame, *keys: str) -> DataFrame:
    """Per key: requests, p95 and p99 latency at index int(p (n - 1)), success rate, error budget used in per cent.
    The order statistics come from positions in one order of all requests, so a busy source is no task of its own."""
    at = lambda p: F.floor((F.col("_n") - 1) * F.lit(p))
    points = order_statistics(requests, list(keys), ["latency", "id"], "latency", {"p95": at(0.95), "p99": at(0.99)})
    fails, n = F.count_if(~F.col("success")), F.count(F.lit(1))
    rates = requests.groupBy(*keys).agg(
        n.alias("requests"), F.round(1 - fails / n, 6).alias("success_rate"), F.round(
            fails / ((1 - SLO_SUCCESS) * n) * 100,
            4,
        ).alias("budget_used_pct")
    )
    own = points.toDF(*(f"_{k}" for k in keys), *points.columns[len(keys) :])
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return rates.join(own, same).select(*keys, "requests", "p95", "p99", "success_rate", "budget_used_pct")


def rolling_levels(requests: DataFrame, key: str, days: int, points: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """`service_levels` of each key over the `days` up to each day that has requests, as (as_of, key, ...); requests (day,
    key, latency, success) without a latency are the slowest.

    A request is not copied into each window that it is in. Windows are counted by buckets of latencies, out of counts of
    days, which tells the bucket that holds an order statistic; only requests of that bucket go into the window, and
    equal ones as one row with their number."""
    rows = settled(requests.select("day", key, "latency", "success"))
    kept = in_buckets(rows, [key, "latency"], "b").withColumn("b", F.when(F.col("latency").isNull(), 2**30).otherwise(F.col("b")))
    daily = settled(
        kept.groupBy("day", F.col(key).alias("k"), "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("fails"))
    )
    back = F.explode(F.sequence(F.col("as_of"), F.date_sub("as_of", days - 1), F.expr("interval -1 day"))).alias("day")
    windows = daily.select(F.col("day").alias("as_of")).where("as_of is not null").distinct().select("as_of", back)
    counts = windows.join(daily, "day").groupBy("as_of", "k", "b").agg(F.sum("n").alias("n"), F.sum("fails").alias("fails"))
    own = W.partitionBy("as_of", "k")
    before = F.sum("n").over(own.orderBy("b")) - F.col("n")
    counts = settled(counts.select("*", F.sum("n").over(own).alias("all"), before.alias("before")))
    place = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.floor((F.col("all") - 1) * F.lit(p)).alias("i")) for p in points))).alias("w")
    asked = counts.select("as_of", "k", "b", "n", "before", place).select("*", "w.p", "w.i").where("i >= before and i < before + n")
    wanted = asked.select("as_of", "k", "b", "p", (F.col("i") - F.col("before")).alias("i"))
    near = kept.where("latency is not null").groupBy("day", F.col(key).alias("k"), "b", "latency").agg(F.count(F.lit(1)).alias("m"))
    met = near.alias("r").join(wanted.join(windows, "as_of").alias("w"), (F.col("r.day") == F.col("w.day")) & (F.col("r.b") == F.col("w.b"))
        & F.col("r.k").eqNullSafe(F.col("w.k")))
    values = met.groupBy("as_of", "w.k", "p", "i", "latency").agg(F.sum("m").alias("m"))
    upto = F.sum("m").over(W.partitionBy("as_of", "k", "p").orderBy("latency"))
    found = values.withColumn("upto", upto).where("upto > i and upto - m <= i")
    best = found.groupBy("as_of", "k").agg(*(F.max(F.when(F.col("p") == p, F.col("latency"))).alias(f"p{round(100 * p)}") for p in points))
    n, fails = F.col("requests"), F.col("fails")
    rates = counts.groupBy("as_of", "k").agg(F.sum("n").alias("requests"), F.sum("fails").alias("fails")).select(
        "as_of", "k", "requests", F.round(1 - fails / n, 6).alias("success_rate"), F.round(fails / ((1 - SLO_SUCCESS) * n) * 100, 4).alias("budget_used_pct")
    )
    both = rates.alias("a").join(best.alias("b"), (F.col("a.as_of") == F.col("b.as_of")) & F.col("a.k").eqNullSafe(F.col("b.k")), "left")
    names = [f"p{round(100 * p)}" for p in points]
    return both.select("a.as_of", F.col("a.k").alias(key), "requests", *names, "success_rate", "budget_used_pct")


def health(requests: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Per source the number of calls by status and the error rate."""
    status = ["2xx", "4xx", "5xx", "timeout"]
    counts = requests.groupBy("source").pivot("status", status).agg(F.count(F.lit(1)))
    filled = counts.select("source", *(F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(f"n_{s}") for s in status))
    total = sum((F.col(f"n_{s}") for s in status[1:]), F.col("n_2xx"))
    return filled.withColumn("error_rate", F.round((total - F.col("n_2xx")) / total, 6))


def freshness(successes: DataFrame, slo: DataFrame, now: Column) -> DataFrame:
    """Per source hours since the last success, mean lag, and whether the objective (24 hours by default) is met."""
    last = successes.groupBy("source").agg(F.max("ts").alias("last"), F.avg("lag").alias("mean_lag"))
    hours = (F.unix_timestamp(now) - F.unix_timestamp("last")) / 3600.0
    joined = slo.join(last, "source", "full_outer")
    return joined.select(
        "source",
        F.round(hours, 4).alias("age_hours"),
        F.round("mean_lag", 6).alias("mean_lag"),
        (F.coalesce(hours, F.lit(float("inf"))) <= F.coalesce("slo_hours", F.lit(24.0))).alias("met"),
    )


def refresh_sla(slas: DataFrame, successes: DataFrame, now: Column) -> DataFrame:
    """Per source of (source, sla_hours, hard_gate) the age of the last success, twice the agreed age if there is
    none, and the breach: critical for sources that feed the hard gate."""
    last = successes.groupBy("source").agg(F.max("ts").alias("last"))
    age = F.coalesce((F.unix_timestamp(now) - F.unix_timestamp("last")) / 3600.0, 2 * F.col("sla_hours"))
    rows = slas.join(last, "source", "left").withColumn("age_hours", age).drop("last")
    breach = F.col("age_hours") > F.col("sla_hours")
    return rows.withColumn("breached", breach).withColumn("severity", F.when(breach, F.when(F.col("hard_gate"), "critical").otherwise("warning")))


def cost_report(usage: DataFrame, day: str) -> DataFrame:
    """(customer, model, cost, calls) of one UTC day by customer, by model and in all, in one pass."""
    today = usage.where(F.to_date("ts") == F.lit(day).cast("date"))
    return today.groupingSets([["customer"], ["model"], []], "customer", "model").agg(
        F.round(F.sum("cost"), 6).alias("cost"),
        F.count(F.lit(1)).alias("calls"),
    )


def over_budget(usage: DataFrame, budgets: DataFrame, day: str) -> DataFrame:
    today = usage.where(F.to_date("ts") == F.lit(day).cast("date")).groupBy("customer").agg(F.round(F.sum("cost"), 6).alias("spent"))
    limit = F.coalesce("budget", F.lit(DEFAULT_BUDGET))
    return today.join(budgets, "customer", "left").select("customer", "spent", limit.alias("budget"), (F.col("spent") >= limit).alias("is_over"))


def recall(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """(query, recall, found, missed) over sets of (query, uuid); a query that expects nothing has recall 1."""
    e = expected.groupBy("query").agg(F.array_sort(F.collect_set("uuid")).alias("e"))
    r = returned.groupBy("query").agg(F.collect_set("uuid").alias("r"))
    joined = e.join(r, "query", "full_outer").select(
        "query",
        F.coalesce("e", F.array().cast("array<string>")).alias("e"),
        F.coalesce("r", F.array().cast("array<string>")).alias("r"),
    )
    found = F.array_sort(F.array_intersect("e", "r"))
    value = F.when(F.size("e") == 0, 1.0).otherwise(F.size(found) / F.size("e"))
    return joined.select("query", F.round(value, 6).alias("recall"), found.alias("found"), F.array_sort(F.array_except("e", "r")).alias("missed"))


def specialty_distribution(probabilities: DataFrame) -> DataFrame:
    """(specialty, n, pct, n_multi): candidates by likeliest specialty of (uuid, specialty, p), their share, and how
    many of them have more than one specialty above 0.2."""
    best = probabilities.groupBy("uuid").agg(F.max(F.struct("p", "specialty")).alias("m"), F.count_if(F.col("p") > 0.2).alias("k"))
    counts = best.groupBy(F.col("m.specialty").alias("specialty")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") > 1).alias("n_multi"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 2))


def signal_balance(candidates: DataFrame) -> DataFrame:
    """Shares of papers, trials and grants in each candidate's artifacts and whether one of them is over 0.9."""
    total = F.col("n_papers") + F.col("n_trials") + F.col("n_grants")
    parts = {k: F.round(F.when(total > 0, F.col(f"n_{k}") / total).otherwise(0.0), 4) for k in ("papers", "trials", "grants")}
    out = candidates.select("uuid", *(v.alias(f"{k}_share") for k, v in parts.items()))
    top = F.greatest("papers_share", "trials_share", "grants_share")
    return out.withColumn("dominant", top > 0.7).withColumn("alert", top >= 0.9)


def linkage_class(confidence: Column) -> Column:
    return F.when(confidence.isNull() | (confidence < 0.5), "holdout").when(confidence < 0.7, "flagged").otherwise("linked")


def linkage_shift(before: DataFrame, now: DataFrame) -> DataFrame:
    """(uuid, old, new, delta, crossing) of those whose confidence changed between two snapshots."""
    both = before.select("uuid", F.col("confidence").alias("old")).join(now.select("uuid", F.col("confidence").alias("new")), "uuid")
    rows = both.withColumn("delta", F.round(F.col("new") - F.col("old"), 6)).where("delta <> 0")
    a, b = linkage_class(F.col("old")), linkage_class(F.col("new"))
    return rows.withColumn("crossing", F.when(a != b, F.concat(a, F.lit("->"), b)))


def stale_sources(slas: DataFrame, refreshed: DataFrame, now: Column) -> DataFrame:
    """Sources that were never refreshed or are older than agreed: the circuits that are open."""
    last = refreshed.groupBy("source").agg(F.max("ts").alias("last"))
    hours = (F.unix_timestamp(now) - F.unix_timestamp("last")) / 3600.0
    return slas.join(last, "source", "left").select(
        "source",
        hours.alias("age_hours"),
    ).join(slas, "source").where(F.col("age_hours").isNull() | (F.col("age_hours") > F.col("sla_hours")))


def coverage_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(metric, delta) between two results of `coverage`: shares to two digits, the middle of confidence to four."""
    digits = {c: 2 for c in current.columns if c.endswith("_pct")} | {"p50": 4}
    long = lambda df, name: df.select(
        F.explode(F.create_map(*(x for c in digits for x in (F.lit(c), F.col(c).cast("double"))))).alias("metric", name)
    )
    both = long(current, "now").join(long(previous, "before"), "metric")
    return both.select(
        "metric",
        F.when(
            F.col("metric") == "p50",
            F.round(F.col("now") - F.col("before"), 4),
        ).otherwise(F.round(F.col("now") - F.col("before"), 2)).alias("delta"),
    )


def clinician_coverage(clinicians: DataFrame) -> DataFrame:
    """One row over (has_candidate, has_abms, has_state_board, has_hospital_tier, has_publications, practice_state):
    shares in per cent, the states that state boards cover and the others, and caveats."""
    share = lambda c: F.coalesce(F.round(100.0 * F.count_if(F.col(c)) / F.nullif(F.count(F.lit(1)), F.lit(0)), 2), F.lit(0.0))
    state = F.col("practice_state")
    covered = state.isin(COVERED_STATES)
    states = lambda test: F.array_sort(F.collect_set(F.when(test & (state != ""), state)))
    row = clinicians.agg(
        F.count(F.lit(1)).alias("total_clinicians"),
        share("has_candidate").alias("npi_crosslinked_pct"),
        share("has_abms").alias("abms_coverage_pct"),
        share("has_state_board").alias("state_board_coverage_pct"),
        share("has_hospital_tier").alias("hospital_tier_pct"),
        share("has_publications").alias("publication_pct"),
        states(covered).alias("covered_states"),
        states(~covered).alias("gap_states"),
    )
    some = F.col("total_clinicians") > 0
    caveats = F.array_compact(
        F.array(
            F.when(some & (F.col("publication_pct") < 30), "few publications"),
            F.when(some & (F.col("abms_coverage_pct") < 50), "few certifications"),
        )
    )
    return row.withColumn("caveats", caveats)


def source_shares(candidates: DataFrame) -> DataFrame:
    """(metric, value): for each source of candidates (uuid, sources) the share of candidates that it covers, in per cent,
    as `per_source_<name>`."""
    n = candidates.count()
    own = candidates.select("uuid", F.explode(F.array_distinct("sources")).alias("source")).where("source is not null")
    return own.groupBy("source").agg(F.round(100.0 * F.count_distinct("uuid") / F.lit(float(max(n, 1))), 2).alias("value")).select(
        F.concat(F.lit("per_source_"), "source").alias("metric"), "value"
    )


def metric_changes(current: DataFrame, previous: DataFrame, digits: int = 2) -> DataFrame:
    """(metric, delta) over the metrics of either of two tables (metric, value); one that a table lacks is zero there."""
    both = current.withColumnRenamed("value", "_now").join(previous.withColumnRenamed("value", "_then"), "metric", "full_outer")
    return both.select("metric", F.round(F.coalesce("_now", F.lit(0.0)) - F.coalesce("_then", F.lit(0.0)), digits).alias("delta"))
