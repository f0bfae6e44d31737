"""Queries over drift, spikes, trends, distributions, agreement, coverage, service levels, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgrid.operators import monitoring as m
from meritgrid.plans.standins import PAPERS_SQL, REQUESTS_SQL, candidates, papers, requests, table

NOW = "2024-01-31 00:00:00"
DAY = "2024-01-15"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def drift_14_rows(spark: SparkSession, d: str) -> DataFrame:
    daily = m.daily_counts(_events(spark, d), "ts", "event_type").withColumnRenamed("event_type", "source")
    return m.drift(daily).select("source", "day", "n", *(F.round(c, 6).alias(c) for c in ("mean", "deviation", "drop", "z")), "severity")


def spike_14_days(spark: SparkSession, d: str) -> DataFrame:
    daily = m.daily_counts(_events(spark, d), "ts", "user_id", "event_type")
    return m.spikes(daily, "user_id", "event_type").select("user_id", "event_type", "day", "n", F.round("mean", 6).alias("mean"), "severity")


def weekly_summary(spark: SparkSession, d: str) -> DataFrame:
    return m.summary_days(_events(spark, d), "ts", DAY)


def jump_lag(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    yearly = o.groupBy("o_custkey", F.year("o_orderdate").alias("version")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return m.jumps(yearly, "o_custkey").select(
        "o_custkey",
        "old_version",
        "version",
        "old_value",
        "value",
        F.round("change", 1).alias("change"),
        "severity",
    )


def trend_slope(spark: SparkSession, d: str) -> DataFrame:
    daily = _events(spark, d).groupBy(F.col("user_id").alias("customer"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return m.trends(daily, "customer", "day", "v").select("customer", F.round("slope", 6).alias("slope"), "n")


def latest_drop(spark: SparkSession, d: str) -> DataFrame:
    daily = _events(spark, d).groupBy(F.col("user_id").alias("customer"), F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 4).alias("v"))
    return m.latest_drop(daily, "customer", "day", "v", 2.0).select(
        "customer",
        "day",
        "value",
        "previous",
        F.round("drop", 4).alias("drop"),
        "severity",
    )


def histogram_50(spark: SparkSession, d: str) -> DataFrame:
    return m.histogram(_events(spark, d).where("value is not null"), "value", "event_type")


def score_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.median("value"), 6).alias("median"),
        F.round(F.stddev_samp("value"), 6).alias("deviation"),
        F.count("value").alias("n"),
    )


def ks_two_sample(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select((F.dayofmonth("ts") > 15).cast("int").alias("side"), F.round("value", 1).alias("value"))
    return m.ks_statistic(e, "side", "value")


def kappa_pairs(spark: SparkSession, d: str) -> DataFrame:
    return m.pooled_kappa(table(spark, d, "labels"), "quality", "toxic")


def _judgments(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        (F.col("o_orderkey") % 200).alias("item"),
        (F.col("o_custkey") % 6).alias("reviewer"),
        (F.col("o_totalprice") > 200000).alias("choice"),
        F.col("o_orderkey").alias("seq"),
    )


def reviewer_kappa(spark: SparkSession, d: str) -> DataFrame:
    return m.reviewer_kappa(_judgments(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        (F.col("l_partkey") % 40).alias("a"),
        (F.col("l_suppkey") % 40).alias("b"),
        (F.col("l_orderkey") % 5).alias("reviewer"),
        (F.col("l_linenumber") == 1).alias("is_reshow"),
    ).where("a <> b")


def overlapping_pairs(spark: SparkSession, d: str) -> DataFrame:
    return m.overlapping_pairs(_pairs(spark, d)).select(F.col("pair")[0].alias("a"), F.col("pair")[1].alias("b"), "reviewers")


def reshown_pairs(spark: SparkSession, d: str) -> DataFrame:
    return m.reshown_pairs(_pairs(spark, d)).select("reviewer", F.col("pair")[0].alias("a"), F.col("pair")[1].alias("b"), "times")


def confusion_counts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    predicted = li.where("l_quantity > 25").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), F.lit(True).alias("is_match"))
    truth = li.where("l_discount > 0.04").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), F.lit(True).alias("is_match"))
    return m.merge_accuracy(predicted, truth)


def _cohort(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("uuid")
    keys = F.when(u % 3 == 0, F.create_map(F.lit("orcid"), F.lit("x"))).when(
        u % 5 == 0,
        F.create_map(F.lit("era_commons"), F.lit("y")),
    ).otherwise(F.create_map(F.lit("npi"), F.lit("z")))
    return candidates(spark, d).select(
        "uuid",
        keys.alias("strong_keys"),
        ((u * 37 % 101) / 100.0).alias("linkage_confidence"),
        (u % 4).alias("n_papers"),
        (u % 3).alias("n_grants"),
        (u % 2).alias("n_trials"),
    )


def coverage_metrics(spark: SparkSession, d: str) -> DataFrame:
    return m.coverage(_cohort(spark, d))


def service_levels(spark: SparkSession, d: str) -> DataFrame:
    return m.service_levels(requests(spark, d).where("latency is not null"), "source")


def service_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return m.service_levels(requests(spark, d).where("latency is not null"), "customer", "source")


def health_pivot(spark: SparkSession, d: str) -> DataFrame:
    return m.health(requests(spark, d))


def freshness(spark: SparkSession, d: str) -> DataFrame:
    slo = spark.createDataFrame([("click", 1.0), ("view", 48.0), ("never", 5.0)], "source string, slo_hours double")
    return m.freshness(requests(spark, d).select("source", "ts", F.col("latency").alias("lag")), slo, F.lit(NOW).cast("timestamp_ntz"))


def refresh_sla(spark: SparkSession, d: str) -> DataFrame:
    slas = spark.createDataFrame(
        [("click", 0.1, True), ("view", 48.0, True), ("never", 5.0, False)],
        "source string, sla_hours double, hard_gate boolean",
    )
    return m.refresh_sla(slas, requests(spark, d), F.lit(NOW).cast("timestamp_ntz")).withColumn("age_hours", F.round("age_hours", 4))


def stale_sources(spark: SparkSession, d: str) -> DataFrame:
    slas = spark.createDataFrame([("click", 0.1), ("view", 48.0), ("never", 5.0)], "source string, sla_hours double")
    return m.stale_sources(slas, requests(spark, d), F.lit(NOW).cast("timestamp_ntz")).select(
        "source",
        "sla_hours",
        F.round("age_hours", 4).alias("age_hours"),
    )


def cost_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    usage = _events(spark, d).select("ts", F.col("user_id").alias("customer"), F.col("event_type").alias("model"), F.col("value").alias("cost"))
    return m.cost_report(usage, DAY).withColumn("cost", F.round("cost", 4))


def over_budget(spark: SparkSession, d: str) -> DataFrame:
    usage = _events(spark, d).select("ts", F.col("user_id").alias("customer"), F.col("value").alias("cost"))
    budgets = candidates(spark, d).select(
        F.col("uuid").alias("customer"),
        (F.col("uuid") % 40).cast("double").alias("budget"),
    ).where("customer % 2 = 0")
    return m.over_budget(usage, budgets, DAY).withColumn("spent", F.round("spent", 4))


def recall_set(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    e = li.where("l_quantity > 20").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").cast("string").alias("uuid"))
    r = li.where("l_discount > 0.03").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").cast("string").alias("uuid"))
    return m.recall(e, r).select("query", "recall", F.array_join("found", ",").alias("found"), F.array_join("missed", ",").alias("missed"))


def argmax_specialty(spark: SparkSession, d: str) -> DataFrame:
    share = papers(spark, d).groupBy("uuid", F.col("term").alias("specialty")).agg(F.count(F.lit(1)).alias("n"))
    total = share.groupBy("uuid").agg(F.sum("n").alias("t"))
    return m.specialty_distribution(share.join(total, "uuid").select("uuid", "specialty", (F.col("n") / F.col("t")).alias("p")))


def signal_balance(spark: SparkSession, d: str) -> DataFrame:
    return m.signal_balance(_cohort(spark, d))


def linkage_shift(spark: SparkSession, d: str) -> DataFrame:
    c = _cohort(spark, d)
    before = c.select("uuid", F.col("linkage_confidence").alias("confidence"))
    now = c.select(
        "uuid",
        F.when(F.col("uuid") % 3 == 0, F.col("linkage_confidence") + 0.15).otherwise(F.col("linkage_confidence")).alias("confidence"),
    ).where("uuid % 11 <> 0")
    return m.linkage_shift(before, now).select(
        "uuid",
        F.round("old", 4).alias("old"),
        F.round("new", 4).alias("new"),
        F.round("delta", 4).alias("delta"),
        "crossing",
    )


QUERIES = {
    f.__name__: f
    for f in (
        drift_14_rows, spike_14_days, weekly_summary, jump_lag, trend_slope, latest_drop, histogram_50, score_snapshot, ks_two_sample, kappa_pairs,
            reviewer_kappa,
        overlapping_pairs, reshown_pairs, confusion_counts, coverage_metrics, service_levels, service_breakdown, health_pivot, freshness, refresh_sla,
            stale_sources,
        cost_grouping_sets, over_budget, recall_set, argmax_specialty, signal_balance, linkage_shift,
    )
}

_COHORT = """cohort AS (SELECT c_custkey AS uuid, (c_custkey * 37 % 101) / 100.0::DOUBLE AS conf, c_custkey % 4 AS p, c_custkey % 3 AS g,
      c_custkey % 2 AS t FROM customer)"""
_SLO = "round(1 - count(*) FILTER (NOT success) / count(*)::DOUBLE, 6) AS success_rate, round(count(*) FILTER (NOT success) / ((1 - 0.999::DOUBLE) * count(*)) * 100, 4) AS budget_used_pct"


def _levels(keys: str) -> str:
    return f"""WITH {REQUESTS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY latency, id) - 1 AS i, count(*)
      OVER (PARTITION BY {keys}) AS n FROM requests WHERE latency IS NOT NULL)
      SELECT {keys}, count(*) AS requests, max(latency) FILTER (i = floor((n - 1) * 0.95::DOUBLE)) AS p95, max(latency)
        FILTER (i = floor((n - 1) * 0.99::DOUBLE)) AS p99, {_SLO} FROM p GROUP BY {keys}"""


_AGE = f"epoch(TIMESTAMP '{NOW}') - floor(epoch(max(ts)))"
_EXCLUSIVE = "round(max(conf) FILTER (i = greatest(1, least(floor((n + 1) * {p}::DOUBLE), n - 1))) + (max(conf) FILTER (i = greatest(1, least(floor((n + 1) * {p}::DOUBLE), n - 1)) + 1) - max(conf) FILTER (i = greatest(1, least(floor((n + 1) * {p}::DOUBLE), n - 1)))) * max((n + 1) * {p}::DOUBLE - greatest(1, least(floor((n + 1) * {p}::DOUBLE), n - 1))), 4)"

ORACLE_SQL = {
    "drift_14_rows": """WITH c AS (SELECT event_type AS source, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT *, count(n)
          OVER b AS k, avg(n) OVER b AS a, stddev_samp(n) OVER b AS s FROM c WINDOW b AS (PARTITION BY source ORDER BY day ROWS BETWEEN 14 PRECEDING
            AND 1 PRECEDING)),
      v AS (SELECT source, day, n, CASE WHEN k >= 2 THEN a ELSE 0 END::DOUBLE AS mean, CASE WHEN k >= 2 THEN s ELSE 0 END::DOUBLE AS deviation
        FROM w), z AS (SELECT *, CASE WHEN mean > 0 THEN (mean - n) / mean ELSE 0 END::DOUBLE AS dr, CASE WHEN mean > 0
          AND deviation > 0 THEN (mean - n) / deviation ELSE 0 END::DOUBLE AS zs FROM v)
      SELECT source, day, n, round(mean, 6) AS mean, round(deviation, 6) AS deviation, round(dr, 6) AS "drop", round(zs, 6) AS z, CASE WHEN mean > 0
        AND dr >= 0.3 THEN 'critical' WHEN zs >= 2 THEN 'warning' END AS severity FROM z""",
    "spike_14_days": """WITH c AS (SELECT user_id, event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT *, avg(n)
          OVER (PARTITION BY user_id, event_type ORDER BY day RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS a FROM c)
      SELECT user_id, event_type, day, n, round(a, 6) AS mean, CASE WHEN n > 5 * a THEN 'critical' WHEN n > 3 * a THEN 'warning' END AS severity
        FROM w""",
    "weekly_summary": f"""SELECT d::DATE AS day, event_type, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(DATE '{DAY}' - 6, DATE '{DAY}',
          INTERVAL 1 DAY)) AS d) CROSS JOIN (SELECT DISTINCT event_type FROM events)
      LEFT JOIN (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL) c ON c.day = d
        AND c.event_type = event_type""".replace("(SELECT DISTINCT event_type FROM events)",
            "(SELECT DISTINCT event_type AS et FROM events)").replace("day, event_type, coalesce",
                "day, et AS event_type, coalesce").replace("c.event_type = event_type", "c.event_type = et"),
    "jump_lag": """WITH y AS (SELECT o_custkey, year(o_orderdate)::INT AS version, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL),
          l AS (SELECT *, lag(version) OVER w AS old_version, lag(value) OVER w AS old_value FROM y WINDOW w AS (PARTITION BY o_custkey
            ORDER BY version)),
      c AS (SELECT *, CASE WHEN abs(old_value) < 1e-10 THEN CASE WHEN abs(value) > 0.01 THEN 100.0 END
        ELSE abs(value - old_value) / abs(old_value) * 100 END AS ch FROM l WHERE old_value IS NOT NULL)
      SELECT o_custkey, old_version, version, old_value, value, round(round(ch, 2), 1) AS change, CASE WHEN ch > 50 THEN 'critical'
        ELSE 'warning' END AS severity FROM c WHERE ch > 25""",
    "trend_slope": """WITH v AS (SELECT user_id AS customer, ts::DATE AS day, avg(value) AS v FROM events GROUP BY ALL) SELECT customer,
          round(regr_slope(v, (day - DATE '1970-01-01')::DOUBLE), 6) AS slope, count(*) AS n FROM v GROUP BY customer HAVING count(*) >= 4""",
    "latest_drop": """WITH v AS (SELECT user_id AS customer, ts::DATE AS day, round(avg(value), 4) AS v FROM events GROUP BY ALL), l AS (SELECT *,
          lead(v) OVER w AS previous, row_number() OVER w AS k FROM v WINDOW w AS (PARTITION BY customer ORDER BY day DESC))
      SELECT customer, day, v AS value, previous, round(previous - v, 4) AS "drop", CASE WHEN previous - v > 4 THEN 'critical'
        ELSE 'warning' END AS severity FROM l WHERE k = 1 AND previous - v > 2""",
    "histogram_50": """WITH b AS (SELECT event_type, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo, CASE
          WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM events WHERE value IS NOT NULL GROUP BY 1)
      SELECT event_type, least(floor((value - lo) / ((hi - lo) / 50)) + 1, 50)::BIGINT AS bin, lo, hi, count(*) AS n FROM events
        JOIN b USING (event_type) WHERE value IS NOT NULL GROUP BY ALL""",
    "score_snapshot": """SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value),
          6) AS deviation, count(value) AS n FROM events GROUP BY 1""",
    "ks_two_sample": """WITH e AS (SELECT day(ts) > 15 AS b, round(value, 1) AS v FROM events), c AS (SELECT v, count(*) FILTER (NOT b) AS x,
          count(*) FILTER (b) AS y FROM e GROUP BY v),
      k AS (SELECT round(max(abs(p)), 6) AS ks FROM (SELECT sum(x) OVER (ORDER BY v) / (SELECT count(*) FROM e WHERE NOT b)::DOUBLE - sum(y)
        OVER (ORDER BY v) / (SELECT count(*) FROM e WHERE b)::DOUBLE AS p FROM c))
      SELECT ks, CASE WHEN ks > 0.3 THEN 'critical' WHEN ks > 0.1 THEN 'warning' END AS severity FROM k""",
    "kappa_pairs": """WITH s AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS agree FROM labels),
          p AS (SELECT sum(k * k) / (sum(k) * sum(k))::DOUBLE AS pe FROM (SELECT c, count(*)::DOUBLE AS k FROM (SELECT unnest([quality, toxic]) AS c
            FROM labels) GROUP BY c))
      SELECT n, agree, round((agree / n::DOUBLE - pe) / (1 - pe), 6) AS kappa FROM s, p""",
    "reviewer_kappa": """WITH j AS (SELECT o_orderkey % 200 AS item, o_custkey % 6 AS reviewer, arg_max(o_totalprice > 200000, o_orderkey) AS choice
          FROM orders GROUP BY ALL),
      b AS (SELECT x.reviewer AS r1, y.reviewer AS r2, x.choice AS c1, y.choice AS c2 FROM j x JOIN j y ON x.item = y.item
        AND x.reviewer < y.reviewer),
      t AS (SELECT r1, r2, count(*) AS n, count(*) FILTER (c1 = c2)::DOUBLE / count(*) AS po, (count(*) FILTER (c1)::DOUBLE * count(*)
        FILTER (c2) + count(*) FILTER (NOT c1)::DOUBLE * count(*) FILTER (NOT c2)) / (count(*)::DOUBLE * count(*)) AS pe FROM b GROUP BY r1, r2)
      SELECT r1, r2, n, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM t""",
    "overlapping_pairs": """SELECT least(l_partkey % 40, l_suppkey % 40) AS a, greatest(l_partkey % 40, l_suppkey % 40) AS b,
          count(DISTINCT l_orderkey % 5) AS reviewers FROM lineitem WHERE l_partkey % 40 <> l_suppkey % 40 AND l_linenumber <> 1 GROUP BY 1,
            2 HAVING count(DISTINCT l_orderkey % 5) > 1""",
    "reshown_pairs": """SELECT l_orderkey % 5 AS reviewer, least(l_partkey % 40, l_suppkey % 40) AS a, greatest(l_partkey % 40, l_suppkey % 40) AS b,
          count(*) AS times FROM lineitem WHERE l_partkey % 40 <> l_suppkey % 40 GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "confusion_counts": """WITH p AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_quantity > 25),
          t AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_discount > 0.04),
      c AS (SELECT count(*) FILTER (p.a IS NOT NULL AND t.a IS NOT NULL) AS tp, count(*) FILTER (t.a IS NULL) AS fp, count(*)
        FILTER (p.a IS NULL) AS fn FROM p FULL JOIN t ON p.a = t.a AND p.b = t.b)
      SELECT tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall,
        round(2.0 * tp / (2.0 * tp + fp + fn), 6) AS f1 FROM c""",
    "coverage_metrics": f"""WITH {_COHORT}, p AS (SELECT *, row_number() OVER (ORDER BY conf, uuid) AS i, count(*) OVER () AS n FROM cohort)
      SELECT count(*) AS total_candidates, round(100.0 * count(*) FILTER (uuid % 3 = 0 OR uuid % 5 = 0) / count(*), 2)::DOUBLE AS strong_key_pct,
        round(100.0 * count(*) FILTER (conf >= 0.7) / count(*), 2)::DOUBLE AS probabilistic_linkage_pct,
        round(100.0 * count(*) FILTER (p.p > 0) / count(*), 2)::DOUBLE AS pubmed_pct, round(100.0 * count(*) FILTER (g > 0) / count(*),
          2)::DOUBLE AS reporter_pct, round(100.0 * count(*) FILTER (t > 0) / count(*), 2)::DOUBLE AS ctgov_pct,
        round(100.0 * count(*) FILTER (p.p + g + t < 3) / count(*), 2)::DOUBLE AS thin_record_pct, {_EXCLUSIVE.format(p=0.05)} AS p5,
          {_EXCLUSIVE.format(p=0.5)} AS p50, {_EXCLUSIVE.format(p=0.95)} AS p95 FROM p""",
    "service_levels": _levels("source"),
    "service_breakdown": _levels("customer, source"),
    "health_pivot": f"""WITH {REQUESTS_SQL} SELECT source, count(*) FILTER (status = '2xx') AS n_2xx, count(*) FILTER (status = '4xx') AS n_4xx,
          count(*) FILTER (status = '5xx') AS n_5xx, count(*) FILTER (status = 'timeout') AS n_timeout, round(count(*)
            FILTER (status <> '2xx') / count(*)::DOUBLE, 6) AS error_rate FROM requests GROUP BY source""",
    "freshness": f"""WITH {REQUESTS_SQL}, s AS (SELECT * FROM (VALUES ('click', 1.0::DOUBLE), ('view', 48.0), ('never', 5.0)) v(source, h)),
          l AS (SELECT source, ({_AGE}) / 3600.0::DOUBLE AS a, avg(latency) AS g FROM requests GROUP BY source)
      SELECT coalesce(s.source, l.source) AS source, round(a, 4) AS age_hours, round(g, 6) AS mean_lag, coalesce(a, 'inf'::DOUBLE) <= coalesce(h,
        24.0) AS met FROM s FULL JOIN l ON s.source = l.source""",
    "refresh_sla": f"""WITH {REQUESTS_SQL}, s AS (SELECT * FROM (VALUES ('click', 0.1::DOUBLE, true), ('view', 48.0, true), ('never', 5.0,
          false)) v(source, h, g)), l AS (SELECT source, ({_AGE}) / 3600.0::DOUBLE AS a FROM requests GROUP BY source), j AS (SELECT s.*, coalesce(a,
            2 * h) AS a FROM s LEFT JOIN l USING (source))
      SELECT source, h AS sla_hours, g AS hard_gate, round(a, 4) AS age_hours, a > h AS breached, CASE WHEN a > h THEN CASE WHEN g THEN 'critical'
        ELSE 'warning' END END AS severity FROM j""",
    "stale_sources": f"""WITH {REQUESTS_SQL}, s AS (SELECT * FROM (VALUES ('click', 0.1::DOUBLE), ('view', 48.0), ('never', 5.0)) v(source, h)),
          l AS (SELECT source, ({_AGE}) / 3600.0::DOUBLE AS a FROM requests GROUP BY source)
      SELECT source, h AS sla_hours, round(a, 4) AS age_hours FROM s LEFT JOIN l USING (source) WHERE a IS NULL OR a > h""",
    "cost_grouping_sets": f"""SELECT user_id AS customer, event_type AS model, round(round(sum(value), 6), 4) AS cost, count(*) AS calls FROM events
          WHERE ts::DATE = DATE '{DAY}' GROUP BY GROUPING SETS ((user_id), (event_type), ())""",
    "over_budget": f"""WITH t AS (SELECT user_id AS customer, round(sum(value), 6) AS spent FROM events WHERE ts::DATE = DATE '{DAY}' GROUP BY 1)
      SELECT customer, round(spent, 4) AS spent, coalesce((c_custkey % 40)::DOUBLE, 1000.0) AS budget, spent >= coalesce(c_custkey % 40,
        1000.0) AS is_over FROM t LEFT JOIN customer ON c_custkey = customer AND c_custkey % 2 = 0""",
    "recall_set": """WITH e AS (SELECT DISTINCT l_orderkey AS q, l_partkey::VARCHAR AS u FROM lineitem WHERE l_quantity > 20),
          r AS (SELECT DISTINCT l_orderkey AS q, l_partkey::VARCHAR AS u FROM lineitem WHERE l_discount > 0.03),
      j AS (SELECT coalesce(e.q, r.q) AS q, e.u AS eu, r.u AS ru FROM e FULL JOIN r ON e.q = r.q AND e.u = r.u)
      SELECT q AS query, round(CASE WHEN count(eu) = 0 THEN 1.0 ELSE count(*) FILTER (eu = ru) / count(eu)::DOUBLE END, 6) AS recall,
        coalesce(string_agg(eu, ',' ORDER BY eu) FILTER (eu = ru), '') AS found, coalesce(string_agg(eu, ',' ORDER BY eu) FILTER (ru IS NULL),
          '') AS missed FROM j GROUP BY q""",
    "argmax_specialty": f"""WITH {PAPERS_SQL}, s AS (SELECT uuid, term, count(*) AS n FROM papers GROUP BY ALL), p AS (SELECT uuid, term, n / sum(n)
          OVER (PARTITION BY uuid)::DOUBLE AS p FROM s),
      b AS (SELECT uuid, term, count(*) FILTER (p > 0.2) OVER (PARTITION BY uuid) AS k FROM p QUALIFY row_number() OVER (PARTITION BY uuid
        ORDER BY p DESC, term DESC) = 1)
      SELECT term AS specialty, count(*) AS n, count(*) FILTER (k > 1) AS n_multi, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS pct
        FROM b GROUP BY term""",
    "signal_balance": f"""WITH {_COHORT}, s AS (SELECT uuid, CASE WHEN p + g + t > 0 THEN round(p / (p + g + t)::DOUBLE, 4) ELSE 0 END::DOUBLE AS a,
          CASE WHEN p + g + t > 0 THEN round(t / (p + g + t)::DOUBLE, 4) ELSE 0 END::DOUBLE AS b, CASE
            WHEN p + g + t > 0 THEN round(g / (p + g + t)::DOUBLE, 4) ELSE 0 END::DOUBLE AS c FROM cohort)
      SELECT uuid, a AS papers_share, b AS trials_share, c AS grants_share, greatest(a, b, c) > 0.7 AS dominant, greatest(a, b, c) >= 0.9 AS alert
        FROM s""",
    "linkage_shift": f"""WITH {_COHORT}, s AS (SELECT uuid, conf AS o, CASE WHEN uuid % 3 = 0 THEN conf + 0.15::DOUBLE ELSE conf END AS n FROM cohort
          WHERE uuid % 11 <> 0), k AS (SELECT *, round(n - o, 6) AS d, CASE WHEN o < 0.5 THEN 'holdout' WHEN o < 0.7 THEN 'flagged'
            ELSE 'linked' END AS a, CASE WHEN n < 0.5 THEN 'holdout' WHEN n < 0.7 THEN 'flagged' ELSE 'linked' END AS b FROM s)
      SELECT uuid, round(o, 4) AS old, round(n, 4) AS new, round(d, 4) AS delta, CASE WHEN a <> b THEN a || '->' || b END AS crossing FROM k
        WHERE d <> 0""",
}
