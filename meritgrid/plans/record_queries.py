"""Queries over logs, snapshots and trails, and their SQL."""

from __future__ import annotations

import uuid as uuids

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgrid.functions.positions import shared_folder
from meritgrid.operators import learning, logs, privacy, routing
from meritgrid.plans.standins import candidates, table
from meritgrid.plans.store_queries import fit_pairs


def logged_events(spark: SparkSession, d: str) -> DataFrame:
    """Events appended to a log on disk in three batches that overlap, and counted by day."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    log = logs.DayLog(spark, f"{shared_folder(spark)}/log-{uuids.uuid4().hex}", "event_id bigint, event_type string, ts timestamp_ntz, value double",
        "ts", ["event_id"])
    for test in ("event_id % 3 <> 0", "event_id % 3 <> 1", "event_id % 2 = 0"):
        log.append(e.where(test))
    return log.read().groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def snapshot_rows(spark: SparkSession, d: str) -> DataFrame:
    """Daily snapshots of each kind of event, put twice: a day and kind that come again replace what is there."""
    e = table(spark, d, "events")
    daily = e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    log = logs.DayLog(spark, f"{shared_folder(spark)}/log-{uuids.uuid4().hex}", "day date, event_type string, n bigint", "day", ["event_type"])
    log.put(daily)
    log.put(daily.where("event_type <> 'click'").withColumn("n", F.col("n") * 10))
    return logs.latest_snapshots(log.read(), "event_type", "day", 7)


def _recalls(spark: SparkSession, d: str) -> DataFrame:
    """The share of filled orders by nation and month as recalls of queries."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    month = F.trunc(F.to_date("o_orderdate"), "month")
    return rows.groupBy(F.col("n_name").alias("query"),
        month.alias("run_date")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("recall"))


def recall_trend(spark: SparkSession, d: str) -> DataFrame:
    day = lambda t: F.lit(t).cast("date")
    found = logs.recall_trend(_recalls(spark, d), day("1997-02-01"), day("1997-01-01"))
    return found.select("query", F.round("now", 6).alias("now"), F.round("before", 6).alias("before"), "delta", "alert")


def recall_passes(spark: SparkSession, d: str) -> DataFrame:
    found = logs.recall_passes(_recalls(spark, d), 0.35)
    return found.select("run_date", F.round("mean_recall", 6).alias("mean_recall"), (F.round("mean_recall", 6) >= 0.35).alias("passes"))


def archetypes(spark: SparkSession, d: str) -> DataFrame:
    """Nations as archetypes that expect the parts of their suppliers' numbers and orders, some of which are stored."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    wanted = s.groupBy(F.col("s_nationkey").cast("string").alias("archetype_id")).agg(
        F.collect_list(k).alias("pmids"), F.collect_list(F.when(F.col("s_suppkey") % 2 == 0, k)).alias("nct_ids"),
            F.collect_list(F.when(F.col("s_suppkey") % 9 == 0, F.concat(F.lit("x"), k))).alias("grant_ids")
    )
    wanted = wanted.withColumn("in_scope", F.col("archetype_id") != "3")
    stored = s.where("s_suppkey % 5 <> 0").select(F.lit("pmid").alias("type"),
        k.alias("id")).unionByName(s.where("s_suppkey % 4 = 0").select(F.lit("nct_id").alias("type"), k.alias("id")))
    found = logs.archetype_coverage(wanted, stored)
    return found.select("archetype_id", "expected", "found", "coverage", F.array_join("missing", ",").alias("missing"), "passes")


def gate_totals(spark: SparkSession, d: str) -> DataFrame:
    """What the privacy gate decides about customers, some with a number in their notes, some of whom opted out."""
    u = F.col("uuid")
    c = candidates(spark, d).select(u, F.when(u % 11 == 0, F.concat(F.lit("call 555-123-"), F.lpad((u % 10000).cast("string"), 4,
        "0"))).otherwise("none").alias("notes"))
    out = c.where("uuid % 3 = 0").select("uuid", F.when(u % 2 == 0, "opt_out").otherwise("opt_in").alias("action"), F.lit(1).alias("ts"),
        F.lit(1).alias("seq"))
    return logs.gate_totals(privacy.privacy_gate(c, out, ["notes"]))


def stripped_fields(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d).select("uuid", F.when(F.col("uuid") % 2 == 0, "x").alias("gender"), F.col("country").alias("nationality"),
        F.col("segment").alias("page"))
    return logs.stripped_fields(c, [n for n in c.columns if privacy.field_blocked(n)])


def full_trails(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their latest orders and their suppliers' nation as evidence."""
    c, o = candidates(spark, d).select("uuid", "name"), table(spark, d, "orders")
    scores = o.select(F.col("o_custkey").alias("uuid"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("order_key"))
    contests = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("uuid"), F.col("o_orderkey").alias("contest_id"))
    found = logs.trails(c, {"scores": (scores, "day"), "contests": (contests, "contest_id")}, 2)
    keys = lambda name, key: F.array_join(F.transform(name, lambda r: r[key].cast("string")), ",")
    return found.select("uuid", "n_scores", "n_contests", keys("scores", "order_key").alias("scores"), keys("contests",
        "contest_id").alias("contests"))


def specialty_counts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in all, by segment and by segment and country."""
    return candidates(spark, d).rollup("segment", "country").agg(F.count(F.lit(1)).alias("n"))


def refit_cycle(spark: SparkSession, d: str) -> DataFrame:
    """From judged pairs of order lines to a written version, approved where it has to be, and read back: the first
    version and what the cycle made of it."""
    folder = f"{shared_folder(spark)}/vectors-{uuids.uuid4().hex}"
    first = {"specialty": "lines", "weights": {"f1_rcr": 0.6, "f3_leadership": 0.4}, "exponent_bounds": {}}
    routing.write_vector(first, learning.START, folder, "2024-01-01")
    done = learning.refit(fit_pairs(spark, d), folder, "lines", "2024-02-01")
    if done["action"] == "manual":
        routing.approve(str(done["path"]))
    vectors = routing.weight_vectors(spark, folder)
    return vectors.select("version", "created", "parameter", F.round("value", 4).alias("value"), F.lit(str(done["action"])).alias("action"))


QUERIES = {
    f.__name__: f
    for f in (logged_events, snapshot_rows, recall_trend, recall_passes, archetypes, gate_totals, stripped_fields, full_trails, specialty_counts,
        refit_cycle)
}

_RECALLS = """r AS (SELECT n_name AS query, date_trunc('month', o_orderdate)::DATE AS run_date, count(*)
      FILTER (o_orderstatus = 'F') / count(*) AS recall
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"""

ORACLE_SQL = {
    "logged_events": "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "snapshot_rows": """WITH s AS (SELECT ts::DATE AS day, event_type, count(*) * CASE WHEN event_type = 'click' THEN 1 ELSE 10 END AS n FROM events
          GROUP BY 1, 2)
      SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY day DESC))::INT AS place FROM s QUALIFY place <= 7""",
    "recall_trend": f"""WITH {_RECALLS} SELECT query, round(a.recall, 6) AS now, round(b.recall, 6) AS before, round(a.recall - b.recall,
          6) AS delta, round(a.recall - b.recall, 9) < -0.05 AS alert
      FROM r a JOIN r b USING (query) WHERE a.run_date = DATE '1997-02-01' AND b.run_date = DATE '1997-01-01'""",
    "recall_passes": f"""WITH {_RECALLS} SELECT run_date, round(avg(recall), 6) AS mean_recall, round(avg(recall), 6) >= 0.35 AS passes FROM r
          GROUP BY run_date""",
    "archetypes": """WITH e AS (SELECT s_nationkey::VARCHAR AS a, 'pmid' AS t, s_suppkey::VARCHAR AS id, s_suppkey % 5 <> 0 AS there FROM supplier
        UNION ALL SELECT s_nationkey::VARCHAR, 'nct_id', s_suppkey::VARCHAR, s_suppkey % 4 = 0 FROM supplier WHERE s_suppkey % 2 = 0
        UNION ALL SELECT s_nationkey::VARCHAR, 'grant_id', 'x' || s_suppkey, false FROM supplier WHERE s_suppkey % 9 = 0)
      SELECT a AS archetype_id, count(*) AS expected, count(*) FILTER (there) AS found, round(count(*) FILTER (there) / count(*), 6) AS coverage,
        coalesce(string_agg(t || ':' || id, ',' ORDER BY t || ':' || id) FILTER (NOT there), '') AS missing, a = '3' OR count(*)
          FILTER (there) / count(*) >= 0.95 AS passes FROM e GROUP BY a""",
    "gate_totals": """WITH d AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'p' WHEN c_custkey % 6 = 0 THEN 'o' ELSE 'a' END AS d FROM customer)
      SELECT count(*) AS checked, count(*) FILTER (d = 'a') AS allowed, count(*) FILTER (d = 'p') AS rejected_phi, 0::BIGINT AS stripped, count(*)
        FILTER (d = 'o') AS excluded_opt_out FROM d""",
    "stripped_fields": """SELECT 'gender' AS field, count(*) FILTER (c_custkey % 2 = 0) AS n FROM customer UNION ALL SELECT 'nationality', count(*)
          FROM customer""",
    "full_trails": """WITH p AS (SELECT o_custkey AS u, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC,
          o_orderkey) AS i FROM orders),
      s AS (SELECT u, count(*) AS n, string_agg(k::VARCHAR, ',' ORDER BY i) FILTER (i <= 2) AS ks FROM p GROUP BY u),
      q AS (SELECT o_custkey AS u, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS i FROM orders
        WHERE o_orderstatus = 'P'),
      t AS (SELECT u, count(*) AS n, string_agg(k::VARCHAR, ',' ORDER BY i) FILTER (i <= 2) AS ks FROM q GROUP BY u)
      SELECT c_custkey AS uuid, coalesce(s.n, 0) AS n_scores, coalesce(t.n, 0) AS n_contests, coalesce(s.ks, '') AS scores, coalesce(t.ks,
        '') AS contests
      FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN s ON s.u = c_custkey LEFT JOIN t ON t.u = c_custkey""",
    "specialty_counts": """SELECT c_mktsegment AS segment, n_name AS country, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey
          GROUP BY ROLLUP (c_mktsegment, n_name)""",
}
