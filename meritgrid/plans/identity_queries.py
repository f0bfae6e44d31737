"""Queries over people, memberships, service levels and lookups, and their SQL."""

from __future__ import annotations

import uuid as uuids

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgrid.functions.positions import shared_folder
from meritgrid.operators import classify, cohort_log, lookups, monitoring, people, routing, sketches
from meritgrid.operators.index_store import StoredIndex
from meritgrid.plans.standins import candidates, papers, requests, table


def people_components(spark: SparkSession, d: str) -> DataFrame:
    """Customers as records with three keys, suppliers as stored people, nations' links: everyone's person."""
    c, s, u = table(spark, d, "customer"), table(spark, d, "supplier"), F.col("c_custkey")
    whole = lambda a, n: F.floor(a / n).cast("string")
    keys = F.create_map(
        F.lit("orcid"), F.when(u % 4 != 0, whole(u, 3)), F.lit("npi"), F.when(u % 2 == 0, whole(u, 6)), F.lit("era"), F.when(u % 5 == 0, whole(u, 50))
    )
    records = c.select(u.cast("string").alias("id"), keys.alias("strong_keys"))
    stored = s.select(F.concat(F.lit("S"), "s_suppkey").alias("uuid"), F.create_map(F.lit("orcid"),
        (F.col("s_suppkey") * 7).cast("string")).alias("strong_keys"))
    links = c.where(u % 97 == 0).select(u.cast("string").alias("id"), F.concat(F.lit("S"), whole(u, 97)).alias("uuid"))
    return people.resolve_people(records, stored, links)


def _cohort_log(spark: SparkSession, d: str) -> DataFrame:
    """Each customer joins or leaves its segment's cohort with an order: joins by open ones, leaves by filled ones."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    action = F.when(F.col("o_orderstatus") == "O", "add").when(F.col("o_orderstatus") == "F", "remove").otherwise("note")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("cohort"), F.col("c_custkey").alias("uuid"), action.alias("action"), F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("entry_id"), F.col("o_orderpriority").alias("reason"),
    )


def cohort_members(spark: SparkSession, d: str) -> DataFrame:
    """How many members each cohort had at the end of the first day of each month of the log."""
    log = _cohort_log(spark, d)
    days = log.select("cohort", F.trunc(F.to_date("ts"), "month").alias("day")).distinct()
    return cohort_log.members_on(cohort_log.memberships(log), days).groupBy("cohort", "day").agg(F.count(F.lit(1)).alias("members"))


def cohort_daily(spark: SparkSession, d: str) -> DataFrame:
    return cohort_log.daily_summary(_cohort_log(spark, d)).select("cohort", "day", "added", "removed", "net")


def rolling_levels(spark: SparkSession, d: str) -> DataFrame:
    """Exact service levels of each source over the 30 days up to each day that has requests."""
    r = requests(spark, d).withColumn("day", F.to_date("ts"))
    return monitoring.rolling_levels(r, "source", sketches.DAYS)


def sketched_levels(spark: SparkSession, d: str) -> DataFrame:
    """The same from one sketch a day and source: counts are exact, p95 and p99 by rank within a hundredth."""
    r = requests(spark, d)
    daily = sketches.daily_sketches(r, "source")
    return sketches.rolling(daily, r.select(F.to_date("ts").alias("day")), "source")


def indexed_terms(spark: SparkSession, d: str) -> DataFrame:
    """People by the terms of their papers, through an index on disk that is removed when the session's folder is."""
    entries = papers(spark, d).select("term", F.col("uuid").alias("uuid")).distinct()
    index = StoredIndex(spark, f"{shared_folder(spark)}/index-{uuids.uuid4().hex}")
    index.build(entries)
    asked = table(spark, d, "part").select(F.col("p_type").alias("term")).distinct()
    return index.join(asked).groupBy("term").agg(F.count(F.lit(1)).alias("people"), F.min("uuid").alias("first"))


def roster_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Roster entries of names that several nations share, narrowed by the nation where that is possible."""
    c = candidates(spark, d)
    name = F.concat(F.lit("Person "), F.floor(F.col("uuid") / 3))
    members = c.select(name.alias("name"), F.col("country").alias("institution"), F.col("segment").alias("roster_type"))
    asked = F.when(F.col("uuid") % 2 == 0, F.substring("country", 1, 4)).when(F.col("uuid") % 7 == 0, "nowhere")
    questions = c.select(F.col("uuid").alias("id"), F.upper(name).alias("asked_name"), asked.alias("asked_institution"))
    found = lookups.roster_members(questions, members)
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("institution").alias("institution"), F.max("roster_type").alias("roster_type"))


def retraction_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Parts as notices with two authors, looked up by pieces of names and by number."""
    p = table(spark, d, "part")
    notices = p.select(F.col("p_partkey").cast("string").alias("pmid"), F.array("p_brand", F.concat_ws(" ", "p_type", "p_brand")).alias("authors"),
        F.col("p_brand").alias("reason"))
    asked = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.lower(F.substring("p_brand", 3,
        6)).alias("author")).groupBy("author").agg(F.min("id").alias("id"))
    by_name = lookups.retractions_of_authors(asked, notices)
    by_number = lookups.retractions_of_papers(p.select((-F.col("p_partkey")).alias("id"), F.col("p_partkey").cast("string").alias("pmid")), notices)
    return by_name.unionByName(by_number).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("pmid").alias("pmid"),
        F.max("reason").alias("reason"))


def contest_history(spark: SparkSession, d: str) -> DataFrame:
    """Returned lines as contests of customers with a negative balance, the latest three of each."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    contests = o.select(F.col("o_custkey").alias("uuid"), F.col("o_orderkey").alias("contest_id"), F.col("o_orderdate").alias("submitted_at"))
    people_ = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("uuid"))
    return lookups.contests_of(contests, people_).where("place <= 3").select("uuid", "contest_id", "place")


def vector_changes(spark: SparkSession, d: str) -> DataFrame:
    """Shares of order priorities by segment as vectors, of two halves of the customers."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))

    def vector(odd: int) -> DataFrame:
        own = rows.where((F.col("c_custkey") % 2 == odd) & ((F.lit(odd) == 0) | ~F.col("o_orderpriority").startswith("5")))
        return own.groupBy(F.col("c_mktsegment").alias("specialty"),
            F.col("o_orderpriority").alias("parameter")).agg((F.count(F.lit(1)) / F.lit(100.0)).alias("value"))

    return routing.vector_shifts(vector(0), vector(1))


def specialty_mix(spark: SparkSession, d: str) -> DataFrame:
    """Customers by the shares of their lines, orders and parts that are of one kind."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("uuid")).agg(
        F.count(F.lit(1)).alias("n_papers"), F.count_if(F.col("l_returnflag") != "N").alias("n_papers_in"),
        F.count_if(F.col("l_linenumber") == 1).alias("n_trials"),
            F.count_if((F.col("l_linenumber") == 1) & (F.col("o_orderstatus") == "F")).alias("n_trials_in"),
        F.count_if(F.col("l_discount") > 0.05).alias("n_grants"),
            F.count_if((F.col("l_discount") > 0.05) & (F.col("l_tax") > 0.02)).alias("n_grants_in"),
    )
    found = classify.mix_flags(lines)
    return found.select("uuid", F.round("paper_ratio", 6).alias("paper_ratio"), F.round("confidence", 6).alias("confidence"), (F.round("confidence",
        6) < 0.7).alias("ambiguous"))


def source_changes(spark: SparkSession, d: str) -> DataFrame:
    """Shares of customers by kinds of events, now and before: a kind that only one side has counts against zero."""
    e = table(spark, d, "events")

    def shares(test) -> DataFrame:
        return monitoring.source_shares(e.where(test).groupBy(F.col("user_id").alias("uuid")).agg(F.collect_set("event_type").alias("sources")))

    now, before = shares(~((F.col("event_type") == "click") & (F.col("event_id") % 2 == 0))), shares((F.col("event_id") % 2 == 1) & (F.col("event_type") != "view"))
    return monitoring.metric_changes(now, before)


def fallback_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Nations as queries whose rankings collapse by the balance of their customers, once and again."""
    c = candidates(spark, d)
    queries = c.select(F.col("country").alias("query")).distinct().withColumn("terms", F.array("query"))
    parents = c.select(F.col("country").alias("term"), F.substring("country", 1, 1).alias("parent")).distinct()
    first = routing.collapsed(queries, c.select(F.col("country").alias("query"), (F.col("balance") / 1e5).alias("score")).where("score < 0.0999"),
        parents, 0.0996)
    again = c.where("uuid % 2 = 0").select(F.col("country").alias("query"), (F.col("balance") / 1e5).alias("score"))
    return routing.collapsed_again(first, again, 0.098).select("query", "collapsed", F.array_join("terms", ",").alias("terms"), "flag", "retries")


QUERIES = {
    f.__name__: f
    for f in (
        people_components, cohort_members, cohort_daily, rolling_levels, sketched_levels, indexed_terms, roster_lookup, retraction_lookup,
            contest_history,
        vector_changes, specialty_mix, source_changes, fallback_cohort,
    )
}

_LOG = """log AS (SELECT c_mktsegment AS cohort, c_custkey AS uuid, CASE o_orderstatus WHEN 'O' THEN 'add' WHEN 'F' THEN 'remove'
      ELSE 'note' END AS action,
    o_orderdate AS ts, o_orderkey AS entry_id FROM orders JOIN customer ON o_custkey = c_custkey)"""
_SHARES = """SELECT 'per_source_' || event_type AS metric, round(100.0 * count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events
      WHERE {t}), 2) AS value
    FROM events WHERE {t} GROUP BY event_type"""

ORACLE_SQL = {
    "people_components": """WITH RECURSIVE k AS (SELECT 'record' AS kind, c_custkey::VARCHAR AS id, unnest([CASE
          WHEN c_custkey % 4 <> 0 THEN 'orcid:' || c_custkey // 3 END,
        CASE WHEN c_custkey % 2 = 0 THEN 'npi:' || c_custkey // 6 END, CASE WHEN c_custkey % 5 = 0 THEN 'era:' || c_custkey // 50 END]) AS k
          FROM customer
      UNION ALL SELECT 'stored', 'S' || s_suppkey, 'orcid:' || s_suppkey * 7 FROM supplier),
      keys AS (SELECT * FROM k WHERE k IS NOT NULL),
      nodes AS (SELECT 'record' AS kind, c_custkey::VARCHAR AS id FROM customer UNION ALL SELECT 'stored', 'S' || s_suppkey FROM supplier),
      e AS (SELECT kind, id, min(kind || id) OVER (PARTITION BY k) AS other FROM keys
        UNION SELECT 'record', c_custkey::VARCHAR, 'stored' || 'S' || c_custkey // 97 FROM customer JOIN supplier ON s_suppkey = c_custkey // 97
          WHERE c_custkey % 97 = 0),
      both_ways AS (SELECT kind || id AS a, other AS b FROM e UNION SELECT other, kind || id FROM e),
      r(n, c) AS (SELECT kind || id, kind || id FROM nodes UNION SELECT b, c FROM r JOIN both_ways ON a = n),
      g AS (SELECT n, min(c) AS c FROM r GROUP BY n),
      m AS (SELECT g.c, min(nodes.id) FILTER (nodes.kind = 'stored') AS known, min(keys.k) AS k, min(nodes.id) FILTER (nodes.kind = 'record') AS least
        FROM g JOIN nodes ON nodes.kind || nodes.id = g.n LEFT JOIN keys ON keys.kind = nodes.kind AND keys.id = nodes.id GROUP BY g.c)
      SELECT kind, id, coalesce(known, substr(sha256(coalesce(k, 'id:' || least)), 1, 32)) AS uuid, known IS NULL AS is_new FROM nodes
        JOIN g ON g.n = kind || id JOIN m ON m.c = g.c""",
    "cohort_members": f"""WITH {_LOG}, t AS (SELECT *, coalesce(lag(action) OVER w, 'remove') AS before FROM log
          WHERE action <> 'note' WINDOW w AS (PARTITION BY cohort, uuid ORDER BY ts, entry_id)),
      s AS (SELECT cohort, uuid, action, ts AS since, lead(ts) OVER (PARTITION BY cohort, uuid ORDER BY ts, entry_id) AS until FROM t
        WHERE action <> before),
      d AS (SELECT DISTINCT cohort, date_trunc('month', ts)::DATE AS day FROM log)
      SELECT d.cohort, d.day, count(DISTINCT uuid) AS members FROM d JOIN s ON s.cohort = d.cohort AND action = 'add' AND since::DATE <= day
        AND (until IS NULL OR until::DATE > day) GROUP BY d.cohort, d.day""",
    "cohort_daily": f"""WITH {_LOG} SELECT cohort, ts::DATE AS day, count(*) FILTER (action = 'add') AS added, count(*)
          FILTER (action = 'remove') AS removed,
      count(*) FILTER (action = 'add') - count(*) FILTER (action = 'remove') AS net FROM log GROUP BY ALL""",
    "rolling_levels": """WITH r AS (SELECT event_id AS id, ts::DATE AS day, event_type AS source, value AS latency, event_id % 50 <> 0 AS success
          FROM events), d AS (SELECT DISTINCT day AS as_of FROM r),
      j AS (SELECT as_of, source, latency, success, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY as_of, source) AS n FROM d
        JOIN r ON day BETWEEN as_of - 29 AND as_of WINDOW w AS (PARTITION BY as_of, source ORDER BY latency, id))
      SELECT as_of, source, count(*) AS requests, max(latency) FILTER (i = floor((n - 1) * 0.95)) AS p95, max(latency)
        FILTER (i = floor((n - 1) * 0.99)) AS p99,
        round(1 - count(*) FILTER (NOT success) / count(*), 6) AS success_rate, round(count(*) FILTER (NOT success) / ((1 - 0.999) * count(*)) * 100,
          4) AS budget_used_pct FROM j GROUP BY as_of, source""",
    "indexed_terms": """SELECT p_type AS term, count(DISTINCT o_custkey) AS people, min(o_custkey) AS first FROM lineitem
          JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY p_type""",
    "roster_lookup": """WITH m AS (SELECT c_custkey AS uuid, c_custkey // 3 AS k, n_name, c_mktsegment AS seg FROM customer
          JOIN nation ON n_nationkey = c_nationkey),
      q AS (SELECT uuid AS id, k, CASE WHEN uuid % 2 = 0 THEN left(n_name, 4) WHEN uuid % 7 = 0 THEN 'nowhere' END AS asked FROM m),
      j AS (SELECT id, n_name, seg, asked IS NOT NULL AND contains(lower(n_name), lower(asked)) AS here FROM q JOIN m USING (k)),
      w AS (SELECT *, max(here) OVER (PARTITION BY id) AS found, count(*) OVER (PARTITION BY id) AS n FROM j)
      SELECT id, count(*) AS n, min(n_name) AS institution, max(seg) AS roster_type FROM w WHERE n = 1 OR NOT found OR here GROUP BY id""",
    "retraction_lookup": """WITH q AS (SELECT lower(substr(p_brand, 3, 6)) AS author, min(p_partkey) AS id FROM part WHERE p_partkey % 3 = 0
          GROUP BY ALL),
      f AS (SELECT id, p_partkey::VARCHAR AS pmid, p_brand AS reason FROM q JOIN part ON contains(lower(p_brand), author)
        OR contains(lower(p_type || ' ' || p_brand), author)
        UNION ALL SELECT -p_partkey, p_partkey::VARCHAR, p_brand FROM part)
      SELECT id, count(*) AS n, min(pmid) AS pmid, max(reason) AS reason FROM f GROUP BY id""",
    "contest_history": """SELECT uuid, contest_id, place FROM (SELECT o_custkey AS uuid, o_orderkey AS contest_id, (row_number()
          OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey))::INT AS place
      FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0) WHERE place <= 3""",
    "vector_changes": """WITH r AS (SELECT c_mktsegment AS s, o_orderpriority AS p, c_custkey % 2 AS odd FROM orders
          JOIN customer ON c_custkey = o_custkey),
      v AS (SELECT s, p, count(*) FILTER (odd = 0) / 100.0 AS a, count(*) FILTER (odd = 1 AND left(p, 1) <> '5') / 100.0 AS b FROM r GROUP BY s, p),
      w AS (SELECT *, abs(b - a) AS c, CASE WHEN abs(a) < 1e-10 THEN CASE WHEN abs(b - a) > 0.01 THEN 100.0 ELSE 0.0 END
        ELSE 100.0 * abs(b - a) / abs(a) END AS t FROM v)
      SELECT s AS specialty, p AS parameter, a::DOUBLE AS old_value, b::DOUBLE AS new_value, round(c::DOUBLE, 6) AS change, round(t::DOUBLE,
        2) AS change_pct, t > 20 AS exceeds FROM w WHERE a > 0 OR b > 0""",
    "specialty_mix": """WITH t AS (SELECT o_custkey AS uuid, count(*) AS p, count(*) FILTER (l_returnflag <> 'N') AS pi, count(*)
          FILTER (l_linenumber = 1) AS t, count(*) FILTER (l_linenumber = 1 AND o_orderstatus = 'F') AS ti,
        count(*) FILTER (l_discount > 0.05) AS g, count(*) FILTER (l_discount > 0.05 AND l_tax > 0.02) AS gi FROM lineitem
          JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
      c AS (SELECT uuid, pi / greatest(p, 1) AS r, round(0.5 * (pi / greatest(p, 1)) + 0.3 * (ti / greatest(t, 1)) + 0.2 * (gi / greatest(g, 1)),
        6) AS c FROM t)
      SELECT uuid, round(r, 6) AS paper_ratio, c AS confidence, c < 0.7 AS ambiguous FROM c""",
    "source_changes": f"""WITH a AS ({_SHARES.format(t="NOT (event_type = 'click' AND event_id % 2 = 0)")}),
          b AS ({_SHARES.format(t="event_id % 2 = 1 AND event_type <> 'view'")})
      SELECT coalesce(a.metric, b.metric) AS metric, round(coalesce(a.value, 0) - coalesce(b.value, 0), 2)::DOUBLE AS delta FROM a FULL
        JOIN b ON a.metric = b.metric""",
    "fallback_cohort": """WITH c AS (SELECT c_custkey AS u, n_name AS q, c_acctbal / 1e5 AS s FROM customer JOIN nation ON n_nationkey = c_nationkey),
      f AS (SELECT q, coalesce(max(s) FILTER (s < 0.0999), 0) < 0.0996 AS gone, coalesce(max(s) FILTER (u % 2 = 0), 0) < 0.098 AS again FROM c
        GROUP BY q)
      SELECT q AS query, gone AND again AS collapsed, CASE WHEN gone AND again THEN '' WHEN gone THEN array_to_string(list_sort([q, left(q, 1)]),
        ',') ELSE q END AS terms,
        CASE WHEN gone AND again THEN 'cohort_fallback' WHEN gone THEN 'expanded' ELSE 'normal' END AS flag, CASE WHEN gone AND again THEN 2
          WHEN gone THEN 1 ELSE 0 END AS retries FROM f""",
}
