"""Queries over changing tables, learning and event time, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meritgrid.operators import expansion, learning, store
from meritgrid.plans.standins import PAPERS_SQL, candidates, papers, requests, table
from meritgrid.streaming import events as ev


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return store.latest(e, ["user_id", "event_type"], "ts", "event_id")


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d).select("uuid", "name", "balance", F.lit("old").alias("created"))
    changed = c.where("uuid % 3 = 0").select(
        "uuid",
        F.concat("name", F.lit("!")).alias("name"),
        (F.col("balance") + 1).alias("balance"),
        F.lit("new").alias("created"),
    )
    fresh = c.where("uuid % 100 = 0").select((F.col("uuid") + 10_000_000).alias("uuid"), "name", "balance", F.lit("new").alias("created"))
    return store.upsert(c, changed.unionByName(fresh), ["uuid"], keep=["created"]).withColumn("balance", F.round("balance", 2))


def insert_missing(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    rows = candidates(spark, d).select(F.col("uuid").alias("k"), F.col("name").alias("v"))
    return store.insert_missing(s, rows, ["k"])


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("type"),
        F.col("l_partkey").alias("id"),
        (F.col("l_suppkey") % 4).alias("source"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def canonical_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return store.canonical(_artifacts(spark, d), (F.col("source") + 1) % 4)[0]


def cross_reference_edges(spark: SparkSession, d: str) -> DataFrame:
    return store.canonical(_artifacts(spark, d), (F.col("source") + 1) % 4)[1]


def queue_priority_next(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "integrity").when(F.col("o_orderpriority").startswith("2"), "identity").when(
        F.col("o_orderpriority").startswith("3"),
        "affiliation",
    ).otherwise("other")
    return store.next_in_queue(
        o.select(F.col("o_orderkey").alias("item"), kind.alias("category"), F.col("o_orderdate").alias("submitted_at")),
        "category",
        "submitted_at",
        25,
    )


def _queue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderdate").cast("timestamp").alias("submitted_at"))
    done = table(spark, d, "lineitem").where("l_orderkey % 3 = 0").select(
        F.col("l_orderkey").alias("item"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.when(F.col("l_linenumber") % 2 == 0, "accepted").otherwise("rejected").alias("decision"),
    )
    return q, done


def resolution_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.resolution_stats(*_queue(spark, d))


def queue_status(spark: SparkSession, d: str) -> DataFrame:
    q, done = _queue(spark, d)
    one = done.groupBy("item", "ts").agg(F.min("decision").alias("decision"))
    return store.status(q, one).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def page_limit_offset(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return store.page(o, [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 20)


def inverted_index_lookup(spark: SparkSession, d: str) -> DataFrame:
    index = papers(spark, d).select(F.col("term").alias("descriptor"), "uuid").distinct()
    return store.lookup(index, "descriptor", "PROMO", 100, "uuid")


def yearly_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("uuid"), "o_orderdate", F.col("o_orderpriority").alias("type"))
    return store.yearly_counts(o, "o_orderdate")


def _id_lists(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("uuid")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("ids"))


def artifact_hash(spark: SparkSession, d: str) -> DataFrame:
    return _id_lists(spark, d).select("uuid", store.artifact_set_hash(F.col("ids")).alias("hash"))


def incremental_anti(spark: SparkSession, d: str) -> DataFrame:
    rows = _id_lists(spark, d)
    log = rows.where("uuid % 3 <> 0").select(
        "uuid",
        store.artifact_set_hash(F.col("ids")).alias("hash"),
        (F.lit(1) + (F.col("uuid") % 2).cast("int")).alias("version"),
    )
    return store.to_recompute(rows, log, 2).select("uuid")


def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    asked = docs.select(store.cache_key(F.col("source"), F.lit("v2")).alias("key"))
    cache = docs.where("source in ('src1', 'src2', 'src7')").select(store.cache_key(F.col("source"), F.lit("v2")).alias("key")).distinct()
    return store.cache_stats(store.cached(asked, cache, ["key"]))


def recent_per_key(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id")
    return store.recent_per_key(e, "user_id", "event_id", 5)


def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


def intersect_keys(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k")).intersect(li.where("l_returnflag = 'R'").select("l_orderkey"))


def except_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(
        spark,
        d,
        "customer",
    ).select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


def evidence_union(spark: SparkSession, d: str) -> DataFrame:
    """One feed of a candidate's evidence from three kinds, with facet counts."""
    p = papers(spark, d).select("uuid", F.lit("publication").alias("category"))
    g = table(spark, d, "orders").select(F.col("o_custkey").alias("uuid"), F.lit("grant").alias("category"))
    c = candidates(spark, d).select("uuid", F.lit("profile").alias("category"))
    return p.unionByName(g).unionByName(c).groupBy("uuid", "category").agg(F.count(F.lit(1)).alias("n"))


def json_props_agg(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.max(k).alias("top"), F.count(k).alias("n"))


def judged_cross_pairs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    j = li.select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("uuid"), (F.col("l_quantity") > 25).alias("relevant"))
    return learning.judged_pairs(j)


def adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return learning.adjacent_pairs(li, "l_orderkey", "l_quantity", "l_linenumber")


def triangular_unjudged(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    pairs = learning.triangular_pairs(li.select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")
    judged = pairs.where("(a + b) % 3 = 0")
    return pairs.join(judged, ["l_orderkey", "a", "b"], "left_anti")


def pair_sampling(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d).select("uuid", F.col("balance").alias("score"))
    judged = c.where("uuid % 5 = 0").select(F.col("uuid").alias("a"), (F.col("uuid") + 1).alias("b"))
    return learning.sampled_pairs(c, judged, 200)


def fit_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of neighbouring order lines, preferred by value: wq, wt, wr of the one, lq, lt, lr of the other."""
    li = table(spark, d, "lineitem")
    x = li.select(
        "l_orderkey",
        "l_linenumber",
        ((F.col("l_quantity") + 1) / 52).alias("q"),
        ((F.col("l_discount") + 0.01) / 0.12).alias("t"),
        ((F.col("l_tax") + 0.01) / 0.1).alias("r"),
        F.col("l_extendedprice").alias("v"),
    )
    nxt = x.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), *(F.col(c).alias(f"{c}2") for c in "qtrv"))
    p = x.join(nxt, ["l_orderkey", "l_linenumber"])
    wins = F.col("v") >= F.col("v2")
    winner = [F.when(wins, F.col(c)).otherwise(F.col(f"{c}2")).alias(f"w{c}") for c in "qtr"]
    loser = [F.when(wins, F.col(f"{c}2")).otherwise(F.col(c)).alias(f"l{c}") for c in "qtr"]
    return p.select(*winner, *loser)


def exponent_fit(spark: SparkSession, d: str) -> DataFrame:
    """The fit on pairs of order lines: three exponents, half-widths, decision."""
    fit = learning.fit_exponents(fit_pairs(spark, d))
    schema = "alpha double, beta double, gamma double, ci_alpha double, ci_beta double, ci_gamma double, decision string, n_pairs long"
    row = (*(round(v, 4) for v in (*fit.exponents, *fit.half_widths)), learning.deployment(learning.START, fit), fit.n_pairs)
    return spark.createDataFrame([row], schema)


def pair_likelihood(spark: SparkSession, d: str) -> DataFrame:
    return learning.negative_log_likelihood(fit_pairs(spark, d), learning.START).withColumn("nll", F.round("nll", 3))


def code_terms(spark: SparkSession, d: str) -> DataFrame:
    """Diagnosis codes made of order keys, looked up in the built-in table: as written, undotted, by prefix."""
    k = F.col("o_orderkey")
    code = F.concat(F.element_at(F.array(F.lit("C34."), F.lit("c91"), F.lit("I50"), F.lit("X0")), (k % 4).cast("int") + 1), (k % 10).cast("string"))
    codes = table(spark, d, "orders").select(code.alias("code")).distinct()
    return expansion.diagnosis_terms(codes, expansion.code_table(spark, expansion.DIAGNOSES))


def sliding_60s_count(spark: SparkSession, d: str) -> DataFrame:
    return ev.sliding_counts(requests(spark, d), "source").select("id", "source", "in_window", "burst")


def same_query_count(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d).withColumn("query_hash", F.col("source"))
    return ev.same_query_counts(r).select("id", "same", "suspicious")


def token_bucket_replay(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d).select(F.col("customer"), "id", "ts")
    return ev.replay_buckets(r, 0.0002, 2.0).withColumn("tokens", F.round("tokens", 4))


def tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    w = ev.windowed_counts(table(spark, d, "events"), "ts", "6 hours", None, None, "event_type")
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def session_window(spark: SparkSession, d: str) -> DataFrame:
    s = ev.sessions(table(spark, d, "events"), "ts", "2 hours", "user_id")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's last click at or before it: one pass over both, ordered within a user."""
    e = table(spark, d, "events").where("event_type in ('click', 'purchase')")
    run = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    click = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(run)
    return e.select(
        "event_id",
        "event_type",
        "user_id",
        click.alias("click_id"),
    ).where("event_type = 'purchase'").select("event_id", "user_id", "click_id")


def rollup_totals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        latest_per_key, upsert_merge, insert_missing, canonical_dedupe, cross_reference_edges, queue_priority_next, resolution_stats, queue_status,
            page_limit_offset,
        inverted_index_lookup, yearly_counts, artifact_hash, incremental_anti, cache_hits, recent_per_key, union_distinct, intersect_keys,
            except_keys, evidence_union,
        json_props_agg, judged_cross_pairs, adjacent_pairs, triangular_unjudged, pair_sampling, exponent_fit, pair_likelihood, code_terms,
            sliding_60s_count, same_query_count, token_bucket_replay,
        tumbling_window, session_window, asof_join, rollup_totals, cube_counts,
    )
}

_ART = "a AS (SELECT l_returnflag AS type, l_partkey AS id, l_suppkey % 4 AS source, l_orderkey * 10 + l_linenumber AS seq FROM lineitem), f AS (SELECT type, id, arg_min(source, ((source + 1) % 4, seq)) AS source, arg_min(seq, ((source + 1) % 4, seq)) AS seq FROM a GROUP BY type, id)"
_DIAGNOSES = ", ".join(f"('{code}', '{entries[0][0]}')" for code, entries in expansion.DIAGNOSES.items())
ORACLE_SQL = {
    "latest_per_key": """SELECT user_id, event_type, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type
          ORDER BY ts DESC, event_id DESC) = 1""",
    "upsert_merge": """SELECT c_custkey AS uuid, c_name || CASE WHEN c_custkey % 3 = 0 THEN '!' ELSE '' END AS name, round(c_acctbal + CASE
          WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END, 2) AS balance, 'old' AS created FROM customer
      UNION ALL SELECT c_custkey + 10000000, c_name, round(c_acctbal, 2), 'new' FROM customer WHERE c_custkey % 100 = 0""",
    "insert_missing": """SELECT s_suppkey AS k, s_name AS v FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer
          WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""",
    "canonical_dedupe": f"WITH {_ART} SELECT * FROM f",
    "cross_reference_edges": f"""WITH {_ART} SELECT DISTINCT a.type, a.id, a.source, f.source AS canonical_source FROM a JOIN f USING (type, id)
          WHERE a.source <> f.source""",
    "queue_priority_next": """SELECT o_orderkey AS item, CASE left(o_orderpriority, 1) WHEN '1' THEN 'integrity' WHEN '2' THEN 'identity'
          WHEN '3' THEN 'affiliation' ELSE 'other' END AS category, o_orderdate AS submitted_at FROM orders WHERE o_orderstatus = 'P'
      ORDER BY least(left(o_orderpriority, 1)::INT, 4), o_orderdate, o_orderkey LIMIT 25""",
    "resolution_stats": """WITH l AS (SELECT l_orderkey AS i, max(l_shipdate) AS t FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1),
          s AS (SELECT o_orderkey AS i, (epoch_us(t) - epoch_us(o_orderdate)) / 86400e6 AS d FROM orders JOIN l ON i = o_orderkey), p AS (SELECT *,
            row_number() OVER (ORDER BY d, i) AS k, count(*) OVER () AS n FROM s)
      SELECT (SELECT count(*) FROM orders) AS total, count(*) AS resolved, (SELECT count(*) FROM orders) - count(*) AS open, round(median(d),
        6) AS median_days, round(max(d) FILTER (k = least(floor(n * 0.95::DOUBLE), n - 1) + 1), 6) AS p95_days FROM p""",
    "queue_status": """WITH o AS (SELECT l_orderkey AS i, l_shipdate AS t, min(CASE WHEN l_linenumber % 2 = 0 THEN 'accepted'
          ELSE 'rejected' END) AS x FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY ALL), l AS (SELECT i, arg_max(x, t) AS x FROM o GROUP BY i)
      SELECT coalesce(x, 'pending') AS status, count(*) AS n FROM orders LEFT JOIN l ON i = o_orderkey GROUP BY 1""",
    "page_limit_offset": "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40",
    "inverted_index_lookup": f"WITH {PAPERS_SQL} SELECT DISTINCT term AS descriptor, uuid FROM papers WHERE term = 'PROMO' ORDER BY uuid LIMIT 100",
    "yearly_counts": "SELECT o_custkey AS uuid, year(o_orderdate)::INT AS year, o_orderpriority AS type, count(*) AS n FROM orders GROUP BY ALL",
    "artifact_hash": """SELECT o_custkey AS uuid, sha256(string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey::VARCHAR)) AS hash FROM orders
          GROUP BY 1""",
    "incremental_anti": "SELECT DISTINCT o_custkey AS uuid FROM orders WHERE NOT (o_custkey % 3 <> 0 AND 1 + o_custkey % 2 = 2)",
    "cache_hits": """SELECT count(*) AS requests, count(*) FILTER (source IN ('src1', 'src2', 'src7')) AS hits, round(count(*)
          FILTER (source IN ('src1', 'src2', 'src7')) / count(*)::DOUBLE, 6) AS hit_rate FROM documents""",
    "recent_per_key": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect_keys": """SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT l_orderkey FROM lineitem
          WHERE l_returnflag = 'R'""",
    "except_keys": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "evidence_union": """SELECT uuid, category, count(*) AS n FROM (SELECT o_custkey AS uuid, 'publication' AS category FROM lineitem
          JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT o_custkey, 'grant' FROM orders UNION ALL SELECT c_custkey, 'profile' FROM customer)
            GROUP BY ALL""",
    "json_props_agg": """SELECT event_type, sum((props->>'k')::INT)::BIGINT AS total, max((props->>'k')::INT) AS top, count(props->>'k') AS n
          FROM events GROUP BY 1""",
    "judged_cross_pairs": """SELECT x.l_orderkey AS query, x.l_linenumber AS winner, y.l_linenumber AS loser FROM lineitem x
          JOIN lineitem y ON x.l_orderkey = y.l_orderkey WHERE x.l_quantity > 25 AND NOT y.l_quantity > 25""",
    "adjacent_pairs": """SELECT l_orderkey, l_linenumber AS winner, n AS loser FROM (SELECT *, lead(l_linenumber) OVER (PARTITION BY l_orderkey
          ORDER BY l_quantity DESC, l_linenumber) AS n FROM lineitem) WHERE n IS NOT NULL""",
    "triangular_unjudged": """SELECT x.l_orderkey, x.l_linenumber AS a, y.l_linenumber AS b FROM lineitem x
          JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber WHERE (x.l_linenumber + y.l_linenumber) % 3 <> 0""",
    "sliding_60s_count": """SELECT event_id AS id, event_type AS source, count(*) OVER w AS in_window, count(*) OVER w > 100 AS burst
          FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)""",
    "same_query_count": """SELECT event_id AS id, row_number() OVER w AS same, row_number() OVER w > 10 AS suspicious
          FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""",
    "token_bucket_replay": """WITH RECURSIVE e AS (SELECT user_id AS c, event_id AS id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id
          ORDER BY ts, event_id) AS k FROM events),
      b AS (SELECT c, id, us, k, true AS allowed, 1.0::DOUBLE AS t FROM e WHERE k = 1
        UNION ALL SELECT c, id, us, k, f >= 1, f - CASE WHEN f >= 1 THEN 1 ELSE 0 END FROM (SELECT e.*, least(2.0::DOUBLE,
          b.t + (e.us - b.us) / 1e6::DOUBLE * 0.0002::DOUBLE) AS f FROM b JOIN e ON e.c = b.c AND e.k = b.k + 1))
      SELECT c AS customer, id, allowed, round(t, 4) AS tokens FROM b""",
    "pair_likelihood": """WITH x AS (SELECT l_orderkey AS o, l_linenumber AS k, l_extendedprice AS v, pow((l_quantity + 1) / 52,
          0.7) * ((l_discount + 0.01::DOUBLE) / 0.12::DOUBLE) * pow((l_tax + 0.01::DOUBLE) / 0.1::DOUBLE, 0.4) AS s FROM lineitem),
      p AS (SELECT CASE WHEN a.v >= b.v THEN a.s ELSE b.s END AS w, CASE WHEN a.v >= b.v THEN b.s ELSE a.s END AS l FROM x a JOIN x b ON a.o = b.o
        AND b.k = a.k + 1)
      SELECT round(sum(-ln(w / (w + l + 1e-12) + 1e-12)), 3) AS nll, count(*) AS n_pairs FROM p""",
    "code_terms": f"""WITH c AS (SELECT DISTINCT ['C34.', 'c91', 'I50', 'X0'][o_orderkey % 4 + 1] || (o_orderkey % 10) AS code FROM orders),
          t(prefix, term) AS (VALUES {_DIAGNOSES}),
      m AS (SELECT code, term, CASE WHEN upper(code) = prefix THEN 'exact' WHEN replace(upper(code), '.', '') = replace(prefix, '.',
        '') THEN 'undotted' ELSE 'prefix' END AS via, length(prefix) AS n FROM c JOIN t ON starts_with(upper(code), prefix) OR replace(upper(code),
              '.', '') = replace(prefix, '.', ''))
      SELECT code, term, via FROM m QUALIFY row_number() OVER (PARTITION BY code ORDER BY CASE via WHEN 'exact' THEN 0 WHEN 'undotted' THEN 1
        ELSE 2 END, n DESC) = 1""",
    "tumbling_window": """SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events
          GROUP BY ALL""",
    "session_window": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOURS OR lag(ts) OVER w IS NULL THEN 1
          ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id
            ORDER BY ts) AS s FROM g)
      SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, s""",
    "asof_join": """WITH c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click') SELECT p.event_id, p.user_id,
          c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN c ON p.user_id = c.user_id
            AND p.ts >= c.ts""",
    "rollup_totals": """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
          GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
    "cube_counts": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
}
