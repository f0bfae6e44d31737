"""The tables at hand in the roles of the engine's own: customers as candidates, their order lines as papers,
their orders as grants, events as logs of requests and integrity events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, d: str) -> DataFrame:
    """uuid, pmid, rcr, author_weight, article_type, position, published, terms: one row an order line.

    Orders and lines are both large and meet on their key; parts are a dimension that the optimizer broadcasts
    where it is small enough."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_retailprice")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    position = F.when(F.col("l_linenumber") == 1, "first").when(F.col("l_linenumber") == 2, "last").otherwise("middle")
    return joined.select(
        F.col("o_custkey").alias("uuid"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("pmid"),
        (F.col("l_extendedprice") / (F.col("l_quantity") * F.col("p_retailprice"))).alias("rcr"),
        position.alias("position"),
        F.when(F.col("l_linenumber") == 1, 0.7).when(F.col("l_linenumber") == 2, 1.0).otherwise(0.3).alias("author_weight"),
        F.when(F.col("l_returnflag") == "R", "Letter").otherwise("Journal Article").alias("article_type"),
        F.to_date("o_orderdate").alias("published"),
        F.array("p_type", "p_brand").alias("terms"),
        F.col("p_type").alias("term"),
        F.col("l_partkey").alias("work"),
    )


PAPERS_SQL = """papers AS (
  SELECT o_custkey AS uuid, l_orderkey, l_linenumber, l_partkey AS work, l_extendedprice / (l_quantity * p_retailprice) AS rcr,
    CASE l_linenumber WHEN 1 THEN 0.7 WHEN 2 THEN 1.0 ELSE 0.3 END::DOUBLE AS author_weight,
    CASE l_linenumber WHEN 1 THEN 'first' WHEN 2 THEN 'last' ELSE 'middle' END AS position,
    CASE WHEN l_returnflag = 'R' THEN 'Letter' ELSE 'Journal Article' END AS article_type,
    o_orderdate::DATE AS published, p_type AS term, p_brand AS brand
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def grants(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    code = F.when(
        F.col("o_orderpriority").startswith("1"),
        "R01",
    ).when(F.col("o_orderpriority").startswith("2"), "K23").when(F.col("o_orderpriority").startswith("3"), "R21").otherwise("T32")
    role = F.when(F.col("o_orderkey") % 3 == 0, "Contact PI").when(F.col("o_orderkey") % 3 == 1, "Co-PI").otherwise("Co-I")
    return o.select(
        F.col("o_custkey").alias("uuid"), code.alias("activity_code"), role.alias("pi_role"), F.col("o_totalprice").alias("total_cost"),
            (F.col("o_orderstatus") == "O").alias("is_active"), (F.col("o_orderkey") % 4).alias("pi_count")
    )


GRANTS_SQL = """grants AS (
  SELECT o_custkey AS uuid, CASE left(o_orderpriority, 1) WHEN '1' THEN 'R01' WHEN '2' THEN 'K23' WHEN '3' THEN 'R21' ELSE 'T32' END AS code,
    CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.3 END::DOUBLE AS role_weight, o_totalprice AS cost, o_orderstatus = 'O' AS active,
    greatest(o_orderkey % 4, 1) AS pis FROM orders)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """uuid, name, country, segment, balance."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("uuid"), F.col("c_name").alias("name"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").alias("balance")
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    """id, ts, customer, source, latency, success, status from the events."""
    e = table(spark, d, "events")
    status = F.when(F.col("event_id") % 50 == 0, "5xx").when(F.col("event_id") % 20 == 0, "4xx").when(
        F.col("event_id") % 99 == 0,
        "timeout",
    ).otherwise("2xx")
    return e.select(
        F.col("event_id").alias("id"),
        "ts",
        F.col("user_id").alias("customer"),
        F.col("event_type").alias("source"),
        F.col("value").alias("latency"),
        (F.col("event_id") % 50 != 0).alias("success"),
        status.alias("status"),
    )


REQUESTS_SQL = """requests AS (
  SELECT event_id AS id, ts, user_id AS customer, event_type AS source, value AS latency, event_id % 50 <> 0 AS success,
    CASE WHEN event_id % 50 = 0 THEN '5xx' WHEN event_id % 20 = 0 THEN '4xx' WHEN event_id % 99 = 0 THEN 'timeout' ELSE '2xx' END AS status
      FROM events)"""
