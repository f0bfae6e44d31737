"""Exact positions and running sums in a global order, and percentiles made of them, without gathering the rows in
one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a bucket has about, the most buckets, and rows looked at for each to choose the bounds.
BUCKET_ROWS, BUCKETS, SAMPLED = 20_000, 256, 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one in the warehouse in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def settled(df: DataFrame, name: str | None = None) -> DataFrame:
    """`df` worked out once and kept in the shared folder, for what is read several times; `name` says what it is in the
    job's list."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    if name is None:
        return df.checkpoint(eager=True)
    context.setJobDescription(name)
    try:
        return df.checkpoint(eager=True)
    finally:
        context.setJobDescription(None)


def _tree(bounds: list, low: int, high: int, below) -> Column:
    """The number of bounds up to a row's key, by halving: as many comparisons as the tree is deep."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(below(bounds[middle]), _tree(bounds, low, middle, below)).otherwise(_tree(bounds, middle + 1, high, below))


def _below(order: list[str], bound: tuple) -> Column:
    """Whether a row stands before a bound; a null stands before all else."""
    tests, equal = [], F.lit(True)
    for column, value in zip(order, bound, strict=True):
        if value is None:
            equal = equal & F.col(column).isNull()
        else:
            tests.append(equal & (F.col(column).isNull() | (F.col(column) < F.lit(value))))
            equal = equal & F.coalesce(F.col(column) == F.lit(value), F.lit(False))
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def _bounds(rows: DataFrame, order: list[str], n: int) -> list[tuple]:
    """Bounds of about as many buckets as the rows need, from those rows that have the smallest hashes. They decide how
    even the buckets are, never the result. Several columns make a bound, so a frequent first value is cut by the next."""
    buckets = min(BUCKETS, n // BUCKET_ROWS)
    if buckets < 2:
        return []
    sample = rows.select(*order).orderBy(F.xxhash64(*order)).limit(SAMPLED * buckets).collect()
    keys = sorted({tuple(r) for r in sample}, key=lambda k: tuple((v is not None, v) for v in k))
    step = max(1, len(keys) // buckets)
    return keys[step::step]


def in_buckets(rows: DataFrame, order: list[str], name: str = "bucket") -> DataFrame:
    """Settled rows with the number of their bucket in the order: rows of equal place share one."""
    bounds = _bounds(rows, order, rows.count())
    return rows.withColumn(name, _tree(bounds, 0, len(bounds), lambda b: _below(order, b)))


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """`df` with, for each of `sums`, its total over all rows that stand before a row by the ascending columns `order`,
    nulls first. The order must be strict, or rows of equal place see each other in any order.

    Rows fall into buckets of the order, buckets are added up, and rows are summed inside their bucket. The input is
    worked out once, since it is looked at four times. At 10^10 rows a bucket has 40 million, which a task sorts with
    spilling.
    """
    rows = settled(df.withColumns({f"_of_{n}": c for n, c in sums.items()}))
    bounds = _bounds(rows, order, rows.count())
    bucketed = rows.withColumn("_bucket", _tree(bounds, 0, len(bounds), lambda b: _below(order, b)))
    totals = bucketed.groupBy("_bucket").agg(*(F.sum(f"_of_{n}").alias(f"_in_{n}") for n in sums))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_bucket", *(F.coalesce(F.sum(f"_in_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums))
    inside = W.partitionBy("_bucket").orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(W.unboundedPreceding, -1)
    own = bucketed.withColumns({n: F.coalesce(F.sum(f"_of_{n}").over(inside), F.lit(0)) for n in sums})
    joined = own.join(F.broadcast(offsets), "_bucket")  # a row a bucket
    out = joined.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums})
    return out.select(*(c for c in df.columns if c not in sums), *sums)


def numbered(df: DataFrame, order: list[str], name: str = "position", total: str = "n_rows", kept: bool = False) -> DataFrame:
    """`df` with each row's 1-based position by the ascending columns `order`, nulls first, and the number of rows.

    As `running_sums`, with rows counted; `kept` says that `df` is settled already."""
    rows = df if kept else settled(df)
    n = rows.count()
    bounds = _bounds(rows, order, n)
    bucketed = rows.withColumn("_bucket", _tree(bounds, 0, len(bounds), lambda b: _below(order, b)))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_bucket", (F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_bucket").orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    joined = bucketed.withColumn("_own", own).join(F.broadcast(offsets), "_bucket")  # a row a bucket
    return joined.withColumn(name, F.col("_before") + F.col("_own")).withColumn(total, F.lit(n).cast("long")).drop("_bucket", "_own", "_before")


def order_statistics(df: DataFrame, keys: list[str], order: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(keys, and for each of `places` the value there): a place is a 0-based index into a key's rows, given as a column
    of `_n`, their number. A key may have any share of all rows: they are numbered in one order with the key in front,
    and a place is looked up by its number."""
    rows = df.select(*keys, *order, *([value] if value not in order else []))
    placed = settled(numbered(rows, [*keys, *order], "_at", "_all"))
    groups = placed.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("_k"), (F.col("_first") + p).cast("long").alias("_at")) for k, p in places.items())))
    asked = groups.select(*keys, wanted.alias("w")).select(*keys, "w._k", "w._at")
    found = asked.join(placed.select("_at", F.col(value).alias("_value")), "_at")
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("_k") == k, F.col("_value"))).alias(k) for k in places))


def midpoint_percentile(df: DataFrame, score: str, key: str, name: str = "percentile") -> DataFrame:
    """(i + 1/2) / n by ascending score, ties by key; i counts from 0."""
    out = numbered(df, [score, key], "_p", "_of")
    return out.withColumn(name, (F.col("_p") - 0.5) / F.col("_of")).drop("_p", "_of")


def midpoint_percentiles(scores: DataFrame, key: str) -> DataFrame:
    """(which, key, percentile) of several scores at once, (which, key, score): `midpoint_percentile` of each, in one order
    with `which` in front, so a cohort is worked out, kept and numbered once."""
    rows = settled(scores.select("which", key, "score"))
    sizes = rows.groupBy("which").agg(F.count(F.lit(1)).alias("_of"))
    spans = sizes.withColumn("_before", F.sum("_of").over(W.orderBy("which")) - F.col("_of"))  # a row a score
    placed = numbered(rows, ["which", "score", key], "_p", "_all", kept=True).join(F.broadcast(spans), "which")
    return placed.select("which", key, ((F.col("_p") - F.col("_before") - 0.5) / F.col("_of")).alias("percentile"))


def span_percentile(df: DataFrame, score: str, key: str, name: str = "percentile") -> DataFrame:
    """i / (n - 1) by ascending score, ties by key; a single row gets 0."""
    out = numbered(df, [score, key], "_p", "_of")
    return out.withColumn(name, (F.col("_p") - 1) / F.greatest(F.col("_of") - 1, F.lit(1))).drop("_p", "_of")


def below_share(df: DataFrame, score: str, name: str = "percentile", digits: int = 4) -> DataFrame:
    """The share of rows with a strictly lower score, of all that have one; null for a row without a score. Scores are
    counted by distinct value before they are ordered."""
    values = settled(df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("_n")))
    n = values.agg(F.sum("_n")).first()[0] or 1
    running = running_sums(values, [score], {"_below": F.col("_n")})
    shares = running.select(F.col(score), F.round(F.col("_below") / F.lit(float(n)), digits).alias(name))
    return df.join(shares, score, "left")
