"""Joins that keep to equal keys where a plain join would gather: pairs within keys of any size, days within intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key that are compared with each other in one place.
TILE = 1024
#: So many keys of more rows are broadcast; where there are more, each is sent to so many places.
BROADCAST_KEYS, SALTS = 100_000, 16
#: Rows of one place, where rows are counted before they are dealt.
PLACE_ROWS = 1 << 19
#: Days from the first that can be told apart to the last: 2 to the power of so many, half of them before 1970.
DAY_BITS = 17


def places(n: int | float | None) -> int:
    """How many places of `PLACE_ROWS` about `n` rows need."""
    return max(1, -int(-(n or 0) // PLACE_ROWS))


def in_places(rows: DataFrame, n: int | float | None, *keys: str) -> DataFrame:
    """`rows`, of which there are at most about `n`, dealt by `keys` into as many places as hold `PLACE_ROWS` each, so what
    a task groups does not grow with the table."""
    return rows.repartition(places(n), *keys)


def pairs_by_key(rows: DataFrame, key: str, member: str, tile: int = TILE, where: Column | None = None, rows_n: int | None = None) -> DataFrame:
    """(key, a, b and of each further column c the two sides' c_a and c_b) for every two rows of (key, member, ...) with
    the same key and a < b, and `where` of these columns, if given. Members are distinct within a key.

    Keys are counted first. One of more than `tile` rows is dealt into tiles, and each two tiles meet in a place of
    their own, so no place gets more than two tiles whatever share of all rows a key has. `rows_n`, where the number of
    rows is known, says how many places the tiles are dealt into."""
    more = [c for c in rows.columns if c not in (key, member)]
    named = rows.where(F.col(key).isNotNull() & F.col(member).isNotNull())
    counts = named.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > tile)
    parts = counts.select("_k", F.ceil(F.col("_m") / F.lit(tile)).cast("int").alias("_n"))
    if counts.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        dealt = named.join(F.broadcast(parts), F.col(key) == F.col("_k"), "left")
    else:
        salt = F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.lit(SALTS)).cast("int")
        spread = parts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = named.join(spread, (F.col(key) == F.col("_k")) & (salt == F.col("_s")), "left").drop("_s")
    n = F.coalesce("_n", F.lit(1))
    own = dealt.withColumn("_t", F.pmod(F.xxhash64(member), n).cast("int")).withColumn("_n", n)

    def side(name: str, others: Column, i: Column, j: Column) -> DataFrame:
        out = own.withColumn("_o", F.explode(others))
        columns = [F.col(member).alias(f"_{name}"), *(F.col(c).alias(f"_{c}_{name}") for c in more)]
        sides = out.select(F.col(key).alias("_key"), i.alias("_i"), j.alias("_j"), *columns)
        return sides if rows_n is None else in_places(sides, rows_n, "_key", "_i", "_j")

    x = side("x", F.sequence(F.col("_t"), F.col("_n") - 1), F.col("_t"), F.col("_o"))
    y = side("y", F.sequence(F.lit(0), F.col("_t")), F.col("_o"), F.col("_t"))
    met = x.join(y, ["_key", "_i", "_j"]).where(((F.col("_i") < F.col("_j")) & (F.col("_x") != F.col("_y"))) | (F.col("_x") < F.col("_y")))
    first = F.col("_x") < F.col("_y")
    pick = lambda c, a, b: [F.when(first, F.col(f"_{c}x")).otherwise(F.col(f"_{c}y")).alias(a), F.when(first,
        F.col(f"_{c}y")).otherwise(F.col(f"_{c}x")).alias(b)]
    out = met.select(F.col("_key").alias(key), *pick("", "a", "b"), *(p for c in more for p in pick(f"{c}_", f"{c}_a", f"{c}_b")))
    return out if where is None else out.where(where)


def _day(day: Column) -> Column:
    return F.unix_date(day) + (1 << (DAY_BITS - 1))


def blocks_of_span(first: Column, last: Column) -> Column:
    """An array of (level, block): the fewest blocks of 2^level days that make up the days from `first` to `last`. There
    are at most two a level, so a span of a century has no more than a few dozen."""
    empty = F.array().cast("array<struct<level:int,block:int>>")
    begin = F.struct(_day(first).alias("lo"), (_day(last) + 1).alias("hi"), empty.alias("out"))

    def step(acc: Column, level: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        open_ = lo < hi
        left, right = open_ & (lo % 2 == 1), open_ & (hi % 2 == 1)
        block = lambda at: F.array(F.struct(level.alias("level"), at.alias("block")))
        lo2 = F.when(left, lo + 1).otherwise(lo)
        hi2 = F.when(right & (lo2 < hi), hi - 1).otherwise(hi)
        out = F.concat(acc["out"], F.when(left, block(lo)).otherwise(empty), F.when(right & (lo2 < hi), block(hi - 1)).otherwise(empty))
        return F.struct(F.shiftright(lo2, 1).alias("lo"), F.shiftright(hi2, 1).alias("hi"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(DAY_BITS)), begin, step)["out"]


def blocks_of_day(day: Column) -> Column:
    """An array of (level, block): the block of each level that holds the day."""
    return F.transform(F.sequence(F.lit(0), F.lit(DAY_BITS)), lambda k: F.struct(k.alias("level"), F.floor(_day(day) / F.pow(F.lit(2),
        k)).cast("int").alias("block")))


def days_in_spans(days: DataFrame, spans: DataFrame, keys: list[str], day: str = "day", first: str = "first_day",
    last: str = "last_day") -> DataFrame:
    """Rows of `days` (keys, day, ...) with those of `spans` (keys, first_day, last_day, ...) that hold the day, both ends
    included; a missing end is open. An equi-join by keys and blocks of days, in which a day and a span meet once."""
    span = spans.withColumn("_b", F.explode(blocks_of_span(F.coalesce(first, F.lit("1900-01-01").cast("date")), F.coalesce(last,
        F.lit("2120-01-01").cast("date")))))
    asked = days.withColumn("_b", F.explode(blocks_of_day(F.col(day))))
    return asked.select("*", "_b.level", "_b.block").drop("_b").join(span.select("*", "_b.level", "_b.block").drop("_b"), [*keys, "level",
        "block"]).drop("level", "block")
