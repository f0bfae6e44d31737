from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meritgrid.streaming import events, limits

SCHEMA = "customer long, id long, ts timestamp, query_hash string"
START = dt.datetime(2024, 1, 1)


def requests(seed: int, n: int, customers: int = 4, span: int = 600) -> list[tuple]:
    rng = random.Random(seed)
    seconds = sorted(rng.choice([rng.randrange(span), 100, 101]) for _ in range(n))
    return [(rng.randrange(customers), i, START + dt.timedelta(seconds=s), rng.choice("abc")) for i, s in enumerate(seconds)]


def land(spark, folder: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


class Run:
    """A stream over a folder, a trigger at a time, into a table in memory; the checkpoint stays between starts."""

    def __init__(self, spark, tmp_path, made, name: str):
        self.spark, self.made, self.name = spark, made, name
        self.source, self.check, self.out = (str(tmp_path / f"{name}-{x}") for x in ("in", "check", "out"))
        self.progress = None

    def step(self, rows: list[tuple]) -> None:
        land(self.spark, self.source, rows)
        stream = self.made(self.spark.readStream.schema(SCHEMA).parquet(self.source))
        query = stream.writeStream.format("parquet").option("checkpointLocation", self.check).trigger(availableNow=True).start(self.out)
        query.awaitTermination()
        self.progress = query.lastProgress or self.progress

    def rows(self) -> list:
        return self.spark.read.parquet(self.out).collect()

    def state_rows(self) -> int:
        return self.progress["stateOperators"][0]["numRowsTotal"]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_alerts_over_several_triggers_equal_the_log_at_rest(spark, tmp_path):
    rows = requests(1, 240)
    run = Run(spark, tmp_path, lambda s: limits.watch(s, burst=12, same=5), "watch")
    for part in (rows[:70], rows[70:75], rows[75:160], rows[160:]):
        run.step(part)
    log = spark.createDataFrame(rows, SCHEMA)
    counted = {r["id"]: r["in_window"] for r in events.sliding_counts(log).collect()}
    same = {r["id"]: r["same"] for r in events.same_query_counts(log).collect()}
    got = {r["id"]: r for r in run.rows()}
    assert len(got) == len(rows) == len(run.rows())
    cut = {rows[70][2], rows[75][2], rows[160][2]} & {rows[69][2], rows[74][2], rows[159][2]}  # one instant in two batches
    for c, i, ts, _ in rows:
        if ts not in cut:
            assert got[i]["in_window"] == counted[i]
        assert (got[i]["customer"], got[i]["same"], got[i]["suspicious"]) == (c, same[i], same[i] > 5)
        assert got[i]["alert"] == ("high_frequency_burst" if got[i]["in_window"] > 12 else "identical_queries" if same[i] > 5 else None)
    assert {r["alert"] for r in run.rows()} == {None, "high_frequency_burst", "identical_queries"}


def test_state_goes_after_idle_time(spark, tmp_path):
    run = Run(spark, tmp_path, lambda s: limits.watch(s, forget=300.0), "idle")
    run.step(requests(2, 150, customers=10))
    full = run.state_rows()
    late = START + dt.timedelta(hours=5)
    run.step([(99, 1000, late, "z")])
    run.step([(99, 1001, late + dt.timedelta(seconds=1), "z")])
    assert run.state_rows() < full / 4
    run.step([(3, 2000, late + dt.timedelta(seconds=2), "a")])
    assert {r["id"]: (r["in_window"], r["same"]) for r in run.rows()}[2000] == (1, 1)


def test_buckets_over_several_triggers_equal_the_replayed_log(spark, tmp_path):
    rows = [r for i, r in enumerate(requests(3, 200)) if i == 0 or True]
    run = Run(spark, tmp_path, lambda s: limits.buckets(s, 0.05, 4.0), "buckets")
    for part in (rows[:50], rows[50:120], rows[120:]):
        run.step(part)
    log = spark.createDataFrame(rows, SCHEMA).select("customer", "id", "ts")
    want = {r["id"]: (r["allowed"], r["tokens"]) for r in events.replay_buckets(log, 0.05, 4.0).collect()}
    got = {r["id"]: r for r in run.rows()}
    assert {i: (r["allowed"], pytest.approx(r["tokens"])) for i, r in got.items()} == want
    assert all((r["retry_after"] is None) == r["allowed"] for r in got.values())
    assert any(not r["allowed"] for r in got.values())
    late = START + dt.timedelta(hours=5)
    run.step([(99, 1000, late, "z")])
    run.step([(98, 1001, late + dt.timedelta(seconds=1), "z")])
    assert run.state_rows() <= 4  # a bucket and a timer for each of the two


def test_rows_without_customer_or_time_are_not_judged(spark, tmp_path):
    run = Run(spark, tmp_path, lambda s: limits.watch(s), "nulls")
    run.step([(None, 1, START, "a"), (1, 2, None, "a"), (1, 3, START, None), (1, 4, START, None)])
    assert sorted((r["id"], r["same"]) for r in run.rows()) == [(3, 1), (4, 2)]


def test_same_queries_of_a_log_keep_rows_with_null_keys(spark):
    rows = [(1, 1, START, "a"), (None, 2, START, "a"), (1, 3, START, None), (None, 4, START, "a")]
    got = {r["id"]: r["same"] for r in events.same_query_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2}
    counted = events.sliding_counts(spark.createDataFrame(rows, SCHEMA))
    assert counted.where(F.col("in_window") > 0).count() == 4
