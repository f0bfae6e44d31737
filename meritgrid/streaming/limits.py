"""Live limits: bursts, repeated queries and token buckets over streams of requests, with state that goes away.

Each customer's state is kept by Spark's state store (RocksDB) and read a micro-batch at a time. A batch is taken in order
of event time; rows that come in order of time, over any number of batches, get what the queries over a log at rest
(`events.sliding_counts`, `events.same_query_counts`, `events.replay_buckets`) give. Timers of event time end a
customer's state when it can no longer matter: times of requests once they lie outside the window, a bucket once it is
full again, counts of queries (which never expire by themselves) after `forget` seconds without a request, if given.

A row that is behind the watermark is dropped by Spark; one that is late but not behind it counts from then on and is
judged by what is known. Rows without a customer or time are not judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from meritgrid.streaming.events import BURST_LIMIT, BURST_SECONDS, SAME_QUERY_LIMIT

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MICROS = 1_000_000


def keep_state(spark: SparkSession) -> None:
    """Lists, maps and timers need the RocksDB store; the setting is read when a query starts, so it stays."""
    spark.conf.set(_STORE, _ROCKS)


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    pdf = pd.concat(list(rows), ignore_index=True)
    return pdf.sort_values(["us", "id"], ignore_index=True)


def _millis(us: float) -> int:
    return int(us // 1000) + 1


class AbuseWatch(StatefulProcessor):
    """Counts a customer's requests in the last seconds, and those with the same query."""

    def __init__(self, seconds: int, burst: int, same: int, forget: float | None):
        self.span, self.burst, self.same, self.forget = seconds * _MICROS, burst, same, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "us long")
        self.queries = handle.getMapState("queries", "query_hash string", "n long")
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = _ordered(rows)
        us = pdf["us"].to_numpy(np.int64)
        known = np.array([t[0] for t in self.times.get()], np.int64) if self.times.exists() else np.zeros(0, np.int64)
        every = np.sort(np.concatenate([known, us]), kind="stable")
        counts = np.searchsorted(every, us, side="right") - np.searchsorted(every, us - self.span, side="left")
        last = max(int(every[-1]), self.last.get()[0] if self.last.exists() else 0)
        self.times.put([(int(t),) for t in every[every >= last - self.span]])
        self.last.update((last,))
        hashes = pdf["query_hash"].fillna("").astype(str)
        nth = pdf.groupby(hashes).cumcount().to_numpy() + 1
        before = {h: self.queries.getValue((h,))[0] if self.queries.containsKey((h,)) else 0 for h in hashes.unique()}
        same = nth + hashes.map(before).to_numpy(np.int64)
        for h, n in pd.Series(same).groupby(hashes.to_numpy()).max().items():
            self.queries.updateValue((h,), (int(n),))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(_millis(last + self.span))
        if self.forget is not None:
            self.handle.registerTimer(_millis(last + self.forget * _MICROS))
        burst, suspicious = counts > self.burst, same > self.same
        alert = np.where(burst, "high_frequency_burst", np.where(suspicious, "identical_queries", None))
        yield pd.DataFrame(
            {"customer": key[0], "id": pdf["id"], "in_window": counts, "burst": burst, "same": same, "suspicious": suspicious, "alert": alert}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        last = self.last.get()[0] if self.last.exists() else 0
        if now >= _millis(last + self.span):
            self.times.clear()
        if self.forget is not None and now >= _millis(last + self.forget * _MICROS):
            self.queries.clear()
        if self.forget is None or now >= _millis(last + self.forget * _MICROS):
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _marked(requests: DataFrame, time: str, delay: str, *columns: str) -> DataFrame:
    timed = requests.where(F.col("customer").isNotNull() & F.col(time).isNotNull()).withColumn("_ts", F.col(time).cast("timestamp"))
    return timed.withWatermark("_ts", delay).select("customer", "id", *columns, F.unix_micros("_ts").alias("us"), "_ts")


def watch(
    requests: DataFrame,
    *,
    delay: str = "10 seconds",
    seconds: int = BURST_SECONDS,
    burst: int = BURST_LIMIT,
    same: int = SAME_QUERY_LIMIT,
    forget: float | None = None,
) -> DataFrame:
    """A stream of (customer, id, ts, query_hash) with in_window, burst, same, suspicious and the alert, bursts first."""
    keep_state(requests.sparkSession)
    kind = requests.schema["customer"].dataType.simpleString()
    return _marked(requests, "ts", delay, "query_hash").groupBy("customer").transformWithStateInPandas(
        statefulProcessor=AbuseWatch(seconds, burst, same, forget),
        outputStructType=f"customer {kind}, id long, in_window long, burst boolean, same long, suspicious boolean, alert string",
        outputMode="Append",
        timeMode="EventTime",
    )


class Bucket(StatefulProcessor):
    """A customer's tokens; a bucket that is full again is no state."""

    def __init__(self, rate: float, most: float):
        self.rate, self.most = rate, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "tokens double, us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = _ordered(rows)
        tokens, last = self.state.get() if self.state.exists() else (self.most, None)
        allowed, left, wait = [], [], []
        for us in pdf["us"].tolist():
            tokens = min(self.most, tokens + (0.0 if last is None else max(0, us - last) / _MICROS) * self.rate)
            last = us if last is None else max(last, us)
            allowed.append(tokens >= 1.0)
            wait.append(None if tokens >= 1.0 else (1.0 - tokens) / self.rate if self.rate > 0 else 1.0)
            tokens -= 1.0 if tokens >= 1.0 else 0.0
            left.append(tokens)
        self.state.update((float(tokens), int(last)))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if self.rate > 0:
            self.handle.registerTimer(_millis(last + (self.most - tokens) / self.rate * _MICROS))
        yield pd.DataFrame({"customer": key[0], "id": pdf["id"], "allowed": allowed, "tokens": left, "retry_after": pd.Series(wait, dtype="float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def buckets(requests: DataFrame, rate: float, capacity: float | None = None, *, delay: str = "10 seconds") -> DataFrame:
    """A stream of (customer, id, ts) with `allowed`, the tokens left and the seconds to wait where a request is refused."""
    keep_state(requests.sparkSession)
    kind = requests.schema["customer"].dataType.simpleString()
    return _marked(requests, "ts", delay).groupBy("customer").transformWithStateInPandas(
        statefulProcessor=Bucket(rate, capacity if capacity is not None else 2 * rate),
        outputStructType=f"customer {kind}, id long, allowed boolean, tokens double, retry_after double",
        outputMode="Append",
        timeMode="EventTime",
    )
