"""Integrity events and requests as streams: feeds, deduplication, fan-out, sliding counts, token buckets, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meritgrid.functions.positions import numbered, settled
from meritgrid.operators.classify import sanction_action

# Limits of requests, and the words by which feed entries are graded.
BURST_SECONDS, BURST_LIMIT, SAME_QUERY_LIMIT = 60, 100, 10
MISCONDUCT_WORDS = ["misconduct", "falsification", "fabrication", "plagiarism", "finding"]
BOARD_SEVERITIES = [("revocation", "critical"), ("suspension", "critical"), ("restriction", "high"), ("probation", "high"), ("reprimand", "medium")]


def feed(spark: SparkSession, path: str, schema: str, form: str = "json", files_per_trigger: int = 100) -> DataFrame:
    """A landed feed as a stream; the number of files a trigger takes is its back-pressure."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def fingerprint(entry: str, title: str, link: str) -> Column:
    """The first 16 hex digits of the SHA-256 of an entry's id, title and link."""
    return F.substring(F.sha2(F.concat(*(F.coalesce(F.col(c), F.lit("")) for c in (entry, title, link))), 256), 1, 16)


def new_entries(entries: DataFrame, delay: str | None = "30 days") -> DataFrame:
    """Entries whose fingerprint was not seen before: within the delay of the watermark, or ever if it is None, which
    keeps every fingerprint in the state."""
    marked = entries.withColumn("fp", fingerprint("id", "title", "link"))
    if delay is None:
        return marked.dropDuplicates(["fp"])
    return marked.withWatermark("published", delay).dropDuplicatesWithinWatermark(["fp"])


def retraction_events(entries: DataFrame) -> DataFrame:
    """Events of a retraction feed: pmid from the text, the first author named, severity by the reason."""
    text = F.concat_ws(" ", "title", "summary")
    severity = F.when(
        F.lower(text).rlike("fabricat|falsif|misconduct"),
        "critical",
    ).when(F.lower(text).rlike("plagiar|duplicat"), "high").otherwise("medium")
    names = F.regexp_extract_all(text, F.lit(r"by ([A-Z][a-z]+ [A-Z][a-z]+)"), F.lit(1))
    return entries.select(
        "id", F.lit("retraction").alias("event_type"), F.get(names, F.lit(0)).alias("subject"), F.slice(names, F.lit(2), F.greatest(F.size(names) - 1,
            F.lit(0))).alias("others"), F.nullif(
            F.regexp_extract(text, r"(?i)pmid:?\s*(\d+)", 1),
            F.lit(""),
        ).alias("pmid"), severity.alias("severity"), "published"
    )


def misconduct_events(entries: DataFrame) -> DataFrame:
    """Findings of misconduct; the person's name stands after a semicolon, a dash or a hyphen in the title."""
    title = F.col("title")
    name = F.when(
        title.contains(";"),
        F.substring_index(title, ";", -1),
    ).when(title.contains("—"), F.substring_index(title, "—", -1)).otherwise(F.substring_index(title, "-", -1))
    name = F.regexp_replace(F.trim(name), r"[.,;:]+$", "")
    hit = F.lower(F.concat_ws(" ", "title", "summary")).rlike("|".join(MISCONDUCT_WORDS))
    return entries.where(hit).select(
        "id",
        F.lit("misconduct").alias("event_type"),
        F.when(F.length(name) > 3, name).alias("subject"),
        F.lit("critical").alias("severity"),
        "published",
    )


def sanction_events(entries: DataFrame) -> DataFrame:
    action, severity = sanction_action(F.concat_ws(" ", "title", "summary"))
    return entries.select(
        "id",
        F.lit("sanction").alias("event_type"),
        F.col("title").alias("subject"),
        action.alias("action"),
        severity.alias("severity"),
        "published",
    )


def board_events(entries: DataFrame, state: str) -> DataFrame:
    """Actions of a state's medical board, graded by the first word that names one."""
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    severity = F.lit("high")
    for word, level in reversed(BOARD_SEVERITIES):
        severity = F.when(text.contains(word), level).otherwise(severity)
    return entries.select(
        "id",
        F.lit("board_action").alias("event_type"),
        F.col("title").alias("subject"),
        F.lit(state).alias("state"),
        severity.alias("severity"),
        "published",
    )


def dispatch(events: DataFrame, handlers: list[Callable[[DataFrame, int], None]], checkpoint: str, **trigger: Any):
    """Starts a query that gives each micro-batch to every handler in order. A batch is kept for all handlers; one
    that fails stops the query, and the checkpoint makes the batch come again."""

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        try:
            for handler in handlers:
                handler(df, number)
        finally:
            df.unpersist()

    return events.writeStream.foreachBatch(batch).option(
        "checkpointLocation",
        checkpoint,
    ).trigger(**(trigger or {"processingTime": "15 minutes"})).start()


def sliding_counts(requests: DataFrame, customer: str = "customer", time: str = "ts", key: str = "id") -> DataFrame:
    """Requests with the number of the customer's requests in the last 60 seconds and the burst flag.

    A window holds one minute of a customer, not all of a busy one: each request counts in its own minute, and is sent
    to the next one as well, where it counts for others but is not a row of the result."""
    micros, span = F.unix_micros(F.col(time).cast("timestamp")), BURST_SECONDS * 1_000_000
    own = requests.withColumn("_us", micros).withColumn("_minute", F.floor(F.col("_us") / span))
    both = own.withColumn("_later", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_minute", F.col("_minute") + F.col("_later"))
    frame = W.partitionBy(customer, "_minute").orderBy("_us").rangeBetween(-span, 0)
    counted = both.withColumn("in_window", F.count(F.lit(1)).over(frame)).where("_later = 0").drop("_us", "_minute", "_later")
    return counted.withColumn("burst", F.col("in_window") > BURST_LIMIT)


def same_query_counts(requests: DataFrame) -> DataFrame:
    """The running number of a customer's requests with one query hash, which never expires, and its flag: positions in
    one order of all requests, less what stands before the customer's first of that hash."""
    placed = settled(numbered(requests, ["customer", "query_hash", "ts", "id"], "_at", "_all"))
    first = placed.groupBy(F.col("customer").alias("_c"), F.col("query_hash").alias("_q")).agg(F.min("_at").alias("_first"))
    rows = placed.join(first, F.col("customer").eqNullSafe(F.col("_c")) & F.col("query_hash").eqNullSafe(F.col("_q"))).drop("_c", "_q")
    rows = rows.withColumn("same", F.col("_at") - F.col("_first") + 1).drop("_at", "_all", "_first")
    return rows.withColumn("suspicious", F.col("same") > SAME_QUERY_LIMIT)


def windowed_counts(events: DataFrame, time: str, length: str, slide: str | None = None, delay: str | None = None, *keys: str) -> DataFrame:
    """Counts by tumbling or sliding windows of event time, for batches and, with a delay, for streams."""
    marked = events.withWatermark(time, delay) if delay else events
    return marked.groupBy(F.window(time, length, slide) if slide else F.window(time, length), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    """(keys, start, end, n): runs of events with no gap as long as the given one; `end` is the last event's plus it."""
    counted = events.groupBy(F.session_window(time, gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def token_buckets(requests: DataFrame, rate: float, capacity: float | None = None) -> DataFrame:
    """Stream of (customer, id, ts) with `allowed` and the tokens left: each customer's bucket fills at `rate` a second
    up to `capacity` (twice the rate by default) and a request takes one. The state of a customer is two numbers."""
    most = capacity if capacity is not None else 2 * rate

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (most, None)
        for pdf in batches:
            allowed, left = [], []
            pdf = pdf.sort_values(["ts", "id"])
            for ts in pdf["ts"]:
                now = ts.timestamp()
                tokens = min(most, tokens + (0.0 if last is None else max(0.0, now - last)) * rate)
                last = now if last is None else max(last, now)
                allowed.append(tokens >= 1.0)
                tokens -= 1.0 if tokens >= 1.0 else 0.0
                left.append(tokens)
            yield pd.DataFrame({"customer": key[0], "id": pdf["id"].to_numpy(), "allowed": allowed, "tokens": left})
        state.update((tokens, last if last is not None else 0.0))

    return requests.groupBy("customer").applyInPandasWithState(
        run, "customer long, id long, allowed boolean, tokens double", "tokens double, last double", "append", GroupStateTimeout.NoTimeout
    )


def replay_buckets(requests: DataFrame, rate: float, capacity: float | None = None) -> DataFrame:
    """The same for a log at rest: each customer's requests are replayed in order, a batch at a time."""
    most = capacity if capacity is not None else 2 * rate

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, tokens, last = None, most, None
        for pdf in batches:
            allowed, left = [], []
            for customer, us in zip(pdf["customer"], pdf["us"], strict=True):
                if customer != who:
                    who, tokens, last = customer, most, None
                tokens = min(most, tokens + (0.0 if last is None else (us - last) / 1e6) * rate)
                last = us
                ok = tokens >= 1.0
                tokens -= 1.0 if ok else 0.0
                allowed.append(ok)
                left.append(tokens)
            yield pd.DataFrame({"customer": pdf["customer"], "id": pdf["id"], "allowed": allowed, "tokens": left})

    rows = requests.select("customer", "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.repartition("customer").sortWithinPartitions("customer", "us", "id").mapInPandas(
        run,
        "customer long, id long, allowed boolean, tokens double",
    )
