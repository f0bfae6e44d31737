"""Tables that change: latest-wins logs, upserts, canonical copies, queues, pages, caches, incremental work.

Parquet tables have no row-level merge, so a change is a new version of the table: rows that stay, found by an
anti-join on the key, and the new rows. Append-only logs are read as their latest state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meritgrid.functions.positions import numbered

# The order in which contest categories are reviewed.
PRIORITIES = {"integrity": 0, "identity": 1, "affiliation": 2}


def latest(log: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by `order`: one aggregation, combined before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order) if len(order) > 1 else F.col(order[0]))
    return log.groupBy(*keys).agg(row.alias("_r")).select(*keys, "_r.*")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """The table after the changes, one row a key: changed rows take the new values, but for columns in `keep`
    those of the old row where there is one."""
    kept = table.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in keep or []))
    fresh = changes.join(kept, keys, "left") if keep else changes
    fresh = fresh.select(*(F.coalesce(f"_old_{c}", c).alias(c) if c in (keep or []) else F.col(c) for c in table.columns))
    return table.join(changes.select(*keys), keys, "left_anti").select(*table.columns).unionByName(fresh)


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert, and do nothing on conflict."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti").select(*table.columns)


def children(candidates: DataFrame) -> dict[str, DataFrame]:
    """The long tables of a candidate: strong keys, artifact references (papers, trials, grants), affiliations."""
    refs = [("pmid", "pmids"), ("nct", "nct_ids"), ("grant", "grant_ids")]
    parts = [candidates.select("uuid", F.lit(t).alias("type"), F.explode(f"artifact_refs.{c}").alias("id")) for t, c in refs]
    return {
        "strong_keys": candidates.select("uuid", F.explode("strong_keys").alias("key_type", "key_value")),
        "artifact_refs": reduce(DataFrame.unionByName, parts).distinct(),
        "affiliation_history": candidates.select("uuid", F.inline("affiliations")),
    }


def canonical(artifacts: DataFrame, priority: Column) -> tuple[DataFrame, DataFrame]:
    """The canonical row of each (type, id), that of the first source by priority and then seq, and the edges
    (type, id, source, canonical_source) from every other source."""
    order = F.struct(priority.alias("p"), "seq")
    first = artifacts.groupBy("type", "id").agg(F.min_by(F.struct("source", "seq"), order).alias("c"))
    rows = first.select("type", "id", F.col("c.source").alias("source"), F.col("c.seq").alias("seq"))
    edges = artifacts.join(
        first.select("type", "id", F.col("c.source").alias("canonical_source")),
        ["type", "id"],
    ).where("source <> canonical_source")
    return rows, edges.select("type", "id", "source", "canonical_source").distinct()


def cross_references(edges: DataFrame, key: str) -> DataFrame:
    return edges.where((F.col("source_id") == key) | (F.col("target_id") == key))


def status(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """The queue with each item's status by its latest decision, pending without one."""
    last = decisions.groupBy("item").agg(F.max_by("decision", "ts").alias("decision"), F.max("ts").alias("decided_at"))
    return queue.join(last, "item", "left").withColumn("status", F.coalesce("decision", F.lit("pending")))


def next_in_queue(queue: DataFrame, category: str, time: str, n: int = 1) -> DataFrame:
    """The next items to review: by category, then by age, then by item."""
    rank = F.lit(len(PRIORITIES))
    for name, p in PRIORITIES.items():
        rank = F.when(F.col(category) == name, p).otherwise(rank)
    return queue.orderBy(rank, time, "item").limit(n)


def resolution_stats(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: items by state, median days to a decision and the value at index min(int(.95 n), n - 1)."""
    last = decisions.groupBy("item").agg(F.max("ts").alias("decided_at"))
    joined = queue.join(last, "item", "left")
    days = (F.unix_micros("decided_at") - F.unix_micros("submitted_at")) / 86_400e6
    every = joined.select("item", days.alias("d"), F.col("decided_at").isNull().alias("_open"))
    placed = numbered(every, ["_open", "d", "item"], "_p", "_all")
    n = placed.agg(F.count_if(~F.col("_open"))).first()[0]
    at = lambda i: F.max(F.when((F.col("_p") == i + 1) & ~F.col("_open"), F.col("d")))
    median = (at((n - 1) // 2) + at(n // 2)) / 2
    return placed.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("_open")).alias("resolved"),
        F.count_if(F.col("_open")).alias("open"),
        F.round(median, 6).alias("median_days"),
        F.round(at(min(int(n * 0.95), n - 1)), 6).alias("p95_days"),
    )


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of a list. The order must end in a key."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def lookup(index: DataFrame, key: str, value: str, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows of an inverted index for one key; the filter reaches the scan."""
    hits = index.where(F.col(key) == value)
    hits = hits.orderBy(order) if order else hits
    return hits.limit(limit) if limit else hits


def term_index(candidates: DataFrame) -> DataFrame:
    """(descriptor, qualifier, uuid) once each."""
    return candidates.select("uuid", F.inline("terms")).select("descriptor", "qualifier", "uuid").distinct()


def yearly_counts(artifacts: DataFrame, time: str) -> DataFrame:
    return artifacts.groupBy("uuid", F.year(time).alias("year"), "type").agg(F.count(F.lit(1)).alias("n"))


def artifact_set_hash(ids: Column) -> Column:
    """One hash of a set of ids: SHA-256 of them sorted and joined."""
    return F.sha2(F.array_join(F.array_sort(ids), "|"), 256)


def to_recompute(candidates: DataFrame, log: DataFrame, version: int) -> DataFrame:
    """Candidates (uuid, ids) whose ids in this weight version are not in the log (uuid, hash, version)."""
    hashed = candidates.withColumn("hash", artifact_set_hash(F.col("ids"))).withColumn("version", F.lit(version))
    return hashed.join(log.select("uuid", "hash", "version"), ["uuid", "hash", "version"], "left_anti")


def cache_key(query: Column, version: Column) -> Column:
    return F.sha2(F.concat_ws("|", query, version), 256)


def cached(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with what the cache holds for their keys, and whether it does."""
    return requests.join(cache.withColumn("_hit", F.lit(True)), keys, "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def cache_stats(hits: DataFrame) -> DataFrame:
    n, good = F.count(F.lit(1)), F.count_if(F.col("hit"))
    return hits.agg(n.alias("requests"), good.alias("hits"), F.round(F.coalesce(good / n, F.lit(0.0)), 6).alias("hit_rate"))


def without_version(cache: DataFrame, version: str) -> DataFrame:
    return cache.where(F.col("version") != version)


def recent_per_key(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_k") <= n).drop("_k")


# What a confirmed dispute does to a candidate, by category.
DISPUTE_DIRECTIONS = {
    "low_quality_output": "downweight",
    "incorrect_ranking": "downweight",
    "missing_expertise": "downweight",
    "integrity_concern": "flag",
}


def dispute_feedback(disputes: DataFrame, decisions: DataFrame) -> DataFrame:
    """(dispute, uuid, query, category, direction, weight) of disputes (dispute, uuid, query, category) whose latest
    decision (dispute, confirmed, decided_at) confirms them."""
    last = decisions.groupBy("dispute").agg(F.max_by("confirmed", "decided_at").alias("confirmed"))
    known = F.create_map(*(F.lit(x) for kv in DISPUTE_DIRECTIONS.items() for x in kv))
    confirmed = disputes.join(last.where("confirmed"), "dispute")
    return confirmed.select(
        "dispute",
        "uuid",
        "query",
        "category",
        F.coalesce(known[F.col("category")], F.lit("review")).alias("direction"),
        F.lit(1.0).alias("weight"),
    )


def training_rows(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """(item, uuid, features, decision, decided_at): every decision on an item of the queue, as rows to learn from."""
    return decisions.join(queue, "item").select("item", "uuid", "features", "decision", "decided_at")


def pending_conflicts(conflicts: DataFrame) -> DataFrame:
    return conflicts.where("status = 'pending'")


def without_conflicts(patents: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Patents (patent, ...) without those that a pending or excluded conflict names."""
    held = conflicts.where(F.col("status").isin("pending", "excluded")).select("patent").distinct()
    return patents.join(held, "patent", "left_anti")


def may_continue(sessions: DataFrame, ended: DataFrame, most: int = 20, cooldown_minutes: int = 60) -> DataFrame:
    """Sessions (reviewer, judgments, started) with `allowed`: fewer judgments than the limit, and the reviewer's last
    session (reviewer, ended) over for an hour."""
    last = ended.groupBy("reviewer").agg(F.max("ended").alias("_ended"))
    rested = F.col("_ended").isNull() | (F.col("started") >= F.col("_ended") + F.expr(f"INTERVAL {cooldown_minutes} MINUTES"))
    return sessions.join(last, "reviewer", "left").withColumn("allowed", (F.col("judgments") < most) & rested).drop("_ended")


def with_terms(candidates: DataFrame, terms: list[str]) -> DataFrame:
    """Candidates (uuid, terms) that have one of the terms, whatever its case."""
    wanted = F.array(*(F.lit(t.lower()) for t in terms))
    return candidates.where(F.arrays_overlap(F.transform("terms", F.lower), wanted))


def score_history(snapshots: DataFrame, key: str) -> DataFrame:
    """Snapshots (uuid, day, score) of one candidate in the order of their days; the filter reaches the scan."""
    return snapshots.where(F.col("uuid") == key).orderBy("day")
