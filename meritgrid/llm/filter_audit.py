"""How filters interact: what each removes at each step of each order in which they can be applied.

The orders of n filters form a trie of n! paths; what is left after some of them depends on which they were, not on
their order. So the trie is walked depth first, a filter is applied to the survivors of the state before it, and each
unordered state is visited once and known by its name from then on: 2^n states instead of n! paths. A state's survivors
are a persisted DataFrame as long as the walk is below it (at most n + 1 at a time), of a few numbers a row; one
aggregate over them counts what each filter that is left would remove, the actual removals along all edges that leave
the state. Counts are kept by part, so a hot part is added up where its rows are before it is shuffled.

From the edges of a part, at most n 2^(n-1), all else follows: what an order keeps, what fails a filter but went
before, what fails a filter alone (the edge from all others), and the sum over all orders (an edge lies on
|before|! (n - 1 - |before|)! of them).

Lost executors cost the survivors that they held, which are filtered again out of checkpointed rows.

Defined results: a filter is a column that is true where a row fails; null passes. Marks are columns, true where a
removal is counted as a loss; null is not. A null part is the empty string. A part has a row for each order and step,
zeros included; an empty table gives no rows. For texts: null is empty; a word is a run of bytes other than space, tab
to carriage return, compared as written; rows with a null id are never copied from nor copies; of rows with equal ids
none is the other's copy. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgrid.llm.arrowtext import slices, text_bytes, words
from meritgrid.llm.components import cut
from meritgrid.llm.frames import modest_batches

#: More filters would have over 5,040 orders.
MOST_FILTERS = 7
#: Narrow rows in a partition, and parts in a partition of their counts.
ROWS_AT_ONCE, PARTS_AT_ONCE = 500_000, 10_000
#: A text that more than this share of all rows have is looked up in a broadcast table of at most as many texts.
HOT_SHARE = 1000

_FACTS = "id long, part string, n_words long, n_distinct long, n_upper long, n_points long, has_symbol boolean, d1 long, d2 long"


def _distinct(values: np.ndarray) -> int:
    ordered = np.sort(values)
    return int(np.count_nonzero(ordered[1:] != ordered[:-1])) + 1 if len(ordered) else 0


def _facts(symbols: bytes):
    wanted = np.zeros(256, bool)
    wanted[list(symbols)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "t")):
            raw, offsets = text_bytes(batch.column(2))
            hashes, first = words(raw, offsets, lower=False)
            rows = []
            for a, b, f, g in zip(offsets[:-1], offsets[1:], first[:-1], first[1:], strict=True):
                own = raw[a:b]
                digest = np.frombuffer(hashlib.blake2b(own, digest_size=16).digest(), np.int64)
                rows.append(
                    (
                        g - f,
                        _distinct(hashes[f:g]),
                        np.count_nonzero((own >= 65) & (own <= 90)),
                        np.count_nonzero((own & 0xC0) != 0x80),
                        wanted[own].any(),
                        digest[0],
                        digest[1],
                    )
                )
            kinds = [np.int64, np.int64, np.int64, np.int64, bool, np.int64, np.int64]
            made = [pa.array(np.array(c, k)) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], [f.split()[0] for f in _FACTS.split(", ")])

    return run


def text_facts(docs: DataFrame, *, symbols: str = "#$%&*|", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, n_words, n_distinct, n_upper, n_points, has_symbol, d1, d2) of whole texts; d1 and d2 are a hash of the text."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("t")
    )
    return rows.mapInArrow(_facts(symbols.encode()), _FACTS)


def with_copies(facts: DataFrame) -> DataFrame:
    """`facts`, which should be settled, with `is_copy`: whether a row with a smaller id has the same text.

    Texts of many rows, of which there can be but few, are looked up in a broadcast table, the rest by a shuffle in
    which the rows of the former are spread by their id."""
    n = facts.count()
    groups = facts.where("id is not null").groupBy("d1", "d2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1")
    groups = cut(groups, "texts of several rows")
    hot = groups.where(F.col("m") * HOT_SHARE > n).select("d1", "d2", F.col("least").alias("hot"))
    cold = groups.where(F.col("m") * HOT_SHARE <= n).select(F.lit(0).alias("k0"), F.col("d1").alias("k1"), F.col("d2").alias("k2"), "least")
    known = facts.join(F.broadcast(hot), ["d1", "d2"], "left")
    apart = F.col("hot").isNotNull() | F.col("id").isNull()
    keyed = known.withColumns(
        {
            "k0": F.when(apart, 1).otherwise(0),
            "k1": F.when(apart, F.xxhash64("id", "part", "n_words")).otherwise(F.col("d1")),
            "k2": F.when(apart, F.lit(0)).otherwise(F.col("d2")),
        }
    )
    joined = keyed.join(cold, ["k0", "k1", "k2"], "left")
    return joined.select(*facts.columns, F.coalesce(F.col("id") > F.coalesce("hot", "least"), F.lit(False)).alias("is_copy"))


def _state(names: list[str]) -> str:
    return ",".join(sorted(names))


def edges(rows: DataFrame, filters: list[str], marks: list[str], part: str) -> DataFrame:
    """(part, state, n, and for each filter that is left a struct of removed and each mark): one row a part and state.

    `rows` has a boolean column for each filter and mark. Walks the states depth first."""
    base = cut(rows.select(F.col(part).alias("part"), *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in [*filters, *marks])), "filters of each row")
    n, parts = base.agg(F.count(F.lit(1)), F.count_distinct("part")).first()
    if base.rdd.getNumPartitions() > (wanted := max(base.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_AT_ONCE))):
        base = base.coalesce(wanted)
    known: dict[str, DataFrame] = {}
    empty = F.struct(F.lit(0).cast("long").alias("removed"), *(F.lit(0).cast("long").alias(m) for m in marks))

    def counted(survivors: DataFrame, done: list[str]) -> DataFrame:
        def leaving(f: str) -> Column:
            lost = (F.count_if(F.col(f) & F.col(m)).alias(m) for m in marks)
            return F.struct(F.count_if(F.col(f)).alias("removed"), *lost)

        out = survivors.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *((empty if f in done else leaving(f)).alias(f) for f in filters))
        return out.select("part", F.lit(_state(done)).alias("state"), "n", *filters).coalesce(max(1, -(-parts // PARTS_AT_ONCE)))

    def visit(survivors: DataFrame, done: list[str]) -> None:
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        known[_state(done)] = cut(counted(survivors, done), f"removals after {_state(done) or 'nothing'}")
        for f in filters:
            after = [*done, f]
            if f not in done and len(after) < len(filters) and _state(after) not in known:
                visit(survivors.where(~F.col(f)), after)
        survivors.unpersist()

    visit(base, [])
    found = list(known.values())
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def audit(rows: DataFrame, filters: list[str], marks: list[str], *, part: str = "part") -> DataFrame:
    """One row per part, order and step: part, filter_order (array of names), step (from 1), kept, removed, redundant,
    unique_fails, `<mark>_lost` for each mark, and shapley, the removals of the step's filter summed over all orders."""
    if not 0 < len(filters) <= MOST_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"give 1 to {MOST_FILTERS} filters with different names")
    n = len(filters)
    long = F.explode(F.array(*(F.struct(F.lit(f).alias("filter"), F.col(f).alias("e")) for f in filters)))
    states = edges(rows, filters, marks, part).select("part", "state", "n", long.alias("x")).select("part", "state", "n", "x.filter", "x.e.*")
    depth = F.when(F.col("state") == "", 0).otherwise(F.size(F.split("state", ",")))
    weights = F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)))
    weight = F.get(weights, depth)
    counts = F.struct("n", "removed", *marks)
    entry = F.struct(F.concat_ws(">", "state", "filter").alias("key"), counts.alias("value"))
    rest = F.create_map(*(x for f in filters for x in (F.lit(f), F.lit(_state([g for g in filters if g != f])))))
    entries = F.struct(F.col("filter").alias("key"), F.struct("total", "alone", "shapley").alias("value"))
    per_filter = (
        states.groupBy("part", "filter")
        .agg(
            F.sum(F.when(F.col("state") == "", F.col("removed")).otherwise(0)).alias("total"),
            F.sum(F.when(F.col("state") == rest[F.col("filter")], F.col("removed")).otherwise(0)).alias("alone"),
            F.sum(F.when(depth < n, F.col("removed") * weight).otherwise(0)).alias("shapley"),
            F.map_from_entries(F.collect_list(entry)).alias("edges"),
        )
        .groupBy("part")
        .agg(F.map_from_entries(F.collect_list(entries)).alias("of"), F.map_from_entries(F.flatten(F.collect_list(F.map_entries("edges")))).alias("edges"))
    )
    orders = [",".join(p) for p in permutations(filters)]
    walks = per_filter.withColumn("o", F.explode(F.split(F.lit(";".join(orders)), ";"))).withColumn("o", F.split("o", ","))
    steps = walks.select("part", "of", "edges", "o", F.posexplode("o").alias("i", "f"))
    before = F.array_join(F.array_sort(F.slice("o", F.lit(1), F.col("i"))), ",")
    at = steps.select("part", F.col("o").alias("filter_order"), (F.col("i") + 1).alias("step"), F.col("of")[F.col("f")].alias("own"), F.col("edges")[F.concat_ws(">", before, "f")].alias("e"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return at.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        (number(F.col("e.n")) - number(F.col("e.removed"))).alias("kept"),
        number(F.col("e.removed")).alias("removed"),
        (F.col("own.total") - number(F.col("e.removed"))).alias("redundant"),
        F.col("own.alone").alias("unique_fails"),
        *(number(F.col(f"e.{m}")).alias(f"{m}_lost") for m in marks),
        "own.shapley",
    )


def with_marks(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """`facts` with `good` and `toxic`, true where a row of `labels` (doc_id, quality, toxic) with the same id says 1.
    Rows without an id are spread by their text."""
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("k1")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("x")
    )
    keyed = facts.withColumns({"k0": F.col("id").isNull(), "k1": F.coalesce("id", "d1")})
    joined = keyed.join(marked.withColumn("k0", F.lit(False)), ["k0", "k1"], "left")
    return joined.select(*facts.columns, F.coalesce(F.col("q") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("x") == 1, F.lit(False)).alias("toxic"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    facts = with_marks(with_copies(cut(text_facts(docs), "facts")), labels)
    rows = facts.select(
        "part",
        (F.col("n_words") < 200).alias("A"),
        (100 * F.col("n_distinct") < 50 * F.col("n_words")).alias("B"),
        (100 * F.col("n_upper") > 2 * F.col("n_points")).alias("C"),
        F.col("has_symbol").alias("D"),
        F.col("is_copy").alias("E"),
        "good",
        "toxic",
    )
    found = audit(rows, list("ABCDE"), ["good", "toxic"])
    return found.withColumn("filter_order", F.array_join("filter_order", ""))
