"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meritgrid.functions.positions import settled

#: Edges contracted at once inside a task.
EDGES_AT_ONCE = 1 << 20
#: At most so many moves are broadcast.
BROADCAST_ROWS = 200_000
#: Where moves are too many to be broadcast, each is sent to so many places, so that a node with many children is not
#: one task's.
SALTS = 16


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the edges (a, b) have, as edges from each node but the smallest of its component to that."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[left], parent[right]
        open_ = x != y
        if not open_.any():
            break
        left, right = left[open_], right[open_]
        np.minimum.at(parent, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (parent[parent] != parent).any():
            parent = parent[parent]
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[child], nodes[parent[child]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a task, a million at a time, as forests with a > b."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def made() -> pa.RecordBatch:
        a, b = (np.concatenate([np.zeros(0, np.int64), *(e[i] for e in held)]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(a, b)], ["a", "b"])

    n = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= EDGES_AT_ONCE:
            yield made()
            held, n = [], 0
    yield made()


def contracted(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).mapInArrow(_contracted, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b), the component named by its smallest id.

    Large-star and small-star steps (Kiveris et al., 2014) on contracted edges: before a shuffle each task replaces
    its edges by a forest, so a node comes from a task with one parent at most, and a large star, or a chain, is
    mostly settled where it lies. A round links each node to the smallest of its parents, and these to each other
    (by node: no more parents than tasks); then children of a node that has a parent itself move to that parent. The
    centre of a star has none, so its many children are moved nowhere and never gathered. Edges never grow in number,
    and the rounds needed grow with the logarithm of the longest path that contraction leaves.
    """
    edges = settled(contracted(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))), "edges")
    while True:
        least = edges.withColumn("m", F.min("b").over(W.partitionBy("a")))
        pairs = least.select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        edges = settled(contracted(pairs.select("e.*")), "edges")
        parents = edges.groupBy("a").agg(F.min("b").alias("to"), F.max("b").alias("most"))
        moves = settled(edges.select("b").distinct().join(parents.select(F.col("a").alias("b"), "to"), "b"), "moves")
        n = moves.count()
        if n == 0 and parents.where("to <> most").isEmpty():
            break
        if n:
            if n <= BROADCAST_ROWS:
                moved = edges.join(F.broadcast(moves), "b", "left")
            else:
                spread = moves.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
                moved = edges.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).join(spread, ["b", "salt"], "left")
            edges = settled(contracted(moved.select("a", F.coalesce("to", "b").alias("b"))), "edges")
    ids = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return ids.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def named_components(edges: DataFrame) -> DataFrame:
    """(id, component) for edges (a, b) between ids of any one type that can be ordered, the component named by its
    smallest id. Ids are numbered once, and components are those of the numbers."""
    ids = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    numbers = settled(ids.withColumn("n", F.monotonically_increasing_id()), "numbers of ids")
    by_number = edges.join(numbers.toDF("a", "x"), "a").join(numbers.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = settled(components(by_number).toDF("n", "c").join(numbers, "n"), "components")
    loops = numbers.join(found.select("n"), "n", "left_anti").select("id", F.col("id").alias("component"))
    least = found.groupBy("c").agg(F.min("id").alias("component"))
    return found.join(least, "c").select("id", "component").unionByName(loops)
