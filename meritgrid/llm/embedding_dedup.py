"""Near-duplicate embeddings by Euclidean p-stable hashing.

Two vectors are compared if they have one label and one number of components, and link if their cosine is at
least the threshold. On the unit sphere that is a Euclidean distance of at most sqrt(2 - 2 t), so each table
quantises `PROJECTIONS` Gaussian projections of the normalised vector, shifted at random, into cells of width
`WIDTH`; vectors that meet in a cell of some table are compared exactly, in double precision. At the threshold
0.93 two vectors share a cell of one table with probability 0.20, and of one of the `TABLES` with 0.999; more
similar ones almost surely. Below the threshold nothing links.

Equal vectors are one class, compared once. Cells that hold the same classes in several tables are one cell, that
of the first table, so a group of near copies that stay together meets once, not in every table. Cells of more
than `TILE` classes are cut into tiles by a hash and each pair of tiles is one piece of work, so no cell is
gathered in one task; a piece of work returns a number of links and a component for each class in it, not pairs.
A pair that meets in several cells counts in the first table that has it. Numbers of links ask for every pair of a
group of near copies to be looked at: that is a matrix product, and the one term here that is not linear.

Defined results: a vector that is null, empty or zero, or holds a null or a component that is not finite, and
one without a label, links with nothing and is its own component; rows with one id and one vector are copies
that link; equal vectors link; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meritgrid.llm.arrowtext import mix64
from meritgrid.llm.components import components, cut, forest

THRESHOLD = 0.93
TABLES = 32
PROJECTIONS = 10
WIDTH = 2.0
TILE = 2048
#: Rows of a tile compared at once with the other tile.
BLOCK = 512
#: Cells of up to so many classes are compared together, so many pairs at once.
SMALL, PAIRS_AT_ONCE = 64, 1 << 14
SEED = 93

_planes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def planes(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if size not in _planes:
        rng = np.random.default_rng([SEED, size])
        _planes[size] = (
            rng.standard_normal((size, TABLES * PROJECTIONS)),
            rng.uniform(0, WIDTH, TABLES * PROJECTIONS),
            rng.integers(1, 2**63, (TABLES, PROJECTIONS), dtype=np.int64) | 1,
        )
    return _planes[size]


def cells(unit: np.ndarray) -> np.ndarray:
    """The cell of each unit vector in each table, as one number."""
    gauss, shift, odd = planes(unit.shape[1])
    at = np.floor((unit @ gauss + shift) / WIDTH).astype(np.int64).reshape(len(unit), TABLES, PROJECTIONS)
    return (at * odd).sum(axis=2)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _vectors(raw: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32 if width == 4 else np.float64).reshape(len(raw), -1).astype(np.float64)


def _hashed(width: int):
    """Rows (rep, table, key): of each class its cell in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            by_size: dict[int, list[int]] = {}
            reps, groups, raw = (batch.column(i) for i in range(3))
            raw = raw.to_pylist()
            for i, v in enumerate(raw):
                by_size.setdefault(len(v), []).append(i)
            for rows in by_size.values():
                at = cells(_unit(_vectors([raw[i] for i in rows], width))).view(np.uint64)
                of = groups.take(pa.array(rows)).to_numpy(zero_copy_only=False).view(np.uint64)[:, None]
                tables = np.arange(TABLES, dtype=np.int32)
                keys = mix64(mix64(of + tables.astype(np.uint64)) + at).view(np.int64)
                ids = np.repeat(reps.take(pa.array(rows)).to_numpy(zero_copy_only=False), TABLES)
                columns = [pa.array(ids), pa.array(np.tile(tables, len(rows))), pa.array(keys.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "table", "key"])

    return run


class _Rows:
    """Rows of cells or tiles as arrays: key, table, i, j, side, class, number of copies, group, vector."""

    def __init__(self, columns: list[np.ndarray]):
        self.columns = columns
        self.key, self.table, self.i, self.j, self.side, self.ids, self.n, self.group, self.raw = columns
        self.located: np.ndarray | None = None

    def where(self, rows: np.ndarray | slice) -> _Rows:
        return _Rows([c[rows] for c in self.columns])

    def with_vectors(self, width: int) -> _Rows:
        self.unit = _unit(_vectors(list(self.raw), width))
        return self

    def in_table(self, t: int) -> np.ndarray:
        if self.located is None:
            self.located = np.ascontiguousarray(cells(self.unit).T)
        return self.located[t]


def _named(ids: np.ndarray, child: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Of each id its root in a forest."""
    if not len(child):
        return ids
    at = np.minimum(np.searchsorted(child, ids), len(child) - 1)
    return np.where(child[at] == ids, parent[at], ids)


def _small(rows: _Rows, threshold: float) -> tuple[np.ndarray, ...]:
    """(classes, links, components) of many small cells, one after the other."""
    n = len(rows.key)
    first = np.flatnonzero(np.append(True, (rows.key[1:] != rows.key[:-1]) | (rows.i[1:] != rows.i[:-1])))
    sizes = np.diff(np.append(first, n))
    after = np.repeat(first + sizes, sizes) - np.arange(n) - 1
    ends = np.cumsum(after)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for start in range(0, int(ends[-1]), PAIRS_AT_ONCE):
        pair = np.arange(start, min(start + PAIRS_AT_ONCE, int(ends[-1])))
        x = np.searchsorted(ends, pair, side="right")
        y = x + 1 + pair - (ends[x] - after[x])
        ok = (np.einsum("ij,ij->i", rows.unit[x], rows.unit[y]) >= threshold) & (rows.group[x] == rows.group[y])
        found.append((x[ok], y[ok]))
    x, y = (np.concatenate(f) for f in zip(*found, strict=True))
    if len(x):
        used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        of = cells(rows.unit[used])
        met = (of[at[: len(x)]] == of[at[len(x) :]]) & (np.arange(TABLES) < rows.table[x][:, None])
        x, y = x[~met.any(axis=1)], y[~met.any(axis=1)]
    ids, at = np.unique(np.concatenate([rows.ids[x], rows.ids[y]]), return_inverse=True)
    links = np.bincount(at, np.concatenate([rows.n[y], rows.n[x]]), len(ids)).astype(np.int64)
    return ids, links, _named(ids, *forest(rows.ids[x], rows.ids[y]))


def _near(table: int, inside: bool, a: _Rows, b: _Rows, threshold: float) -> np.ndarray:
    """Which pairs of two tiles link and meet in no table before this one; of pairs inside one tile both ways."""
    near = np.zeros((len(a.ids), len(b.ids)), bool)
    for start in range(0, len(a.ids), BLOCK):
        part = slice(start, start + BLOCK)
        block = (a.unit[part] @ b.unit.T >= threshold) & (a.group[part, None] == b.group[None, :])
        if inside:
            block = np.triu(block, start + 1)
        if table and np.count_nonzero(block) * 8 > block.size:
            for t in range(table):
                block &= a.in_table(t)[part, None] != b.in_table(t)[None, :]
        elif table and block.any():
            x, y = np.nonzero(block)
            met = np.zeros(len(x), bool)
            for t in range(table):
                met |= a.in_table(t)[x + start] == b.in_table(t)[y]
            block[x[met], y[met]] = False
        near[part] = block
    return near | near.T if inside else near


def _joined(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a matrix of links its component, named by the smallest of the ids of both."""
    if np.count_nonzero(near) * 32 > near.size:
        most = np.iinfo(np.int64).max
        for _ in range(8):
            before = left, right
            left = np.minimum(left, np.where(near, right[None, :], most).min(axis=1))
            right = np.minimum(right, np.where(near, left[:, None], most).min(axis=0))
            if (left == before[0]).all() and (right == before[1]).all():
                return left, right
    x, y = np.nonzero(near)
    tree = forest(left[x], right[y])
    return _named(left, *tree), _named(right, *tree)


def _compare(table: int, inside: bool, a: _Rows, b: _Rows, threshold: float) -> list[tuple[np.ndarray, ...]]:
    """(classes, links, components) of one pair of tiles, or of the pairs inside one."""
    near = _near(table, inside, a, b, threshold)
    if not near.any():
        return []
    links = [near.astype(np.float32) @ b.n.astype(np.float64), near.T.astype(np.float32) @ a.n.astype(np.float64)]
    roots = _joined(near, a.ids, b.ids)
    out = []
    for side, n, root in zip((a,) if inside else (a, b), links, roots, strict=False):
        some = n > 0
        out.append((side.ids[some], n[some].astype(np.int64), root[some]))
    return out


def _work(threshold: float, width: int):
    """Rows (rep, links, component) out of rows sorted by cell and pair of tiles, side and class."""

    def done(rows: _Rows) -> Iterator[tuple[np.ndarray, ...]]:
        """Of rows that end where a cell or pair of tiles ends."""
        new = (rows.key[1:] != rows.key[:-1]) | (rows.i[1:] != rows.i[:-1]) | (rows.j[1:] != rows.j[:-1])
        first = np.flatnonzero(np.append(True, new))
        sizes = np.diff(np.append(first, len(rows.key)))
        small = (sizes <= SMALL) & (rows.i[first] == rows.j[first])
        bytes_of = np.fromiter(map(len, rows.raw), np.int64, len(rows.raw))
        for size in np.unique(bytes_of):
            some = rows.where(np.repeat(small, sizes) & (bytes_of == size))
            if len(some.key):
                yield _small(some.with_vectors(width), threshold)
            for start, n in zip(first[~small].tolist(), sizes[~small].tolist(), strict=True):
                tile = rows.where(slice(start, start + n))
                tile = tile.where(bytes_of[start : start + n] == size)
                if len(tile.key) > 1:
                    inside = tile.i[0] == tile.j[0]
                    left = tile.where(tile.side == 0)
                    right = tile.where(tile.side == 1)
                    if len(left.key) and (inside or len(right.key)):
                        left.with_vectors(width)
                        yield from _compare(int(tile.table[0]), inside, left, left if inside else right.with_vectors(width), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            last = tuple(c[-1] for c in (columns[0], columns[2], columns[3]))
            open_from = int(np.flatnonzero(~((columns[0] == last[0]) & (columns[2] == last[1]) & (columns[3] == last[2])))[-1:].sum() + 1)
            if all((columns[k] == v).all() for k, v in zip((0, 2, 3), last, strict=True)):
                open_from = 0
            if held and (open_from or tuple(held[-1][k][-1] for k in (0, 2, 3)) != last):
                whole = [np.concatenate(c) for c in zip(*held, [c[:open_from] for c in columns], strict=True)]
                yield _links(list(done(_Rows(whole))))
                held = []
            elif open_from:
                yield _links(list(done(_Rows([c[:open_from] for c in columns]))))
            held.append([c[open_from:] for c in columns])
        if held:
            yield _links(list(done(_Rows([np.concatenate(c) for c in zip(*held, strict=True)]))))

    return run


def _links(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in columns], ["rep", "links", "component"])


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row: id, n_links, component_id, kept."""
    v, label = F.col(vector_col).cast("array<double>"), F.col(label_col).cast("string")
    usable = (
        F.col(label_col).isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(usable, F.sha2(F.concat_ws("|", F.length(label), label, F.size(v), v.cast("array<string>")).cast("binary"), 256)).alias("same"),
        F.when(usable, F.xxhash64(F.col(label_col), F.size(v))).alias("group"),
        F.when(usable, v).alias("v"),
    )
    element = vectors.schema[vector_col].dataType.elementType
    width = 4 if isinstance(element, T.FloatType) else 8
    packed = rows.where("same is not null and id is not null").mapInArrow(_packed(width), "id long, same string, group long, v binary")
    classes = cut(
        packed.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("group").alias("group"), F.first("v").alias("v")),
        "classes",
    )
    light = classes.select("rep", "group", "v").mapInArrow(_hashed(width), "rep long, table int, key long")
    members = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"x{i}") for i in range(2)]
    crowded = light.groupBy("key").agg(F.min("table").alias("table"), F.count(F.lit(1)).alias("m"), *members).where("m > 1")
    kept = crowded.groupBy("m", "x0", "x1").agg(F.min(F.struct("table", "key")).alias("f")).select(
        "f.*",
        F.ceil(F.col("m") / F.lit(TILE)).cast("int").alias("tiles"),
    )
    own, tiles = F.col("own"), F.col("tiles")
    met = light.select("rep", "key").join(kept, "key").withColumn("own", F.pmod(F.xxhash64("rep"), tiles).cast("int"))
    met = met.select("rep", "key", "table", "own", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    met = met.select(
        "rep",
        "key",
        "table",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.when(own <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    work = ["key", "table", "i", "j"]
    dealt = met.join(
        classes.select("rep", "n", "group", "v"),
        "rep",
    ).select(*work, "side", "rep", "n", "group", "v").repartition(*work).sortWithinPartitions(*work, "side", "rep")
    found = dealt.mapInArrow(_work(threshold, width), "rep long, links long, component long")
    found = cut(found, "links")
    grouped = components(found.select(F.col("rep").alias("a"), F.col("component").alias("b")))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    result = (
        classes.select("same", "rep", "n")
        .join(linked, "rep", "left")
        .join(grouped.withColumnRenamed("id", "rep"), "rep", "left")
        .select("same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    return rows.select("id", "same").join(result, "same", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component", "id")).alias("kept"),
    )


def _packed(width: int):
    """Vectors as the bytes of their components, floats where the column has floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("v")
            made = [np.array(x, np.float32 if width == 4 else np.float64).tobytes() for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, "v", pa.array(made, pa.binary()))

    return run


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
