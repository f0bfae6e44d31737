"""Jaccard join of documents on word n-grams, by prefixes with token combinations.

A document's set holds its distinct shingles of `words` words; two documents link when their sets' Jaccard
similarity is at least `threshold`. Every set is ordered by how common its shingles are, then by their hashes,
which is one order for all. How common is read from counters that shingles share by their hashes, so its size is
fixed: a passage of many documents stands out from the mean load at any size of the table, and as it comes last, it
brings its documents together only where it is nearly all of them.
If x links to any set, it lacks at most t = |x| - ceil(threshold |x|) of x's shingles. So among the first
t + 1 of x at least one is shared, and it lies in the other's prefix too.

One shared shingle says little if it is frequent. Shingles that occur in more than `RARE` prefixes are dealt
into g classes by their hash, and prefixes are extended by g: of the t + 1 + g first shingles g + 1 are
shared, so either a rare one is, or two of one class are. Rare shingles are therefore indexed alone, frequent
ones in pairs within their class. g grows with the size of the set, so that a class has few shingles of a
prefix and a document few pairs.

Documents that share a key are candidates. Before sets are fetched, a pair must pass two bounds that no linked
pair fails: by bitmaps of the sets (bits that only one of them has are shingles that the other lacks), and by
the shingles' leading 16 bits (no fewer of them agree than shingles do). What passes is verified on the sets.

Equal sets are one class with one representative. Only components are asked for, so in a first round each
key links its representatives to the smallest, not to each other; in the second round only pairs in different
components are left to compare, and all of them are. No link between components is lost, and a group of near
copies is compared with its centre, not pair by pair. Keys of many documents that the first round left in different
components are not joined: those with the same two smallest hashes of documents are one crowd, tiles of its documents
are compared on whole sets inside tasks, and a forest of the links comes out, no more rows than documents.

Defined results: null and empty texts and those without words have an empty set and link with nothing; fewer
words than `words` make one shingle; equal sets link; rows with one id and set are one, rows with one id and
different texts are documents of their own; a null id links nothing and has no component; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgrid.llm.arrowtext import mix64, slices, text_bytes, words
from meritgrid.llm.components import components, cut, forest
from meritgrid.llm.frames import modest_batches

RARE = 16
#: Shingles share so many counters (a power of two) of how common they are.
COUNTERS = 1 << 18
#: Shingles gathered before they are counted.
COUNTED_AT_ONCE = 1 << 20
#: Words of a long text that are hashed at once.
HASHED_AT_ONCE = 1 << 18
#: Keys of up to so many documents are joined; larger ones are compared in tiles of so many.
CROWD = 64
TILE = 1024
#: Shingles that more documents than this have on either side of a pair of tiles are counted by matrices, so many at
#: once, the others by pairs, so many at once.
OFTEN, COLUMNS_AT_ONCE, PAIRS_AT_ONCE = 32, 4096, 1 << 21
#: At most so many ids are broadcast; more are shuffled.
BROADCAST_ROWS = 500_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingles(batch: pa.RecordBatch, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, one after the other, and their n + 1 offsets."""
    hashes, first = words(*text_bytes(batch.column(batch.schema.get_field_index(text))))

    def hashed(own: np.ndarray, size: int) -> np.ndarray:
        value = np.full(max(len(own) - size + 1, 0), n, np.uint64)
        for start in range(0, len(value), HASHED_AT_ONCE):
            part = value[start : start + HASHED_AT_ONCE]
            for k in range(size):
                part += mix64(own[start + k : start + k + len(part)] * _FACTORS[k % len(_FACTORS)] + np.uint64(k + 1))
            part[:] = mix64(part)
        return value

    value = hashed(hashes, n)
    parts = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        short = low < high < low + n
        own = np.sort(hashed(hashes[low:high], high - low) if short else value[low : max(high - n + 1, low)])
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        parts.append(own if new.all() else own[new])
    return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint64)]), np.cumsum([0, *map(len, parts)])


def missing(n: np.ndarray | int, threshold: Fraction):
    """How many of n shingles a linked set can lack at most."""
    return n - -(-n * threshold.numerator // threshold.denominator)


def classes_for(n: int) -> int:
    """Classes of frequent shingles for sets of the size level of n."""
    return max(1, (1 << (n.bit_length() - 1)) // 32)


def levels(n: int, threshold: Fraction) -> list[int]:
    """The numbers of classes in use for this set and the sets it can link to."""
    low = -(-n * threshold.numerator // threshold.denominator)
    high = n * threshold.denominator // threshold.numerator
    return sorted({classes_for(max(low, 1)), classes_for(n), classes_for(high)})


def bitmap(values: np.ndarray) -> bytes:
    """At least four bits a shingle, set where the shingles' leading bits say."""
    size = max(4, (len(values) - 1).bit_length()) + 2
    bits = np.zeros(1 << size, bool)
    bits[(values >> np.uint64(64 - size)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def only_in(a: bytes, b: bytes) -> tuple[int, int]:
    """The numbers of bits that only one of two bitmaps has, at the length of the shorter one."""
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8)).view(bool) for v in (a, b))
    while len(x) > len(y):
        x = x[0::2] | x[1::2]
    while len(y) > len(x):
        y = y[0::2] | y[1::2]
    return int((x & ~y).sum()), int((y & ~x).sum())


def sketch(values: np.ndarray) -> bytes:
    """The leading 16 bits of sorted shingles, as compressed differences."""
    top = (values >> np.uint64(48)).astype(np.uint16)
    return zstandard.ZstdCompressor(level=1).compress(np.diff(top, prepend=np.uint16(0)).tobytes())


def unsketched(data: bytes) -> np.ndarray:
    """The same values, made distinct by numbering equal ones."""
    top = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint16), dtype=np.int64)
    first = np.maximum.accumulate(np.where(np.diff(top, prepend=-1) != 0, np.arange(len(top)), 0))
    return top << 24 | (np.arange(len(top)) - first)


def _sums(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each set."""
    out = np.zeros((2, len(first) - 1), np.uint64)
    for i, (low, high) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        for start in range(low, high, HASHED_AT_ONCE):
            part = values[start : min(start + HASHED_AT_ONCE, high)]
            for k in (1, 2):
                out[k - 1, i] += mix64(part + np.uint64(k)).sum()
    return [row.view(np.int64) for row in out]


def _counters(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64(COUNTERS - 1)).astype(np.int64)


def _loads(n_words: int):
    """Rows (counter, load): how many shingles of a task's documents fell to each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = np.zeros(COUNTERS, np.int64)
        waiting: list[np.ndarray] = []
        held = 0
        for batch in (part for b in batches for part in slices(b, "t")):
            waiting.append(_counters(shingles(batch, "t", n_words)[0]))
            held += len(waiting[-1])
            if held >= COUNTED_AT_ONCE:
                loads += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
                waiting, held = [], 0
        loads += np.bincount(np.concatenate([*waiting, np.zeros(0, np.int64)]), minlength=COUNTERS)
        used = np.flatnonzero(loads)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(loads[used])], ["counter", "load"])

    return run


def commonness(texts: DataFrame, n_words: int) -> np.ndarray:
    """A level for each counter: 0 up to four times the mean load, and one more for each doubling beyond.

    Only counters above that come to the driver, at most a quarter of them."""
    loads = texts.mapInArrow(_loads(n_words), "counter int, load long").groupBy("counter").agg(F.sum("load").alias("load"))
    loads = cut(loads, "loads")
    mean = max((loads.agg(F.sum("load")).first()[0] or 0) / COUNTERS, 1.0)
    level = np.zeros(COUNTERS, np.uint8)
    heavy = loads.where(F.col("load") >= 4 * mean).toPandas()
    level[heavy["counter"].to_numpy(np.int64)] = np.log2(heavy["load"].to_numpy(np.float64) / mean).astype(np.uint8) - 1
    return level


def leading(values: np.ndarray, stop: int, level: np.ndarray) -> np.ndarray:
    """The first `stop` of a document's sorted shingles in the order of levels, then hashes."""
    of = level[_counters(values)]
    return values[np.argsort(of, kind="stable")[:stop]] if of.any() else values[:stop]


def _sets(n_words: int, threshold: Fraction, level: np.ndarray | None = None):
    """Rows (id, th, n, s1, s2) of rows (id, t, th): the size of the set and two hashes; with levels its prefix and
    bitmap as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "t")):
            values, first = shingles(batch, "t", n_words)
            size = np.diff(first)
            columns = [batch.column(0), batch.column(2), pa.array(size, pa.int64()), *(pa.array(s) for s in _sums(values, first))]
            names = ["id", "th", "n", "s1", "s2"]
            if level is not None:
                prefixes, maps = [], []
                for i, n in enumerate(size.tolist()):
                    stop = min(n, missing(n, threshold) + 1 + levels(n, threshold)[-1]) if n else 0
                    prefixes.append(leading(values[first[i] : first[i + 1]], stop, level).view(np.int64))
                    maps.append(bitmap(values[first[i] : first[i + 1]]) if n else b"")
                columns += [pa.array(prefixes, pa.list_(pa.int64())), pa.array(maps, pa.binary())]
                names += ["prefix", "bits"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _pair_keys(threshold: Fraction):
    """Rows (key, rep, n): pairs of a document's frequent shingles within a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                made: list[np.ndarray] = []
                rows: list[int] = []
                for row, (n, tokens) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    t = np.sort(np.array(tokens, np.int64).view(np.uint64))
                    mixed = mix64(t + np.uint64(77))
                    for g in levels(n, threshold):
                        of = (mixed % np.uint64(g)).astype(np.int64)
                        i, j = np.triu_indices(len(t), 1) if g == 1 else _within(of)
                        made.append(mix64(mix64(t[i] + np.uint64(g)) + t[j]))
                        rows.append(row)
                keys = np.concatenate([*made, np.zeros(0, np.uint64)])
                at = pa.array(np.repeat(np.array(rows, np.int64), [len(k) for k in made]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)],
                    ["key", "rep", "n"],
                )

    return run


def _within(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of the same class."""
    order = np.argsort(of, kind="stable")
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        if len(part) > 1:
            i, j = np.triu_indices(len(part), 1)
            left.append(part[i])
            right.append(part[j])
    return np.concatenate(left), np.concatenate(right)


def enough(common: int, n: int, m: int, threshold: Fraction) -> bool:
    """Whether so many common shingles reach the threshold."""
    return common * (threshold.numerator + threshold.denominator) >= threshold.numerator * (n + m)


def _kept(test):
    """Rows (x, y) for which `test` of the row's other columns holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            others = [batch.column(i).to_pylist() for i in range(2, batch.num_columns)]
            rows = pa.array([i for i, v in enumerate(zip(*others, strict=True)) if test(*v)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], ["x", "y"])

    return run


def _by_bitmaps(threshold: Fraction):
    def test(n: int, m: int, a: bytes, b: bytes) -> bool:
        x, y = only_in(a, b)
        return enough(min(n - x, m - y), n, m, threshold)

    return test


def _by_sketches(threshold: Fraction):
    def test(a: bytes, b: bytes) -> bool:
        x, y = unsketched(a), unsketched(b)
        return enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), threshold)

    return test


def _by_sets(threshold: Fraction):
    def test(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        return enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), threshold)

    return test


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of `a` shares with each of `b`. Shingles that many of the sets have are counted by
    products of incidence matrices, a slice of them at a time, the others pair by pair."""
    out = np.zeros((len(a), len(b)), np.int32)
    values, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    sizes = [len(x) for x in a]
    cut_at = sum(sizes)
    rows_a, rows_b = np.repeat(np.arange(len(a)), sizes), np.repeat(np.arange(len(b)), [len(x) for x in b])
    in_a, in_b = at[:cut_at], at[cut_at:]
    count_a, count_b = np.bincount(in_a, minlength=len(values)), np.bincount(in_b, minlength=len(values))
    often = (count_a > OFTEN) & (count_b > OFTEN)
    column = np.cumsum(often) - 1
    keep_a, keep_b = often[in_a], often[in_b]
    for start in range(0, int(often.sum()), COLUMNS_AT_ONCE):
        left, right = (np.zeros((len(x), COLUMNS_AT_ONCE), np.float32) for x in (a, b))
        for matrix, rows, places in ((left, rows_a[keep_a], column[in_a[keep_a]]), (right, rows_b[keep_b], column[in_b[keep_b]])):
            inside = (places >= start) & (places < start + COLUMNS_AT_ONCE)
            matrix[rows[inside], places[inside] - start] = 1
        out += (left @ right.T).astype(np.int32)
    rare = ~often & (count_a > 0) & (count_b > 0)
    use_a, use_b = rare[in_a], rare[in_b]
    order_b = np.argsort(in_b[use_b], kind="stable")
    value_b, row_b = in_b[use_b][order_b], rows_b[use_b][order_b]
    value_a, row_a = in_a[use_a], rows_a[use_a]
    first = np.searchsorted(value_b, value_a)
    many = count_b[value_a]
    ends = np.cumsum(many)
    start = 0
    while start < len(many):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS_AT_ONCE, side="right")))
        n = many[start:stop]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        pair = np.repeat(row_a[start:stop], n) * len(b) + row_b[np.repeat(first[start:stop], n) + within]
        out += np.bincount(pair, minlength=out.size).reshape(out.shape).astype(np.int32)
        start = stop
    return out


def _joined_tiles(a: list[tuple], b: list[tuple], inside: bool, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The links between documents (rep, n, label, set), one of either side, of different labels, as a forest of the
    same components: no more edges than documents, however many pairs link."""
    common = _shared([r[3] for r in a], [r[3] for r in b]).astype(np.int64)
    (rx, nx, cx), (ry, ny, cy) = ([np.array([r[k] for r in side], np.int64) for k in range(3)] for side in (a, b))
    t, s = threshold.numerator, threshold.numerator + threshold.denominator
    ok = (common * s >= t * (nx[:, None] + ny[None, :])) & (cx[:, None] != cy[None, :])
    ok &= (rx[:, None] < ry[None, :]) if inside else (rx[:, None] != ry[None, :])
    x, y = np.nonzero(ok)
    return forest(rx[x], ry[y])


def _crowds(threshold: Fraction):
    """Rows (x, y), a forest of the links in each pair of tiles, out of rows (key, i, j, side, rep, n, c, shingles), sorted
    by all but the last four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        sides: tuple[list, list] = ([], [])

        def done() -> pa.RecordBatch:
            x, y = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if now is not None:
                inside = now[1] == now[2]
                right = sides[0] if inside else sides[1]
                if sides[0] and right:
                    y, x = _joined_tiles(sides[0], right, inside, threshold)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])

        for batch in batches:
            for key, i, j, side, rep, n, c, values in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if (key, i, j) != now:
                    yield done()
                    now, sides = (key, i, j), ([], [])
                sides[side].append((rep, n, c, np.frombuffer(values, np.uint64)))
        yield done()

    return run


def _whole_sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "t")):
            values, first = shingles(batch, "t", n_words)
            parts = [values[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            made = [pa.array([f(v) for v in parts], pa.binary()) for f in (sketch, np.ndarray.tobytes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_sums(values, first)[0]), batch.column(2), *made],
                ["rep", "own", "s1", "sketch", "shingles"],
            )

    return run


def _joined(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Pairs (x, y) with both sides' columns, each column's two sides next to each other."""
    out = pairs
    for side in "xy":
        out = out.join(table.select(F.col("rep").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)
    return out.select("x", "y", *(f"{side}_{c}" for c in columns for side in "xy"))


def _fetched(ids: DataFrame, reps: DataFrame, docs: DataFrame, n_words: int) -> DataFrame:
    """(rep, sketch, shingles) of the representatives `ids` (rep), made of their texts."""
    wanted = cut(ids.distinct().join(reps.select("rep", "s1", F.col("least.id").alias("id"), F.col("least.th").alias("th")), "rep"), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, ["id", "th"]).select("rep", "t", "s1")
    made = texts.mapInArrow(_whole_sets(n_words), "rep long, own long, s1 long, sketch binary, shingles binary").where("own = s1")
    return cut(made.dropDuplicates(["rep"]).select("rep", "sketch", "shingles"), "sets")


def _linked(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n_words: int, threshold: Fraction) -> DataFrame:
    """Those of the pairs (x, y) that link."""
    likely = cut(_joined(pairs, reps, "n", "bits").mapInArrow(_kept(_by_bitmaps(threshold)), "x long, y long"), "likely")
    ids = likely.select(F.col("x").alias("rep")).unionByName(likely.select(F.col("y").alias("rep")))
    sets = _fetched(ids, reps, docs, n_words)
    close = cut(_joined(likely, sets, "sketch").mapInArrow(_kept(_by_sketches(threshold)), "x long, y long"), "close")
    return cut(_joined(close, sets, "shingles").mapInArrow(_kept(_by_sets(threshold)), "x long, y long"), "links")


def jaccard_groups(docs: DataFrame, *, words: int, threshold: str | Fraction, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, th (a hash of the text), n_shingles, and best, the smallest (id, th) reachable by
    links, null for a row that has no words or no id.

    Equal sets are a class. A class has a number of its own, as an id may have several texts; its smallest (id, th) says
    where its text is found."""
    t = Fraction(threshold)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("th"))
    texts = plain.where("id is not null and t <> ''")
    found = texts.mapInArrow(_sets(words, t, commonness(texts, words)), "id long, th long, n long, s1 long, s2 long, prefix array<long>, bits binary")
    reps = cut(
        found.where("n > 0").groupBy("n", "s1", "s2").agg(
            F.min(F.struct("id", "th")).alias("least"),
            F.first("prefix").alias("prefix"),
            F.first("bits").alias("bits"),
        ).withColumn("rep", F.monotonically_increasing_id()), "reps"
    )

    tokens = reps.select("rep", F.explode("prefix").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = cut(tokens.join(often, "token").join(reps.select("rep", "n"), "rep"), "shared")
    frequent = shared.where(F.col("df") > RARE).groupBy("rep", "n").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") > 1)
    made = shared.where(F.col("df") <= RARE).select(F.col("token").alias("key"), "rep", "n").unionByName(
        frequent.select("rep", "n", "tokens").mapInArrow(_pair_keys(t), "key long, rep long, n long")
    )
    made = cut(made, "keys")
    centres = made.groupBy("key").agg(
        F.min(F.struct(F.col("rep").alias("x"), F.col("n").alias("nx"))).alias("c"),
        F.count(F.lit(1)).alias("m"),
    ).where("m > 1")
    keys = cut(made.join(centres.select("key", "c.*"), "key"), "shared keys")
    near_size = lambda a, b: F.least(a, b) * t.denominator >= F.greatest(a, b) * t.numerator
    star = keys.where((F.col("rep") != F.col("x")) & near_size(F.col("n"), F.col("nx"))).select("x", F.col("rep").alias("y")).distinct()
    links = _linked(cut(star, "star"), reps, plain, words, t)
    # A label for the second round only: the smallest centre a document links to, or that centre's own. Documents of
    # one component may have several labels, then some pairs too many are compared.
    centre = links.groupBy(F.col("y").alias("rep")).agg(F.min("x").alias("c"))
    joined = cut(centre.join(centre.toDF("c", "cc"), "c", "left").select("rep", F.coalesce("cc", "c").alias("c")), "labels")
    placed = keys.select("key", "rep", "n").join(joined.toDF("rep", "c"), "rep", "left").select("key", "rep", "n", F.coalesce("c", "rep").alias("c"))
    members = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"x{i}") for i in range(2)]
    least = [F.min(F.xxhash64("rep", F.lit(i))).alias(f"g{i}") for i in range(2, 4)]
    apart = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("m"), *members, *least)
    # Keys with the same documents are one. Crowded keys of the same two smallest hashes are compared as one crowd of
    # all their documents: a passage has thousands of keys whose documents are nearly the same.
    different = apart.where("low <> high").groupBy("m", "x0", "x1").agg(F.min("key").alias("key"), F.first("g2").alias("g2"), F.first("g3").alias("g3"))
    open_ = cut(placed.join(different.select("key", "m", "g2", "g3"), "key"), "open keys")
    few = open_.where(F.col("m") <= CROWD)
    a, b = few.select("key", "rep", "n", "c").toDF("key", "x", "nx", "cx"), few.select("key", "rep", "n", "c").toDF("key", "y", "ny", "cy")
    on = (a["key"] == b["key"]) & (F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & near_size(F.col("nx"), F.col("ny"))
    rest = a.join(b, on).select("x", "y")
    crowd = F.xxhash64("g2", "g3").alias("key")
    crowded = cut(open_.where(F.col("m") > CROWD).select(crowd, "rep", "n", "c").distinct(), "crowded")
    tiles = F.ceil(F.col("k") / F.lit(TILE)).cast("int")
    many = crowded.join(crowded.groupBy("key").agg(F.count(F.lit(1)).alias("k")), "key").withColumn("own", F.pmod(F.xxhash64("rep"), tiles).cast("int"))
    many = many.select("key", "rep", "n", "c", "own", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    work = many.select(
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "rep",
        "n",
        "c",
    )
    rest = rest.distinct().join(star, ["x", "y"], "left_anti")
    crowds = links.limit(0)
    if not many.isEmpty():
        sets = _fetched(many.select("rep"), reps, plain, words).select("rep", "shingles")
        dealt = work.join(sets, "rep").select("key", "i", "j", "side", "rep", "n", "c", "shingles").repartition("key", "i", "j")
        crowds = cut(dealt.sortWithinPartitions("key", "i", "j", "side", "rep").mapInArrow(_crowds(t), "x long, y long"), "crowds")
    more = _linked(cut(rest, "rest"), reps, plain, words, t)
    all_links = links.unionByName(more).unionByName(crowds).select(F.col("x").alias("a"), F.col("y").alias("b"))
    final = cut(reps.select("rep", "least").join(components(all_links).toDF("rep", "c"), "rep"), "components")
    smallest = final.groupBy("c").agg(F.min("least").alias("best"))
    joined = final.select("rep", "c").join(smallest, "c").select("rep", "best")
    named = reps.select("n", "s1", "s2", "rep", "least").join(joined, "rep", "left").select("n", "s1", "s2", F.coalesce("best", "least").alias("best"))
    rows = plain.mapInArrow(_sets(words, t), "id long, th long, n long, s1 long, s2 long")
    return rows.join(named, ["n", "s1", "s2"], "left").select(
        F.col("id").alias(id_col), "th", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("best")).alias("best")
    )


def jaccard_components(docs: DataFrame, *, words: int, threshold: str | Fraction, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (the smallest id reachable by links)."""
    groups = jaccard_groups(docs, words=words, threshold=threshold, id_col=id_col, text_col=text_col)
    return groups.select(id_col, "n_shingles", F.coalesce("best.id", id_col).alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, words=3, threshold="0.9")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id (of one id's texts that with the
    smallest hash); rows with the same id and text stay or go together; columns as they came."""
    modest_batches(spark)
    groups = jaccard_groups(docs, words=5, threshold="0.8")
    goes = groups.where((F.col("doc_id") != F.col("best.id")) | (F.col("th") != F.col("best.th"))).select(F.col("doc_id").alias("i"), F.col("th").alias("h")).distinct()
    return docs.join(goes, (F.col("doc_id") == F.col("i")) & (F.xxhash64("text") == F.col("h")), "left_anti").select(*docs.columns)
