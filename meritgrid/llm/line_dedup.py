"""Line dedup by a deletion-neighbourhood join.

A line goes if an earlier line of the whole table, by document id and then line number, equals it, or is within
one edit of it (an inserted, deleted or replaced character) and both have at least `near_chars` characters: in
fewer, an edit tells nothing, as all lines of one character are an edit apart. Lines are compared without space,
tab, vertical tab, form feed and carriage return at their ends; a line of nothing else is blank and stays.

Equal lines are one distinct line, known by the place of its first copy. A distinct line emits the hashes of its
deletion neighbourhood: itself, and itself without each single character. A line and one with a character more
meet in the variant that is the shorter line; two lines that differ in one character meet in the variant without
it, at one position, which is part of the key. So all lines under one key are within one edit of the one they are
compared with, only the earliest of a key matters, and a minimum takes the place of pairs. As the lines are
distinct, a key has no more of them than there are characters and places to insert one. Each line and its
earliest neighbours are then verified by edit distance.

One edit leaves the first or the second half of the shorter line as it is. So the halves of all distinct lines
are counted first, with the length of the shorter line; a line emits variants only where a half of it is shared
with a line that it can be one edit from, and only at the places outside that half. This filter is exact and
keeps the variants, as many as a line has characters, from all but a few lines. What is left of these is counted
once more, by pieces of the other half: one edit leaves all but one piece as they are, so a line emits variants only
at the places of a piece without which it is like another line.

Defined results: null text stays null and has no lines; empty texts have one empty line, which stays; a null id
comes after all others; rows with one id are ordered by a hash of their texts, and rows that repeat id and
text are one document, with one result; the rest of the columns pass through; an empty table gives an empty
result. A document may lose all its lines; its text is then empty, and it stays. Texts and lines of any length
are read whole, a block of characters at a time where they emit variants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meritgrid.llm.arrowtext import mix64, slices
from meritgrid.llm.components import cut
from meritgrid.llm.frames import free_name, modest_batches
from meritgrid.llm.fingerprints import INVERSES, POWERS, PRIMES, code_points

#: One edit counts between lines of so many characters.
NEAR_CHARS = 9
#: At most so many rows of four numbers are broadcast; more are shuffled.
BROADCAST_ROWS = 100_000
#: Characters of one line, and variants of many, that are held at once.
BLOCK_CHARS = 1 << 19
_BATCH_LINES = 1 << 14
_WHITE = " \t\x0b\x0c\r"
_LAST = -(2**63)
#: Pieces that a half of a line is cut into.
PIECES = 8
PLACE = ["void", "doc", "th", "line"]
HALVES = ["own_head", "own_tail", "less_head", "less_tail"]
#: What a shared half lets a line emit: variants at places after or before a half, as one of two equally long lines
#: or as the longer one, and itself as the shorter one.
SAME_AFTER, SAME_BEFORE, LONGER_AFTER, LONGER_BEFORE, SHORTER = 1, 2, 4, 8, 16
#: What a shared piece lets a line emit: one character replaced in it, the longer line with one more in it, itself.
SAME, LONGER, ITSELF = 0, 1, 2


def considered(line: str) -> str | None:
    """The line without white space at its ends, or None if it is blank."""
    return line.strip(_WHITE) or None


def _signed(x: int) -> int:
    return x - 2**63


def halves(line: str, near_chars: int = NEAR_CHARS) -> list[int | None]:
    """Hashes of both halves of a line, and of those that it shares with a line of a character less; null where the
    shorter line is too short for an edit to count."""
    out: list[int | None] = []
    for n in (len(line), len(line) - 1):
        if n < near_chars:
            out += [None, None]
            continue
        head, tail = line[: n // 2], line[len(line) - (n - n // 2) :]
        out += [_signed(xxhash.xxh3_64_intdigest(head.encode(), seed=2 * n)), _signed(xxhash.xxh3_64_intdigest(tail.encode(), seed=2 * n + 1))]
    return out


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


_PLACE_ARROW = [pa.bool_(), pa.int64(), pa.int64(), pa.int32()]


def _lines(near_chars: int):
    names, types = [*PLACE, "h1", "h2", *HALVES], [*_PLACE_ARROW, *[pa.int64()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in (part for b in batches for part in slices(b, "t")):
            for doc, text, th in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for number, line in enumerate(text.split("\n") if text else ()):
                    if (line := considered(line)) is not None:
                        h = xxhash.xxh3_128_intdigest(line.encode())
                        rows.append(
                            (
                                doc is None,
                                _LAST if doc is None else doc,
                                th,
                                number,
                                _signed(h >> 64),
                                _signed(h & (2**64 - 1)),
                                *halves(line, near_chars),
                            )
                        )
                    if len(rows) >= _BATCH_LINES:
                        yield _batch(rows, names, types)
                        rows = []
        yield _batch(rows, names, types)

    return run


def _wanted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, text, emits) of the lines that are wanted of each document."""
    names, types = [*PLACE, "x", "emits"], [*_PLACE_ARROW, pa.string(), pa.int32()]
    for batch in (part for b in batches for part in slices(b, "t")):
        rows = []
        for void, doc, th, wanted, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines = text.split("\n")
            rows += [(void, doc, th, w["line"], lines[w["line"]].strip(_WHITE), w["emits"]) for w in wanted]
        yield _batch(rows, names, types)


def _cuts(low: int, high: int) -> list[tuple[int, int]]:
    """The pieces (a, b) of the places from low to high, next to each other."""
    at = sorted({low + (high - low) * k // PIECES for k in range(PIECES + 1)})
    return list(zip(at, at[1:], strict=False)) or [(low, high)]


def pieces(line: str, emits: int) -> Iterator[tuple[int, int, int, bool]]:
    """(key, a, b, longer) for each piece in which this line may differ from another: a hash of what is before and after it,
    for the line as it is and, as the longer one, for the shorter line's pieces."""
    for longer, n, after, before in (
        (False, len(line), SAME_AFTER | SHORTER, SAME_BEFORE | SHORTER),
        (True, len(line) - 1, LONGER_AFTER, LONGER_BEFORE),
    ):
        for flags, low, high in ((before, 0, n // 2), (after, n // 2, n)):
            for a, b in _cuts(low, high) if emits & flags else ():
                h = xxhash.xxh3_64(line[:a].encode(), seed=2 * n + 1)
                h.update(a.to_bytes(8, "little") + b"\n" + line[b + longer :].encode())
                yield _signed(h.intdigest()), a, b, longer


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = [*PLACE, "key", "a", "b", "longer"], [*_PLACE_ARROW, pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    for batch in (part for b in batches for part in slices(b, "x")):
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        yield _batch([(*row[:4], *piece) for row in rows for piece in pieces(row[4], row[5])], names, types)


def _prefix_sums(codes: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """The prefix sums modulo prime k of a line, a block of characters at a time, with each block's start."""
    prime, carry, scale = PRIMES[k], np.uint64(0), np.uint64(1)
    powers = POWERS[k].upto(min(len(codes), BLOCK_CHARS) + 1)
    for start in range(0, len(codes), BLOCK_CHARS):
        block = codes[start : start + BLOCK_CHARS].astype(np.uint64) + np.uint64(1)
        local = np.cumsum(np.append(np.uint64(0), block * powers[: len(block)] % np.uint64(prime))) % np.uint64(prime)
        sums = (carry + local * scale) % np.uint64(prime)
        yield start, sums
        carry, scale = sums[-1], scale * powers[len(block)] % np.uint64(prime)


def _inside(at: np.ndarray, ranges: list[tuple[int, int]], end: int) -> np.ndarray:
    """Which places lie in one of the ranges (a, b), the last `end` of a range included."""
    found = np.zeros(len(at), bool)
    for a, b in ranges:
        found[max(a - int(at[0]), 0) : max(b + end - int(at[0]), 0)] = True
    return found


def neighbourhood(line: str, emits: int, wanted: list[tuple[int, int, int]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of a line's variants and their roles, a block at a time: 0 one character replaced, 1 the longer line, 2 the
    shorter. With `wanted` (what, a, b) only at the places of these pieces."""
    if wanted is not None:
        kinds = {what for what, _, _ in wanted}
        emits &= (SAME_AFTER | SAME_BEFORE) * (SAME in kinds) | (LONGER_AFTER | LONGER_BEFORE) * (LONGER in kinds) | SHORTER * (ITSELF in kinds)
    codes = code_points(line)
    n, m = len(codes), len(codes) - 1
    total = [0, 0]
    for k in range(2):
        for _, sums in _prefix_sums(codes, k):
            total[k] = int(sums[-1])
    if emits & SHORTER:
        yield mix64(np.array([total[0] << 31 | total[1]], np.uint64)).view(np.int64), np.array([2], np.int8)
    if not emits & (SAME_AFTER | SAME_BEFORE | LONGER_AFTER | LONGER_BEFORE):
        return
    for (start, first), (_, second) in zip(_prefix_sums(codes, 0), _prefix_sums(codes, 1), strict=True):
        parts = []
        for k, s in enumerate((first, second)):
            prime = np.uint64(PRIMES[k])
            after = (np.uint64(total[k]) + prime - s[1:]) % prime * INVERSES[k].upto(2)[1] % prime
            parts.append((s[:-1] + after) % prime)
        values = mix64(parts[0] << np.uint64(31) | parts[1])
        at = np.arange(start, start + len(values))
        same = (at >= n // 2) if emits & SAME_AFTER else np.zeros(len(at), bool)
        same |= (at < n // 2) & bool(emits & SAME_BEFORE)
        longer = (at >= m // 2) if emits & LONGER_AFTER else np.zeros(len(at), bool)
        longer |= (at <= m // 2) & bool(emits & LONGER_BEFORE)
        if wanted is not None and len(at):
            same &= _inside(at, [(a, b) for what, a, b in wanted if what == SAME], 0)
            longer &= _inside(at, [(a, b) for what, a, b in wanted if what == LONGER], 1)
        holes = mix64(values[same] + (at[same] + 1).astype(np.uint64))
        keys = np.concatenate([holes, values[longer]]).view(np.int64)
        yield keys, np.repeat(np.array([0, 1], np.int8), [int(same.sum()), int(longer.sum())])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for b in batches for part in slices(b, "x")):
        row: list[int] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def made() -> pa.RecordBatch:
            at = pa.array(np.repeat(np.array(row, np.int64), [len(k) for k, _ in found]))  # noqa: B023
            keys = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in found)])  # noqa: B023
            roles = np.concatenate([np.zeros(0, np.int8), *(r for _, r in found)])  # noqa: B023
            return pa.RecordBatch.from_arrays(
                [*(c.take(at) for c in batch.columns[:4]), pa.array(keys), pa.array(roles)],
                [*PLACE, "key", "role"],
            )  # noqa: B023

        held = 0
        for i, (x, emits, wanted) in enumerate(zip(*(batch.column(k).to_pylist() for k in (4, 5, 6)), strict=True)):
            for part in neighbourhood(x, emits, [(w["what"], w["a"], w["b"]) for w in wanted]):
                row.append(i)
                found.append(part)
                held += len(part[0])
                if held >= BLOCK_CHARS:
                    yield made()
                    row, found, held = [], [], 0
        yield made()


_PLACE_TYPES = "void boolean, doc long, th long, line int"


def _place() -> Column:
    return F.struct(*map(F.col, PLACE))


def near_copies(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Places of the distinct lines that an earlier one is within one edit of."""
    at, shorts, longs = F.col("at"), F.col("shorts"), F.col("longs")
    keyed = distinct.select(*PLACE, F.posexplode(F.array(*HALVES)).alias("at", "half")).where("half is not null")
    counts = keyed.groupBy("half").agg(F.count_if(at < 2).alias("shorts"), F.count_if(at >= 2).alias("longs"))
    shared = counts.where((shorts > 1) | ((shorts > 0) & (longs > 0)))
    same = F.when(shorts > 1, F.when(at == 0, SAME_AFTER).otherwise(SAME_BEFORE)).otherwise(0)
    own = same.bitwiseOR(F.when(longs > 0, SHORTER).otherwise(0))
    longer = F.when(shorts > 0, F.when(at == 2, LONGER_AFTER).otherwise(LONGER_BEFORE)).otherwise(0)
    emits = keyed.join(shared, "half").select(*PLACE, F.when(at < 2, own).otherwise(longer).alias("emits")).where("emits > 0")
    able = cut(emits.groupBy(*PLACE).agg(F.bit_or("emits").alias("emits")), "able")
    wanted = able.groupBy(*PLACE[:3]).agg(F.collect_list(F.struct("line", "emits")).alias("wanted"))
    if able.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    keyed_docs = docs.where("t <> ''").select(F.col("doc").isNull().alias("void"), F.coalesce("doc", F.lit(_LAST)).alias("doc"), "th", "t")
    found = keyed_docs.join(wanted, PLACE[:3]).dropDuplicates(PLACE[:3])
    texts = cut(found.select(*PLACE[:3], "wanted", "t").mapInArrow(_wanted_lines, f"{_PLACE_TYPES}, x string, emits int"), "texts")
    pieced = cut(texts.mapInArrow(_pieces, f"{_PLACE_TYPES}, key long, a int, b int, longer boolean"), "pieces")
    alike = pieced.groupBy("key").agg(F.count_if(~F.col("longer")).alias("shorts"), F.count_if("longer").alias("longs"))
    alike = alike.where((shorts > 1) | ((shorts > 0) & (longs > 0)))
    may = F.array_compact(F.array(
        F.when(~F.col("longer") & (shorts > 1), F.lit(SAME)),
        F.when(F.col("longer") & (shorts > 0), F.lit(LONGER)),
        F.when(~F.col("longer") & (longs > 0), F.lit(ITSELF)),
    ))
    piece = F.struct("what", "a", "b")
    left = pieced.join(alike, "key").select(*PLACE, "a", "b", F.explode(may).alias("what")).groupBy(*PLACE).agg(F.collect_set(piece).alias("pieces"))
    emitters = texts.join(left, PLACE).select(*PLACE, "x", "emits", "pieces")
    variants = emitters.mapInArrow(_variants, f"{_PLACE_TYPES}, key long, role byte")
    role, here = F.col("role"), W.partitionBy("key")
    earliest = [F.min(F.when(role == r, _place())).over(here) for r in range(3)]
    witness = F.when(role == 0, earliest[0]).when(role == 1, earliest[2]).otherwise(earliest[1])
    pairs = variants.select(_place().alias("p"), witness.alias("w")).where("w < p").distinct()
    by_place = texts.select(_place().alias("p"), "x")
    both = pairs.join(by_place, "p").join(by_place.select(F.col("p").alias("w"), F.col("x").alias("y")), "w")
    return both.where(F.levenshtein("x", "y", 1) >= 0).select("p.*").distinct()


def _rebuilt(at: int, width: int):
    text_col = f"c{at}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, text_col)):
            made, all_lines, removed = [], [], []
            for text, kept in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                stay = set(kept or ())
                left = [line for n, line in enumerate(lines) if n in stay or considered(line) is None]
                made.append(None if text is None else "\n".join(left))
                all_lines.append(0 if text is None else len(lines))
                removed.append(len(lines) - len(left))
            columns = list(batch.columns[:width])
            columns[at] = pa.array(made, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(all_lines, pa.int64()), pa.array(removed, pa.int64())],
                [*batch.schema.names[:width], "n_lines", "n_removed"],
            )

    return run


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", near_chars: int | None = NEAR_CHARS) -> DataFrame:
    """`docs` with the lines that stay, and how many there were and went: n_lines and n_removed, under free names.

    `near_chars`: the least length at which one edit counts; None for equal lines only."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("th"))
    longest = 2**31 if near_chars is None else max(near_chars, 2)
    lines = plain.mapInArrow(_lines(longest), f"{_PLACE_TYPES}, h1 long, h2 long, {', '.join(f'{h} long' for h in HALVES)}")
    first = F.min(F.struct(*PLACE, *HALVES)).alias("first")
    distinct = cut(lines.groupBy("h1", "h2").agg(first).select("first.*"), "distinct")
    kept = distinct.select(*PLACE)
    if near_chars is not None:
        kept = kept.join(near_copies(plain, distinct), PLACE, "left_anti")
    kept = kept.groupBy(*PLACE[:3]).agg(F.collect_list("line").alias("kept"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    own = docs.toDF(*names)
    id_at = F.col(names[docs.columns.index(id_col)]).cast("long")
    keyed = own.select("*", id_at.isNull().alias("void"), F.coalesce(id_at, F.lit(_LAST)).alias("doc"), F.xxhash64(names[at]).alias("th"))
    joined = keyed.join(kept, ["void", "doc", "th"], "left").select(*names, "kept")
    schema = T.StructType([*own.schema, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(_rebuilt(at, len(names)), schema).toDF(*docs.columns, free_name(docs, "n_lines"), free_name(docs, "n_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"), "text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, *, drop_emptied: bool = True) -> DataFrame:
    """Documents without the lines that an earlier document, or line, has; n_chars follows the text. A document that loses
    lines and has no other left goes, unless `drop_emptied` is false: all that it said is in earlier documents."""
    modest_batches(spark)
    count = F.length(F.col("text")).cast(docs.schema["n_chars"].dataType)
    found = dedup_lines(docs)
    if drop_emptied:
        removed = found.columns[-1]
        found = found.where((F.col(removed) == 0) | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    return found.select(*(count.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))
