"""Document fingerprints from prefix polynomial hashes.

For each of two primes, a text's prefix array holds the sums of (code point + 1) * base^i, modulo the prime.
The hash of any span is the difference of two entries, divided by a power of the base; equal spans have equal
hashes, and where two texts stop agreeing is found by binary search, for prefixes that agree are hashes that
agree.

A fingerprint is text: the number of code points, the hash of the whole, and a sketch. The sketch takes the
hashes of all spans of `SPAN` code points, the second and further copies of a span apart, deals them into `SLOTS` slots and keeps one byte of the smallest of
each. `likeness` compares two fingerprints without their texts: the share of slots that agree, less what
chance gives, estimates which part of all spans both texts have, and 2 j / (1 + j) turns that into the part
of a text that they share. It is 1 for equal texts only.

Defined results: null text counts as empty; empty texts have one fingerprint, like each other and nothing
else; a text shorter than a span is one span; rows with equal ids follow each other in the order of their
texts; a null id comes after all others; a task holds two texts at a time, with some 50 bytes for each code
point of them; other columns are not read; an empty table gives an empty result,
and a single document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgrid.llm.arrowtext import mix64, slices
from meritgrid.llm.frames import modest_batches

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_299_709_013)
SPAN = 8
#: Texts of fewer code points than this are sketched by shorter spans as well.
SHORT_TEXT = 32
SHORT_SPAN = 3
SLOTS = 128
BUCKET_DOCS = 2048
MOST_BUCKETS = 20_000
FIRST_KEY = -(2**63)
#: Code points that are worked on at once, so temporary arrays are small beside the prefix arrays.
AT_ONCE = 1 << 18


class _Powers:
    """Powers of a base modulo a prime, as many as have been asked for."""

    def __init__(self, base: int, prime: int):
        self.base, self.prime, self.table = base, prime, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = np.uint64(pow(self.base, len(self.table), self.prime))
            self.table = np.concatenate([self.table, self.table * step % np.uint64(self.prime)])
        return self.table


POWERS = [_Powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]
INVERSES = [_Powers(pow(b, -1, p), p) for b, p in zip(BASES, PRIMES, strict=True)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """Prefix arrays of one text; `sums[k][i]` covers its first i code points."""

    def __init__(self, codes: np.ndarray, start: PrefixHash | None = None, kept: int = 0):
        """With `start`, its first `kept` code points stand before `codes`."""
        self.n = kept + len(codes)
        self.sums = []
        for k, prime in enumerate(PRIMES):
            powers = POWERS[k].upto(self.n + 1)
            sums = np.zeros(self.n + 1, np.uint64)
            if start is not None:
                sums[: kept + 1] = start.sums[k][: kept + 1]
            for low in range(kept, self.n, AT_ONCE):
                high = min(low + AT_ONCE, self.n)
                terms = (codes[low - kept : high - kept].astype(np.uint64) + np.uint64(1)) * powers[low:high] % np.uint64(prime)
                sums[low + 1 : high + 1] = (np.cumsum(terms) + sums[low]) % np.uint64(prime)
            self.sums.append(sums)

    def spans(self, starts: np.ndarray, size: int, k: int) -> np.ndarray:
        """Hashes modulo prime k of the spans of `size` code points at `starts`."""
        prime = np.uint64(PRIMES[k])
        rise = (self.sums[k][starts + size] + prime - self.sums[k][starts]) % prime
        return rise * INVERSES[k].upto(self.n + 1)[starts] % prime

    def span(self, i: int, j: int) -> int:
        """One number for code points i to j - 1; equal spans of any two texts have the same."""
        out = 0
        for k, prime in enumerate(PRIMES):
            out = out << 31 | (int(self.sums[k][j]) - int(self.sums[k][i])) * int(INVERSES[k].upto(self.n + 1)[i]) % prime
        return out

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """The longest common extension: how far this text from i and the other from j agree."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(i, i + middle) == other.span(j, j + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def common_suffix(self, other: PrefixHash) -> int:
        low, high = 0, min(self.n, other.n)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(self.n - middle, self.n) == other.span(other.n - middle, other.n):
                low = middle
            else:
                high = middle - 1
        return low

    def _mixed(self, size: int) -> np.ndarray:
        out = np.zeros(self.n - size + 1, np.uint64)
        for low in range(0, len(out), AT_ONCE):
            starts = np.arange(low, min(low + AT_ONCE, len(out)))
            out[low : low + len(starts)] = mix64(self.spans(starts, size, 0) << np.uint64(31) | self.spans(starts, size, 1))
        return out

    def fingerprint(self) -> str:
        sketch = ["--"] * SLOTS
        sizes = [SPAN, *([SHORT_SPAN] if self.n < SHORT_TEXT else [])]
        values = np.concatenate([self._mixed(min(s, self.n)) for s in sizes]) if self.n else np.zeros(0, np.uint64)
        values.sort()
        least = np.full(SLOTS, np.uint64(0xFFFFFFFFFFFFFFFF))
        before, copies = None, 0
        for low in range(0, len(values), AT_ONCE):
            part = values[low : low + AT_ONCE]
            new = np.ones(len(part), bool)
            new[1:] = part[1:] != part[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(part)), 0))
            nth = np.arange(len(part)) - first
            if part[0] == before:  # copies of a span go on from the part before
                nth[first == 0] += copies
            before, copies = part[-1], int(nth[-1]) + 1
            mixed = mix64(part + nth.astype(np.uint64))
            np.minimum.at(least, (mixed >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64), mixed)
        for slot in np.flatnonzero(least != np.uint64(0xFFFFFFFFFFFFFFFF)).tolist():
            sketch[slot] = f"{int(least[slot]) & 255:02x}"
        return f"{self.n:x}.{self.span(0, self.n):016x}.{''.join(sketch)}"


def likeness(a: str, b: str) -> float:
    """From 0 to 1, from the fingerprints alone."""
    if a == b:
        return 1.0
    left, right = (np.frombuffer(x.rpartition(".")[2].encode(), "S2") for x in (a, b))
    used = (left != b"--") | (right != b"--")
    if not used.any():
        return 0.0
    agreed = (left == right)[used].mean()
    j = max(0.0, (agreed - 1 / 256) / (1 - 1 / 256))
    return min(2 * j / (1 + j), 0.999)


def followed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, guard, id, t) such that, sorted within their bucket, each row but guards stands before the
    next document by descending id; a guard is a copy of what the next bucket begins with."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_KEY))
    n = docs.count()
    buckets = max(1, min(-(-n // BUCKET_DOCS), MOST_BUCKETS))
    parts = docs.select(key.alias("k")).repartitionByRange(buckets, F.col("k").desc())
    found = parts.groupBy(F.spark_partition_id().alias("part")).agg(F.max("k").alias("k")).collect()
    heads = np.array(sorted(r["k"] for r in found), np.int64)

    @F.pandas_udf("array<int>")
    def places(keys):
        at = np.searchsorted(heads, keys.to_numpy())
        before = np.where(at + 1 < len(heads), at + 1, 0)
        head = heads[at] == keys.to_numpy()
        return keys.__class__([[a, b] if h else [a] for a, b, h in zip(at.tolist(), before.tolist(), head.tolist(), strict=True)])

    rows = docs.select(key.alias("k"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.select("k", "id", "t", F.posexplode(places("k")).alias("guard", "bucket"))


def next_documents(docs: DataFrame, run, schema: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`run` over batches of rows sorted so that a row's next document follows it; text is shuffled once."""
    order: list[Column] = [F.col("bucket"), F.col("guard"), F.col("k").desc(), F.col("t")]
    return followed(docs, id_col, text_col).repartition("bucket").sortWithinPartitions(*order).mapInArrow(run, schema)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting = None
    for whole in batches:
        for batch in slices(whole, "t"):
            out: list[tuple] = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "guard", "id", "t")]
            for bucket, guard, doc, text in zip(*columns, strict=True):
                if guard and (waiting is None or waiting[0] != bucket):
                    continue
                codes = code_points(text)
                own = PrefixHash(codes)
                print_ = own.fingerprint()
                if waiting is not None and waiting[0] == bucket:
                    out.append(_compared(*waiting[1:], codes, print_))
                waiting = None if guard else (bucket, doc, codes, own, print_)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 9, _TYPES, strict=True)],
                _NAMES,
            )


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_prefix", "edited_suffix"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double, edited_prefix long, edited_suffix long"
)


def _compared(doc, codes: np.ndarray, own: PrefixHash, print_: str, following: np.ndarray, following_print: str) -> tuple:
    n = len(codes)
    kept, added = n - n // 3, following[: n // 3]
    edited = PrefixHash(added, own, kept)
    edited_print = edited.fingerprint()
    content = np.concatenate([codes[:kept], added]).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return (
        doc,
        n,
        hashlib.sha256(content).hexdigest(),
        print_,
        edited_print,
        likeness(print_, edited_print),
        likeness(print_, following_print),
        own.extension(0, edited, 0),
        own.common_suffix(edited),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns more than asked: how many code points text and edited text share at either end."""
    modest_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return next_documents(docs, _fingerprints, _SCHEMA)
