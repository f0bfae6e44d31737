"""Runs of periodically repeated words, and texts without their repetitions.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(`min_length`, 2 q) that no neighbouring word extends keeping period q.

Masking comes first. Words q apart agree over length - q >= max(min_length - q, q) positions of a run, which is never
less than k = min_length // 2 (at q = k), so each word of a run lies in a k-gram that occurs again q words earlier or
later, inside the same run. Words outside repeated k-grams of their document can join no run, and a run lies whole in
a segment, a stretch of words that are left. Words are masked by counters first (one that is shared by chance only
leaves a word in), then by the k-grams themselves, which have to recur in the document, and at last inside their
segment, until no segment gets smaller.

Segments are searched by Main and Lorentz: cut in the middle, find the repetitions that cross the cut, go on with the
halves. For a cut and a period the words that agree q apart, forwards and backwards from the cut, tell the repetition.
All segments of a batch go down together, a level of halving at once: words and k-grams are compared first, the few
that agree are measured by binary search over prefix polynomial hashes modulo two primes (equal hashes of different
words have odds of 2^-62 a comparison). A run is found whole at the smallest part that holds it, so what can be
extended is dropped, and of equal stretches the smallest period stays.

Everything happens where a text is, map only: memory is about a hundred bytes a surviving word, and besides some forty a
word of the batch or of the one long text that makes it.

Defined results: null and empty texts have no runs and collapse to the empty text; a word is a run of bytes other than
space, tab to carriage return, and words are compared as they are written; ids may be null or repeat, rows are judged
one by one; extra columns pass through, and a made column whose name is taken gets a number; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meritgrid.llm.arrowtext import blocks, mix64, slices, text_bytes, words
from meritgrid.llm.frames import free_name, modest_batches

MIN_LENGTH = 12
#: Candidates (a cut and a period) that are looked at together.
AT_ONCE = 1 << 19
#: Counters a word of a batch, up to two to the power of MOST_BITS in all.
COUNTERS_A_WORD, MOST_BITS = 16, 25
_PRIMES = (np.uint64(2_147_483_647), np.uint64(2_147_483_629))
_BASES = (1_283_604_871, 1_978_261_483)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

#: (id, number of words) to the numbers of the words that are read in their place, or None for all in order.
Reading = Callable[[object, int], np.ndarray | None]


def kgrams(words_: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of the k words from each place on that has so many behind it, or from the places `at`."""
    n = max(len(words_) - k + 1, 0) if at is None else len(at)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix64(out * _FACTOR + (words_[i : i + n] if at is None else words_[at + i]) + np.uint64(i + 1))
    return out


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur more than once."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    again = sorted_[1:] == sorted_[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= again
    out[order[:-1]] |= again
    return out


def _repeated(words_: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of the k-grams that occur again in their document. Counters, a chunk of words at a time, leave few for
    which keys are sorted."""
    n = len(words_) - k + 1
    bits = min(max(12, (COUNTERS_A_WORD * n).bit_length()), MOST_BITS)
    shift = np.uint64(64 - bits)

    def chunks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for start in range(0, n, AT_ONCE):
            stop = min(start + AT_ONCE, n)
            own = doc[start:stop]
            places = start + np.flatnonzero(own == doc[start + k - 1 : stop + k - 1])
            grams = kgrams(words_[start : stop + k - 1], k)[places - start]
            yield places, (mix64(grams + own[places - start].astype(np.uint64) * _FACTOR) >> shift).astype(np.int64)

    if n <= AT_ONCE:
        places, counters = next(chunks(), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        at = places[np.bincount(counters, minlength=1 << bits)[counters] > 1]
    else:
        seen, twice = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        for _, counters in chunks():
            own, times = np.unique(counters, return_counts=True)
            twice[own[seen[own] | (times > 1)]] = True
            seen[own] = True
        at = np.concatenate([places[twice[counters]] for places, counters in chunks()])
    return at[_twice(mix64(kgrams(words_, k, at) + doc[at].astype(np.uint64) * _FACTOR))]


def _spread(at: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of n words lie in the k-grams that begin at `at`."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + k, -1)
    return np.cumsum(edges[:-1], dtype=np.int32) > 0


def _stretches(inside: np.ndarray, of: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of true values within one part (`of` numbers the parts) of `least` words or more."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = of[1:] == of[:-1]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~(inside[:-1] & same)
    end[:-1] &= ~(inside[1:] & same)
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def segments(words_: np.ndarray, first: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that can hold runs; `first` has each text's first word."""
    k = min_length // 2
    n = len(words_)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < min_length:
        return none
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    starts, ends = _stretches(_spread(_repeated(words_, doc, k), n, k), doc, min_length)
    while len(starts):
        sizes = ends - starts
        part = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        own = place + k <= np.repeat(ends, sizes)
        twice = _twice(mix64(kgrams(words_, k, place[own]) + part[own].astype(np.uint64) * _FACTOR))
        left = _spread(np.flatnonzero(own)[twice], len(part), k)
        low, high = _stretches(left, part, min_length)
        before, (starts, ends) = (starts, ends), (place[low] if len(low) else low, place[high - 1] + 1 if len(high) else high)
        if len(starts) == len(before[0]) and (starts == before[0]).all() and (ends == before[1]).all():
            break
    return starts, ends


class _Hashes:
    """Prefix polynomial hashes of a sequence of words, modulo two primes."""

    def __init__(self, values: np.ndarray):
        self.prefix, self.powers = [], []
        for prime, base in zip(_PRIMES, _BASES, strict=True):
            powers = np.ones(len(values) + 1, np.uint64)
            have = 1
            while have < len(powers):  # doubles what there is
                more = min(have, len(powers) - have)
                powers[have : have + more] = powers[:more] * np.uint64(pow(base, have, int(prime))) % prime
                have += more
            prefix = np.zeros(len(values) + 1, np.uint64)
            np.cumsum((values % prime) * powers[:-1] % prime, out=prefix[1:])
            self.prefix.append(prefix % prime)
            self.powers.append(powers)

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i on are those from j on; j is behind i."""
        same = np.ones(len(i), bool)
        for prime, prefix, powers in zip(_PRIMES, self.prefix, self.powers, strict=True):
            a = (prefix[i + n] + prime - prefix[i]) % prime * powers[j - i] % prime
            same &= a == (prefix[j + n] + prime - prefix[j]) % prime
        return same

    def ahead(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from i and j on agree, at most `most`."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            same = self.equal(i[open_], j[open_], middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1
        return low

    def behind(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before i and j agree, at most `most`."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            same = self.equal(i[open_] - middle, j[open_] - middle, middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1
        return low


def _crossing(values: np.ndarray, hashes: _Hashes, low: np.ndarray, high: np.ndarray, min_length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, end, period) of the repetitions that cross the middle of each part [low, high)."""
    sizes = high - low
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    for start in range(0, total, AT_ONCE):
        flat = np.arange(start, min(start + AT_ONCE, total))
        part = np.searchsorted(ends, flat, side="right")
        l, r = low[part], high[part]
        m = (l + r) // 2
        at = flat - (ends[part] - sizes[part])
        right = at >= m - l
        # In the left half the first of both places lies q before the middle, in the right half at it.
        q = np.where(right, at - (m - l) + 1, at + 1)
        i = np.where(right, m, m - q)
        j = i + q
        ahead, behind = r - j, i - l
        need = np.maximum(q, min_length - q)
        half = (need + 1) // 2
        # Of the agreeing words at least half lie on one side.
        fits_on, fits_back = ahead >= half, behind >= half
        on = fits_on.copy()
        on[fits_on] = values[i[fits_on]] == values[j[fits_on]]
        back = fits_back.copy()
        back[fits_back] = values[i[fits_back] - 1] == values[j[fits_back] - 1]
        for flag, sign in ((on, 0), (back, 1)):
            some = np.flatnonzero(flag)
            flag[some] = hashes.equal(i[some] - sign * half[some], j[some] - sign * half[some], half[some])
        some = np.flatnonzero(on | back)
        i, j, q, need = i[some], j[some], q[some], need[some]
        forwards = hashes.ahead(i, j, ahead[some])
        backwards = hashes.behind(i, j, behind[some])
        found = forwards + backwards >= need
        yield (i - backwards)[found], (j + forwards)[found], q[found]


def runs(words_: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of many texts, by start and period; places count through all texts."""
    starts, ends = segments(words_, first, min_length)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none
    sizes = ends - starts
    shift = np.cumsum(sizes) - sizes
    values = words_[np.arange(int(sizes.sum())) + np.repeat(starts - shift, sizes)]
    of = np.repeat(np.arange(len(starts)), sizes)
    hashes = _Hashes(values)
    found: list[tuple[np.ndarray, ...]] = [(none, none, none)]
    low, high = shift, shift + sizes
    while len(low):
        for s, e, q in _crossing(values, hashes, low, high, min_length):
            before, after = np.maximum(s - 1, 0), np.minimum(e, len(values) - 1)
            longer = (s > shift[of[s]]) & (values[before] == values[before + q])
            longer |= (e < (shift + sizes)[of[s]]) & (values[after] == values[after - q])
            found.append((s[~longer], e[~longer], q[~longer]))
        middle = (low + high) // 2
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        long = high - low >= min_length
        low, high = low[long], high[long]
    s, e, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, q = s[new], e[new], q[new]
    move = (starts - shift)[of[s]] if len(s) else none
    s, e = s + move, e + move
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def _kept_text(raw: np.ndarray, stay: np.ndarray) -> bytes:
    """A text's kept words, joined by one space, block by block."""
    parts, at = [], 0
    for start, stop in blocks(raw):
        own = raw[start:stop].tobytes().split()
        here = stay[at : at + len(own)]
        at += len(own)
        if not here.all():
            own = [own[i] for i in np.flatnonzero(here).tolist()]
        if own:
            parts.append(b" ".join(own))
    return b" ".join(parts)


def _texts(raw: np.ndarray, offsets: np.ndarray, read: list[np.ndarray | None], keep: np.ndarray, first: np.ndarray) -> Iterator[bytes]:
    """Each text's kept words, joined by one space."""
    for k, order in enumerate(read):
        own, stay = raw[offsets[k] : offsets[k + 1]], keep[first[k] : first[k + 1]]
        if order is None:
            yield _kept_text(own, stay)
        else:
            every = own.tobytes().split()
            yield b" ".join([every[i] for i in order[stay].tolist()])


def find_runs(
    docs: DataFrame,
    *,
    min_length: int = MIN_LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    runs_col: str = "runs",
    collapsed_col: str = "collapsed",
    reading: Reading | None = None,
) -> DataFrame:
    """`docs` with `runs`, an array of (start, length, period) by start and period, and `collapsed`, the text without
    the words that a run contains after its first period, joined by single spaces. With `reading` a text's words are
    read in the order that it gives."""
    if min_length < 4:
        raise ValueError("min_length must be 4 at least")
    runs_name, text_name = free_name(docs, runs_col), free_name(docs, collapsed_col)
    run_type = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, text_col)):
            raw, offsets = text_bytes(batch.column(at_text))
            hashes, first = words(raw, offsets, lower=False)
            read: list[np.ndarray | None] = [None] * batch.num_rows
            if reading is not None:
                ids = batch.column(at_id).to_pylist()
                read = [reading(i, n) for i, n in zip(ids, np.diff(first).tolist(), strict=True)]
                if any(r is not None for r in read):
                    orders = [np.arange(a, b) if r is None else a + r for r, a, b in zip(read, first[:-1], first[1:], strict=True)]
                    first = np.concatenate([[0], np.cumsum([len(o) for o in orders])])
                    hashes = hashes[np.concatenate([*orders, np.zeros(0, np.int64)])]
            s, e, q = runs(hashes, first, min_length)
            edges = np.zeros(len(hashes) + 1, np.int32)
            np.add.at(edges, s + q, 1)
            np.add.at(edges, e, -1)
            keep = np.cumsum(edges[:-1], dtype=np.int32) == 0
            of = np.searchsorted(first, s, side="right") - 1
            made = pa.StructArray.from_arrays([pa.array(x) for x in (s - first[of], e - s, q)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)), made)
            texts = pa.array(list(_texts(raw, offsets, read, keep, first)), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, texts], [*batch.schema.names, runs_name, text_name])

    fields = [T.StructField(runs_name, run_type), T.StructField(text_name, T.StringType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema, *fields]))


def planted(id_: object, n: int) -> np.ndarray | None:
    """One id in ten by its CRC: the words from a on repeat with a period that leaves three to ten rounds."""
    if id_ is None or n == 0:
        return None
    h = zlib.crc32(str(id_).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_runs(docs, reading=planted)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size(lines) > 0, F.concat(F.concat_ws("\n", lines), F.lit("\n"))).otherwise(F.lit(""))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.select("doc_id", "runs", "collapsed", first.alias("m")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("m.start").alias("start"),
        (-F.col("m.a")).alias("length"),
        F.col("m.period").alias("period"),
        F.floor(1000 * -F.col("m.a") / F.col("m.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
