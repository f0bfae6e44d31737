"""Views on Arrow text columns for the operators that work in numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text handled at once inside a task; a single longer text is handled alone.
SLICE_BYTES = 1 << 20

#: Bytes of text whose words are found at once; a longer word is looked at whole.
BLOCK_BYTES = 1 << 20

#: Bytes that end a word: space, and tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `limit` bytes of text (or elements of a list) each."""
    if batch.num_rows == 0:
        return
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column), 0)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads 64-bit values evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        ones = np.ones(size, np.uint64)
        p, q = ones.copy(), ones.copy()
        p[1:], q[1:] = np.uint64(_BASE), np.uint64(_INVERSE)
        _powers, _inverses = np.multiply.accumulate(p), np.multiply.accumulate(q)


def blocks(raw: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Spans of about `limit` bytes, one after the other, that end behind a space (or, if a word is longer, further on)."""
    start = 0
    while start < len(raw):
        stop = min(start + limit, len(raw))
        if stop < len(raw):
            spaces = np.flatnonzero(SPACE[raw[start:stop]])
            while not len(spaces) and stop < len(raw):
                start_at, stop = stop, min(stop + limit, len(raw))
                spaces = np.flatnonzero(SPACE[raw[start_at:stop]]) + (start_at - start)
            stop = start + int(spaces[-1]) + 1 if len(spaces) else len(raw)
        yield start, stop
        start = stop


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of many texts, in order, and each text's first word as n + 1 offsets.

    A word is a run of bytes other than space, tab to carriage return, inside one text. Longer texts are read block
    by block, so what a text takes is its bytes and eight a word.
    """
    if len(raw) <= BLOCK_BYTES:
        return _words(raw, offsets, lower)
    hashes, first, before = [], np.zeros(len(offsets), np.int64), 0
    for start, stop in blocks(raw):
        own, at = _words(raw[start:stop], np.clip(offsets, start, stop) - start, lower)
        hashes.append(own)
        here = (offsets > start) & (offsets <= stop)
        first[here] = before + at[here]
        before += len(own)
    return np.concatenate(hashes), first


def _words(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(raw)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    stop = np.zeros(len(raw) + 1, dtype=bool)
    stop[1:] = inside
    stop[1:-1] &= ~inside[1:]
    stop[edges[edges > 0]] |= inside[edges[edges > 0] - 1]
    ends = np.flatnonzero(stop)
    data = LOWER[raw] if lower else raw
    _grow(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(raw)], out=total[1:])
    spans = (total[ends] - total[starts]) * _inverses[starts]
    return mix64(spans + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(starts, offsets)
