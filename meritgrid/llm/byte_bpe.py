"""Byte-level BPE encoding in linear time, and decoding.

Merging by rank always gives a sequence in which every two neighbours are compatible: their joint bytes,
merged on their own, give just these two tokens; and no other sequence of the same bytes is such that all
neighbours are. So a piece is encoded from left to right: take the longest token that starts here (an
Aho-Corasick automaton over the vocabulary, its bytes mapped to Latin-1 characters, finds all that do), go
on to shorter ones while it is incompatible with its predecessor, and step back over the predecessor if none
is left, never to come through the same place again. Compatibility of neighbours is memoised, and so are the
ids of pieces that occur again.

Tokens are ids by the rank file; a piece that is a token is that token, as in the library whose ids these
are. Pieces are the matches of the given pattern; there are no special tokens.

Defined results: null and empty texts have no ids and decode to no bytes; ids that are not in the vocabulary
raise a KeyError; extra columns pass through; rows are encoded one by one, so repeated rows are harmless; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from meritgrid.llm.arrowtext import slices
from meritgrid.llm.frames import free_name, modest_batches

MOST_MEMOS = 400_000
#: A longer piece is not memoised.
LONGEST_MEMO = 64
#: Ids of a text that are held at once where only their hash is asked for.
IDS_AT_ONCE = 1 << 16
#: A rank file is broadcast, so it has a bound.
MOST_RANK_BYTES = 64 << 20


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in content.splitlines() if line)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Plain merging, lowest rank first, leftmost among equals: the definition, for short pieces."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    never = len(ranks) + 1
    joint = [ranks.get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
    while joint and (best := min(joint)) < never:
        i = joint.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del joint[i]
        if i:
            joint[i - 1] = ranks.get(parts[i - 1] + parts[i], never)
        if i < len(joint):
            joint[i] = ranks.get(parts[i] + parts[i + 1], never)
    return parts


class ByteBpe:
    """Encoder and decoder for one vocabulary and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole = {t.decode(): (r,) for t, r in ranks.items() if t.isascii()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for token, rank in ranks.items():
            if len(token) == 1 or merge_by_rank(token, ranks) == [token]:
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MOST_MEMOS:
                self.pairs.clear()
            a, b = self.bytes_of[left], self.bytes_of[right]
            known = self.pairs[left, right] = merge_by_rank(a + b, self.ranks) == [a, b]
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        if piece in self.ranks:
            return (self.ranks[piece],)
        starting: list[list[tuple[int, int]]] = [[] for _ in piece]
        for end, (rank, size) in self.automaton.iter(piece.decode("latin-1")):
            starting[end - size + 1].append((rank, size))
        n, at = len(piece), 0
        closed = bytearray(n + 1)
        ids: list[int] = []
        steps: list[int] = []
        choice = [len(s) - 1 for s in starting]
        compatible = self.compatible
        while at < n:
            options, k = starting[at], choice[at]
            while k >= 0:
                rank, size = options[k]
                if not closed[at + size] and (not ids or compatible(ids[-1], rank)):
                    break
                k -= 1
            if k >= 0:
                choice[at] = k
                ids.append(rank)
                steps.append(size)
                at += size
                if at < n:
                    choice[at] = len(starting[at]) - 1
            else:
                closed[at] = 1
                at -= steps.pop()
                ids.pop()
                choice[at] -= 1
        return tuple(ids)

    def _learn(self, piece: str) -> tuple[int, ...]:
        ids = self.encode_piece(piece.encode())
        if len(piece) <= LONGEST_MEMO:
            if len(self.memo) >= MOST_MEMOS:
                self.memo.clear()
            self.memo[piece] = ids
        return ids

    def parts(self, text: str) -> Iterator[list[int]]:
        """The ids of a text of any length, some at a time."""
        if len(text) <= IDS_AT_ONCE:
            if text:
                yield self.encode(text)
            return
        known, whole, learn = self.memo.get, self.whole.get, self._learn
        ids: list[int] = []
        for match in self.pattern.finditer(text):
            piece = match[0]
            ids += known(piece) or whole(piece) or learn(piece)
            if len(ids) >= IDS_AT_ONCE:
                yield ids
                ids = []
        if ids:
            yield ids

    def encode(self, text: str) -> list[int]:
        known, whole, learn = self.memo.get, self.whole.get, self._learn
        return list(chain.from_iterable([known(p) or whole(p) or learn(p) for p in self.pattern.findall(text)]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_coders: dict[tuple[str, str], ByteBpe] = {}


class Ranks:
    """A rank file on its way to the tasks: its content, broadcast, known by its hash."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            content = f.read(MOST_RANK_BYTES + 1)
        if len(content) > MOST_RANK_BYTES:
            raise ValueError(f"the rank file has more than {MOST_RANK_BYTES} bytes")
        self.digest = hashlib.sha256(content).hexdigest()
        self.content: Broadcast = spark.sparkContext.broadcast(content)

    def coder(self, pattern: str) -> ByteBpe:
        """One per vocabulary, pattern and worker process."""
        if (self.digest, pattern) not in _coders:
            _coders[self.digest, pattern] = ByteBpe(read_ranks(self.content.value), pattern)
        return _coders[self.digest, pattern]


def _with_columns(df: DataFrame, made, fields: list[tuple[str, T.DataType]], column: str) -> DataFrame:
    """`df` and the made columns, under free names."""
    at = df.columns.index(column)
    added = [T.StructField(free_name(df, n), t) for n, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, column)):
            columns = made(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *(f.name for f in added)])

    return df.mapInArrow(run, T.StructType([*df.schema, *added]))


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """`docs` with the token ids of its texts; a name that is taken gets a number."""
    ranks = Ranks(docs.sparkSession, ranks_path)

    def made(texts: list[str | None]) -> list[pa.Array]:
        own = ranks.coder(pattern)
        return [pa.array([own.encode(t or "") for t in texts], pa.list_(pa.int32()))]

    return _with_columns(docs, made, [(ids_col, T.ArrayType(T.IntegerType()))], text_col)


def decode(rows: DataFrame, ranks_path: str, pattern: str, *, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """`rows` with the bytes of its token ids; a name that is taken gets a number."""
    ranks = Ranks(rows.sparkSession, ranks_path)

    def made(ids: list[list[int] | None]) -> list[pa.Array]:
        own = ranks.coder(pattern)
        return [pa.array([own.decode(i or []) for i in ids], pa.binary())]

    return _with_columns(rows, made, [(bytes_col, T.BinaryType())], ids_col)


def _digests(own: ByteBpe, text: str) -> tuple[int, str, str]:
    n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
    for ids in own.parts(text):
        of_ids.update(("," if n else "").encode() + ",".join(map(str, ids)).encode())
        of_bytes.update(own.decode(ids))
        n += len(ids)
    return n, of_ids.hexdigest(), of_bytes.hexdigest()


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, text_col: str = "text") -> DataFrame:
    """`docs` without its text, with n_tokens and the SHA-256 of the ids and of the bytes decoded from them; ids
    do not leave the task. A name that is taken gets a number."""
    ranks = Ranks(docs.sparkSession, ranks_path)

    def made(texts: list[str | None]) -> list[pa.Array]:
        own = ranks.coder(pattern)
        found = [_digests(own, t or "") for t in texts]
        return [pa.array([f[0] for f in found], pa.int64()), *(pa.array([f[k] for f in found], pa.string()) for k in (1, 2))]

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return _with_columns(docs, made, fields, text_col).drop(text_col)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
