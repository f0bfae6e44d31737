"""Token ids of documents in seekable files.

Documents are encoded where they are, dealt by ranges of their ids, and written in ascending order: by id, then by a
hash of the text. A file holds

- data frames: independent zstandard frames of about `FRAME_IDS` ids, little-endian unsigned 32-bit integers; a frame
  holds whole documents, only a longer one takes frames of its own;
- one index frame: for each document its id (64 bits), whether it has one (a byte) and its number of ids (64 bits),
  column by column;
- a trailing seek table as the public seekable format of zstandard has it: a skippable frame with each frame's
  compressed size, size and checksum (the low 32 bits of XXH64 of its content), the number of frames and a magic number.

A reader takes the end of a file, its table, its index, and those frames that hold requested documents; each frame that
is read is checked. Files carry no position, `_manifest` (Parquet) lists them with their numbers of documents and ids,
the ids before them and their least and greatest document.

Words are encoded by the library once a worker and looked up from then on, where the vocabulary's pieces hold no white space
(`by_word`): then the ids of a text are those of its words, one after the other. Very long texts go through in blocks.

Ranges are quantiles of the ids. An id that many rows have, or the lack of one, takes several ranges and its rows are
dealt to these by the hash of their text, so no task gets it whole unless its texts are equal, too. A task writes what
it gets as a stream, a frame at a time, to a hidden file that is renamed when it is whole, so a task that is repeated
or run twice leaves the same files.

Defined results: null and empty texts have no ids but the end id; a null id is written as such and comes first;
repeated rows are written as often as they occur; special tokens' strings in a text are ordinary text; other columns
are not read; an empty table gives a manifest without files.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import uuid
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meritgrid.functions.positions import running_sums
from meritgrid.llm.arrowtext import blocks, slices, text_bytes
from meritgrid.llm.components import shared_folder
from meritgrid.llm.frames import modest_batches

FRAME_IDS = 1 << 16
#: A file gets no further frame once it has so many bytes.
FILE_BYTES = 64 << 20
#: Bytes of text in a range of ids; the least number of ranges, where there are rows for them.
RANGE_BYTES, LEAST_RANGES, RANGE_ROWS = 64 << 20, 64, 16
#: The tokenizer's file is broadcast, so it has a bound.
MOST_TOKENIZER_BYTES = 64 << 20
#: Words of one generation of a memo, of which there are two, and its pieces that are not of letters only.
MOST_MEMOS, MOST_MARKS = 500_000, 10_000
#: A longer word is cut where no piece can go on, and is not memoised.
LONG_WORD = 1 << 12
#: Below this byte in UTF-8 there are no characters that combine with others, so A-Z may be lowered first.
_COMBINING = 0xCC
#: Printing ASCII and the letters from U+00C0 to U+02FF.
_PLAIN = re.compile(rb"[\x21-\x7e\xc3-\xcb\x80-\xbf]+")
#: Fixed values of the seekable format.
_SKIPPABLE, _SEEKABLE, _HAS_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4
_ENTRY = np.dtype([("compressed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
_MANIFEST = "file string, range long, part long, n_docs long, n_ids long, bytes long, least long, most long"


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if _NATIVE else np.array(ids, "<u4").tobytes()


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class WordEncoder(dict):
    """Ids of texts by a tokenizer's file, without special tokens; a memo from words to the bytes of their ids.

    A word that is not known goes through the library whole. Where the file has the usual steps (compose, fold white
    space, lower, split by a pattern, bytes as characters), words of printing ASCII and letters below U+0300, which
    composing leaves as they are, are lowered and split here, and the library's model gets the pieces. A full memo is kept
    as the older of two, from which words that come again are taken, so frequent words are not worked out anew."""

    def __init__(self, content: bytes, by_word: bool):
        super().__init__()
        self.tokenizer = Tokenizer.from_buffer(content)
        self.tokenizer.encode_special_tokens = True
        self.by_word = by_word
        if by_word and self._whole("a b\t\nc.") != self._whole("a") + self._whole("b") + self._whole("c."):
            raise ValueError("the tokenizer's pieces hold white space, so texts cannot be encoded by words")
        self.lowers = self._whole("AbC É") == self._whole("abc É")
        self.pieces = self._pattern(json.loads(content))
        self.model = self.tokenizer.model
        self.table = dict(enumerate(_byte_characters()))
        self.older: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {}

    @staticmethod
    def _pattern(steps: dict) -> regex.Pattern | None:
        """What finds a lowered word's pieces, if the file has the steps that are done here."""
        normal = (steps.get("normalizer") or {}).get("normalizers", [])
        before = (steps.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = {"type": "Split", "behavior": "Removed", "invert": True}
        level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        if [n["type"] for n in normal] != ["NFC", "Replace", "Lowercase"] or normal[1]["pattern"] != {"Regex": r"\s+"} or len(before) != 2:
            return None
        if not split.items() <= before[0].items() or not level.items() <= before[1].items() or steps["model"]["type"] != "BPE":
            return None
        return regex.compile(before[0]["pattern"]["Regex"]) if "Regex" in before[0]["pattern"] else None

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32).tobytes()

    def _long(self, word: bytes) -> bytes:
        """A word without white space in parts that end with a letter before punctuation or a symbol."""
        text = word.decode()
        cuts, last = [0], 0
        for m in regex.finditer(r"(?<=\p{L})(?=[\p{P}\p{S}])", text):
            if m.start() - last >= LONG_WORD:
                last = m.start()
                cuts.append(last)
        return b"".join(self._whole(text[a:b]) for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True))

    def _model_ids(self, piece: str) -> bytes:
        return _packed([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.table))])

    def _piece(self, piece: str) -> bytes:
        """A lowered piece's ids; one of letters only is a word of its own."""
        if piece.isalpha():
            return self[piece.encode()]
        ids = self.marks.get(piece)
        if ids is None:
            if len(self.marks) >= MOST_MARKS:
                self.marks.clear()
            ids = self.marks[piece] = self._model_ids(piece)
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > LONG_WORD:
            return self._long(word)
        if (ids := self.older.get(word)) is not None:
            self[word] = ids
            return ids
        if self.pieces is None or not _PLAIN.fullmatch(word):
            ids = self._whole(word.decode())
        else:
            text = word.decode().lower()
            ids = self._model_ids(text) if text.isalpha() else b"".join(map(self._piece, self.pieces.findall(text)))
        self[word] = ids
        return ids

    def encode(self, raw: np.ndarray) -> bytes:
        """The ids of one text of UTF-8, as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return self._whole(raw.tobytes().decode())
        parts, find = [], self.__getitem__
        for start, stop in blocks(raw):
            piece = raw[start:stop]
            text = piece.tobytes()
            if self.lowers and len(piece) and piece.max() < _COMBINING:
                text = text.lower()
            parts.append(b"".join(map(find, text.split())))
            if len(self) >= MOST_MEMOS:
                self.older = dict(self)
                self.clear()
        return b"".join(parts)


_encoders: dict[tuple[str, bool], WordEncoder] = {}


class TokenizerFile:
    """A tokenizer's file on its way to the tasks: its content, broadcast, known by its hash."""

    def __init__(self, spark: SparkSession, path: str, by_word: bool):
        with open(path, "rb") as f:
            content = f.read(MOST_TOKENIZER_BYTES + 1)
        if len(content) > MOST_TOKENIZER_BYTES:
            raise ValueError(f"the tokenizer's file has more than {MOST_TOKENIZER_BYTES} bytes")
        self.digest, self.by_word = hashlib.sha256(content).hexdigest(), by_word
        self.content = spark.sparkContext.broadcast(content)

    def encoder(self) -> WordEncoder:
        """One per file and worker process."""
        key = self.digest, self.by_word
        if key not in _encoders:
            _encoders[key] = WordEncoder(self.content.value, self.by_word)
        return _encoders[key]


# The format


def seek_table(entries: np.ndarray) -> bytes:
    body = entries.tobytes() + struct.pack("<IBI", len(entries), _HAS_CHECKSUMS, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def checksum(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class FileWriter:
    """One file of documents in order, a frame at a time."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.coder = stream, zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.waiting: list[bytes] = []
        self.held = self.written = 0

    def _frame(self, content: bytes) -> None:
        made = self.coder.compress(content)
        self.stream.write(made)
        self.entries.append((len(made), len(content), checksum(content)))
        self.written += len(made)

    def flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.waiting))
            self.waiting, self.held = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        most = 4 * FRAME_IDS
        if self.held and self.held + len(ids) > most:
            self.flush()
        if len(ids) > most:
            for start in range(0, len(ids), most):
                self._frame(ids[start : start + most])
        else:
            self.waiting.append(ids)
            self.held += len(ids)

    def close(self) -> None:
        self.flush()
        known = np.array([i is not None for i in self.ids], np.uint8)
        numbers = np.array([i or 0 for i in self.ids], "<i8")
        self._frame(numbers.tobytes() + known.tobytes() + np.array(self.counts, "<u8").tobytes())
        self.stream.write(seek_table(np.array(self.entries, _ENTRY)))
        self.stream.close()


@dataclass
class FileReader:
    """Random access to the documents of one file; `stream` can seek."""

    stream: object
    ids: list[int | None] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.stream.seek(0, 2)
        size = self.stream.tell()
        self.stream.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", self.stream.read(9))
        if magic != _SEEKABLE or flags != _HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        self.stream.seek(size - 9 - n * _ENTRY.itemsize)
        self.entries = np.frombuffer(self.stream.read(n * _ENTRY.itemsize), _ENTRY)
        self.places = np.concatenate([[0], np.cumsum(self.entries["compressed"], dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(self.entries["size"][:-1], dtype=np.int64)])
        index = self.frame(n - 1)
        docs = len(index) // 17
        known = np.frombuffer(index, np.uint8, docs, 8 * docs).astype(bool).tolist()
        self.ids = [i if k else None for i, k in zip(np.frombuffer(index, "<i8", docs).tolist(), known, strict=True)]
        self.counts = np.frombuffer(index, "<u8", docs, 9 * docs).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.counts)])
        self._last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        self.stream.seek(int(self.places[k]))
        entry = self.entries[k]
        content = zstandard.ZstdDecompressor().decompress(self.stream.read(int(entry["compressed"])), max_output_size=int(entry["size"]))
        if checksum(content) != int(entry["checksum"]):
            raise ValueError(f"frame {k} does not have the checksum of the seek table")
        return content

    def document(self, i: int) -> bytes:
        """The ids of the i-th document; reads the frames that hold it and no others."""
        low, high = 4 * int(self.before[i]), 4 * int(self.before[i + 1])
        out, k = [], int(np.searchsorted(self.starts, low, side="right")) - 1
        while low < high:
            if self._last[0] != k:
                self._last = k, self.frame(k)
            here = self._last[1][low - int(self.starts[k]) : high - int(self.starts[k])]
            out.append(here)
            low += len(here)
            k += 1
        return b"".join(out)


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


# The jobs


def _encoded(tokenizer: TokenizerFile, end_id: int | None, bounds: np.ndarray, null_ranges: int):
    end = b"" if end_id is None else np.array([end_id], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer.encoder().encode
        for batch in (part for b in batches for part in slices(b, "t")):
            raw, offsets = text_bytes(batch.column(1))
            texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            h = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
            unit = (h >> np.uint64(11)).astype(np.float64) * 2.0**-53
            null = np.asarray(batch.column(0).is_null())
            ids = np.asarray(batch.column(0).fill_null(0), np.int64)
            low, high = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
            range_ = np.where(null, (unit * null_ranges).astype(np.int64) - null_ranges, low + (unit * (high - low + 1)).astype(np.int64))
            order = (h ^ np.uint64(1 << 63)).view(np.int64)
            made = pa.array([encode(t) + end for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(range_), batch.column(0), pa.array(order), made], ["range", "id", "h", "ids"])

    return run


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)
        now: tuple[int, int] | None = None
        own: FileWriter | None = None
        hidden = ""
        rows: list[tuple] = []

        def done() -> None:
            nonlocal own
            if own is None or now is None:
                return
            own.close()
            name = f"ids-{now[0] + (1 << 40):014d}-{now[1]:06d}.zst"
            try:
                fs.move(hidden, f"{root}/{name}")
            except OSError:  # where a rename does not replace, another attempt has left the same file
                if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.File:
                    raise
                fs.delete_file(hidden)
            ids = [i for i in own.ids if i is not None]
            rows.append((name, *now, len(own.ids), sum(own.counts), own.written, min(ids, default=None), max(ids, default=None)))
            own = None

        for batch in batches:
            for range_, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if own is not None and (now[0] != range_ or own.written >= FILE_BYTES):
                    part = now[1] + 1 if now[0] == range_ else 0
                    done()
                    now = range_, part
                if own is None:
                    now = now if now is not None and now[0] == range_ else (range_, 0)
                    hidden = f"{root}/.{uuid.uuid4().hex}"
                    own = FileWriter(fs.open_output_stream(hidden))
                own.add(doc_id, ids.as_buffer().to_pybytes())
        done()
        names = [f.split()[0] for f in _MANIFEST.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 7]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    *,
    end_id: int | None = None,
    by_word: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Writes the ids of all texts into new files of `folder`, each document's followed by `end_id`; the manifest:
    file, n_docs, n_ids, bytes, least, most, and start, the ids in all files before."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    n, known, size = rows.agg(F.count(F.lit(1)), F.count("id"), F.sum(F.octet_length("t"))).first()
    ranges = max(1, min(max(LEAST_RANGES, (size or 0) // RANGE_BYTES), n // RANGE_ROWS))
    null_ranges = max(1, -(-ranges * (n - known) // max(n, 1)))
    steps = [k / ranges for k in range(1, ranges)]
    bounds = rows.agg(F.percentile_approx("id", steps, 20 * ranges)).first()[0] if steps and known else []
    fs, root = _place(folder)
    fs.create_dir(root, recursive=True)
    encoded = rows.mapInArrow(
        _encoded(TokenizerFile(spark, tokenizer_path, by_word), end_id, np.array(bounds, np.int64), null_ranges), "range long, id long, h long, ids binary"
    )
    dealt = encoded.repartition("range").sortWithinPartitions("range", "id", "h").select("range", "id", "ids")
    dealt.mapInArrow(_written(folder), _MANIFEST).write.mode("overwrite").parquet(f"{folder}/_written")
    files = running_sums(spark.read.parquet(f"{folder}/_written"), ["range", "part"], {"start": F.col("n_ids")})
    files.drop("range", "part").write.mode("overwrite").parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def read_ids(spark: SparkSession, folder: str, wanted: Sequence[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files: of all documents, or of those with the ids `wanted`, for which
    other files and frames are not read. `start` counts the ids of all documents before; `ids` are the bytes of
    little-endian unsigned 32-bit integers."""
    files = spark.read.parquet(f"{folder}/_manifest")
    asked = None if wanted is None else frozenset(wanted)
    if asked is not None:
        files = files.where(F.exists(F.array(*(F.lit(i).cast("long") for i in asked)), lambda i: i.between(F.col("least"), F.col("most"))) if asked else F.lit(False))
    n, size = files.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks = max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, (size or 0) // FILE_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"])

        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as stream:
                    own = FileReader(stream)
                    rows, held = [], 0
                    for i, doc_id in enumerate(own.ids):
                        if asked is not None and doc_id not in asked:
                            continue
                        ids = own.document(i)
                        rows.append((doc_id, start + int(own.before[i]), len(ids) // 4, ids))
                        held += len(ids)
                        if held >= 4 * FRAME_IDS:
                            yield made(rows)
                            rows, held = [], 0
                    yield made(rows)

    return files.select("file", "start").repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files stay in the shared folder, in one of their own for each run."""
    modest_batches(spark)
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_ids(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2, by_word=True)
    return read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))
