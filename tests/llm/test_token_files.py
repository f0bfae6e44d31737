from __future__ import annotations

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

import meritgrid.llm.token_files as tf
from tests.llm.cases import empty, prose, table

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_words_one_by_one_give_the_ids_of_whole_texts(library):
    with open(WORDS, "rb") as f:
        own = tf.WordEncoder(f.read(), True)
    rng = random.Random(3)
    odd = ["J̌", "ǰ", "É", "É", "Σας ΟΔΟΣ", "İi", "it's 'tis I'LL", "12a3", "...!?'s", "<|endoftext|>", "\0 a\0b", " x y", "\x1c!\x1c", "日本語。テスト", "😀👍🏽", "ÅÅ", "don't,won't"]
    texts = ["", " \t\n", *odd, *(" ".join(rng.sample(odd, 5)) for _ in range(20)), *(prose(i, 50) for i in range(5)), "日本語。" * 3000, "ab,c" * 4000, "x" * 9000]
    for text in [*texts, *texts]:
        assert np.frombuffer(own.encode(np.frombuffer(text.encode(), np.uint8)), np.uint32).tolist() == library(text)


def test_tokenizers_whose_pieces_hold_spaces_are_refused_by_word():
    with open(BYTES, "rb") as f:
        content = f.read()
    with pytest.raises(ValueError):
        tf.WordEncoder(content, True)
    plain = tf.WordEncoder(content, False)
    ids = np.frombuffer(plain.encode(np.frombuffer(b"two  words", np.uint8)), np.uint32).tolist()
    assert ids == Tokenizer.from_file(BYTES).encode("two  words", add_special_tokens=False).ids


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        self.taken += n
        return super().read(n)


def test_a_file_gives_single_documents_by_few_frames(monkeypatch):
    monkeypatch.setattr(tf, "FRAME_IDS", 100)
    rng = np.random.default_rng(1)
    docs = [(i if i != 3 else None, rng.integers(0, 49_000, n, dtype=np.uint32)) for i, n in enumerate([5, 0, 99, 100, 101, 1000, 3, 7, 250, 1])]
    out = io.BytesIO()
    out.close = lambda: None
    writer = tf.FileWriter(out)
    for i, ids in docs:
        writer.add(i, ids.tobytes())
    writer.close()
    content = out.getvalue()
    reader = tf.FileReader(stream := Counting(content))
    assert reader.ids == [i for i, _ in docs]
    assert [reader.document(k) for k in range(len(docs))] == [ids.tobytes() for _, ids in docs]
    stream.taken = 0
    assert reader.document(9) == docs[9][1].tobytes() and stream.taken < len(content) / 4
    # every frame stands alone, and the library reads the whole as a stream, the skippable frame included
    joined = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(content)
    assert joined.startswith(b"".join(ids.tobytes() for _, ids in docs))
    broken = bytearray(content)
    broken[20] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        for k in range(len(docs)):
            tf.FileReader(io.BytesIO(bytes(broken))).document(k)


def test_files_give_back_all_documents_in_order(spark, tmp_path, library, monkeypatch):
    rows = [(i * 37 % 1001, prose(i, i % 60)) for i in range(400)] + [(5000, prose(9, 90_000)), (5001, None), (5002, "")]
    rows += [(None, prose(i, 9)) for i in range(200)] + [(7, prose(i, 4)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    files = tf.write_ids(docs, str(tmp_path / "a"), WORDS, end_id=2, by_word=True)
    assert files.count() > 10 and files.agg({"n_docs": "sum"}).first()[0] == len(rows)
    hot = [r["n_docs"] for r in files.where("least = 7 and most = 7").collect()]
    assert len(hot) > 3 and max(hot) < 100
    got = sorted(tf.read_ids(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    want = sorted((i is not None, i or 0, zlib.crc32(np.array([*library(t), 2], np.uint32).tobytes())) for i, t in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32(r["ids"])) for r in got) == want
    some = tf.read_ids(spark, str(tmp_path / "a"), [5000, 38, 4242]).collect()
    assert {r["doc_id"] for r in some} == {5000, *({38} & {r[0] for r in rows})}
    assert all(tuple(r) in {tuple(g) for g in got} for r in some)
    assert tf.read_ids(spark, str(tmp_path / "a"), []).count() == 0


def test_awkward_rows_and_an_empty_table(spark, tmp_path, library):
    rows = table(spark).select("doc_id", "text").collect()
    tf.write_ids(table(spark), str(tmp_path / "a"), WORDS, by_word=True)
    got = tf.read_ids(spark, str(tmp_path / "a")).collect()
    key = lambda i, ids: (i is not None, i or 0, ids)
    assert sorted(key(r["doc_id"], np.frombuffer(r["ids"], np.uint32).tolist()) for r in got) == sorted(key(r["doc_id"], library(r["text"])) for r in rows)
    assert tf.write_ids(empty(spark), str(tmp_path / "b"), WORDS, by_word=True).count() == 0
    assert tf.read_ids(spark, str(tmp_path / "b")).count() == 0


def test_query(spark, tmp_path, library):
    rows = [(i, prose(i, i % 50)) for i in range(120)] + [(300, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in tf.op11_token_files(spark, str(tmp_path)).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = [*library(t), 2]
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, np.uint32).tobytes()))
        start += len(ids)


def test_frequent_words_outlast_a_full_memo(monkeypatch):
    """A word that comes again and again is worked out once, however many others fill the memo."""
    monkeypatch.setattr(tf, "MOST_MEMOS", 50)
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        encoder = tf.WordEncoder(f.read(), True)
    asked = []
    made = encoder._model_ids
    encoder._model_ids = lambda piece: (asked.append(piece), made(piece))[1]
    text = [f"Frequent, {chr(97 + i % 26)}x{chr(97 + i // 26)}q other. don't café" for i in range(200)]
    for t in text:
        assert encoder.encode(np.frombuffer(t.encode(), np.uint8)) == encoder._whole(t)
    assert asked.count("frequent") == 1 and asked.count(",") == 1
    assert len(encoder) <= 60 and len(encoder.older) <= 60
