from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from meritgrid.llm.byte_bpe import ByteBpe, decode, encode, merge_by_rank, read_ranks, round_trip
from tests.llm.cases import awkward, empty, table

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coders():
    with open(PATH, "rb") as f:
        ranks = read_ranks(f.read())
    return ByteBpe(ranks, public_tokenizers.PATTERN), tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=ranks,
        special_tokens={},
    )


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_as_the_library(coders, text):
    own, reference = coders
    text = text.encode("utf-8", "ignore").decode()
    ids = own.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "tion" * 3000, " " * 300 + "x", "abab" * 999 + "c", "<|endoftext|>", "ß" * 400])
def test_long_pieces(coders, text):
    own, reference = coders
    assert own.encode(text) == reference.encode_ordinary(text)


def test_plain_merging():
    ranks = {b"a": 0, b"b": 1, b"ab": 2, b"abab": 3}
    assert merge_by_rank(b"ababa", ranks) == [b"abab", b"a"]


def test_awkward_rows(spark, coders):
    rows = round_trip(table(spark), PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(awkward())
    for r, (_, text, *_rest) in zip(sorted(rows, key=str), sorted(awkward(), key=str), strict=False):
        assert r["n_tokens"] >= 0
    nothing = hashlib.sha256(b"").hexdigest()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["ids_sha256"] == by[3]["decoded_sha256"] == nothing and by[2]["n_tokens"] == 0
    ids = encode(table(spark), PATH, public_tokenizers.PATTERN, ids_col="made")
    back = decode(ids, PATH, public_tokenizers.PATTERN, ids_col="made", bytes_col="out").collect()
    assert all(bytes(r["out"]) == (r["text"] or "").encode() for r in back)
    twice = decode(encode(ids.withColumnRenamed("made", "ids"), PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert twice.columns[-3:] == ["ids", "ids_1", "decoded"] and twice.count() == len(awkward())
    clash = round_trip(ids.withColumnRenamed("made", "N_tokens"), PATH, public_tokenizers.PATTERN)
    assert clash.columns[-4:] == ["N_tokens", "n_tokens_1", "ids_sha256", "decoded_sha256"]
    assert round_trip(empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_long_texts_in_parts(coders, monkeypatch):
    from meritgrid.llm import byte_bpe

    own, reference = coders
    text = "The river, 12 bridges; über 300 Boote.\n" * 40_000
    ids = reference.encode_ordinary(text)
    want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert byte_bpe._digests(own, text) == want
    monkeypatch.setattr(byte_bpe, "IDS_AT_ONCE", 7)
    assert byte_bpe._digests(own, text[:2000])[0] == len(reference.encode_ordinary(text[:2000]))


def test_rank_files_of_one_name(spark, tmp_path):
    """Two files with the same name are two vocabularies."""
    import base64

    df = spark.createDataFrame([(1, "abab")], "id long, text string")
    got = []
    for i, tokens in enumerate(([b"a", b"b"], [b"a", b"b", b"ab"])):
        folder = tmp_path / str(i)
        folder.mkdir()
        (folder / "ranks.tiktoken").write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for r, t in enumerate(tokens)))
        got.append(encode(df, str(folder / "ranks.tiktoken"), r"\w+").first()["ids"])
    assert got == [[0, 1, 0, 1], [2, 2]]
