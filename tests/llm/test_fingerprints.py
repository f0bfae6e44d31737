from __future__ import annotations

import hashlib
import os.path

from hypothesis import given, settings
from hypothesis import strategies as st

from meritgrid.llm.fingerprints import _SCHEMA, PrefixHash, _fingerprints, code_points, likeness, next_documents
from tests.llm.cases import awkward, empty, prose, table

TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT, st.data())
def test_spans_and_extensions(a, b, data):
    x, y = PrefixHash(code_points(a)), PrefixHash(code_points(b))
    i = data.draw(st.integers(0, len(a)))
    j = data.draw(st.integers(0, len(b)))
    n = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert (x.span(i, i + n) == y.span(j, j + n)) == (a[i : i + n] == b[j : j + n])
    assert x.extension(i, y, j) == len(os.path.commonprefix([a[i:], b[j:]]))
    assert x.common_suffix(y) == len(os.path.commonprefix([a[::-1], b[::-1]]))
    assert (x.fingerprint() == y.fingerprint()) == (a == b)


def test_continued_prefix():
    own = PrefixHash(code_points("hello world"))
    assert PrefixHash(code_points("y!"), own, 4).fingerprint() == PrefixHash(code_points("helly!")).fingerprint()


def test_likeness():
    a = PrefixHash(code_points(prose(1, 300))).fingerprint()
    b = PrefixHash(code_points(prose(1, 300)[:1200] + prose(2, 200))).fingerprint()
    c = PrefixHash(code_points("An entirely different composition, " * 3)).fingerprint()
    assert likeness(a, a) == 1.0 and 0.5 < likeness(a, b) < 1 and likeness(a, c) < 0.15
    nothing = PrefixHash(code_points("")).fingerprint()
    assert likeness(nothing, nothing) == 1.0 and likeness(nothing, a) == 0.0


def test_next_documents_against_brute_force(spark):
    docs = [(i * 7 % 101, prose(i, i % 13)) for i in range(101)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in next_documents(df, _fingerprints, _SCHEMA).collect()}
    ordered = sorted(docs, reverse=True)
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)


def test_awkward_rows(spark):
    assert len(next_documents(table(spark), _fingerprints, _SCHEMA).collect()) == len(awkward())
    assert next_documents(empty(spark), _fingerprints, _SCHEMA).count() == 0
    one = next_documents(table(spark, awkward()[:1]), _fingerprints, _SCHEMA).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
