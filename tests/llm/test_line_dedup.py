from __future__ import annotations

import random

from meritgrid.llm import line_dedup
from meritgrid.llm.line_dedup import NEAR_CHARS, considered, dedup_lines, line_stage
from tests.llm.cases import awkward, empty, table


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i:] or a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute_force(docs: list[tuple[int, str]]) -> dict[int, str]:
    seen: list[str] = []
    out = {}
    for doc, text in sorted(docs):
        kept = []
        for line in text.split("\n"):
            x = considered(line)
            if x is None:
                kept.append(line)
                continue
            if not any(x == y or (min(len(x), len(y)) >= NEAR_CHARS and near(x, y)) for y in seen):
                kept.append(line)
            seen.append(x)
        out[doc] = "\n".join(kept)
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "é"]) for _ in range(rng.randrange(3, 9))) for _ in range(30)]

    def edited(line: str) -> str:
        i = rng.randrange(len(line) + 1)
        return rng.choice(
            [line, line[:i] + "x" + line[i:], line[:i] + line[i + 1 :], line[:i] + "y" + line[i + 1 :], line + " ", line[:i] + "zz" + line[i:]]
        )

    docs = [(i, "\n".join(edited(rng.choice(base)) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dedup_lines(df).collect()}
    assert got == brute_force(docs)
    assert any(t != got[d] for d, t in docs)


def test_awkward_rows(spark):
    df = table(spark)
    out = line_stage(spark, df, "", drop_emptied=False)
    assert out.columns == df.columns
    rows = out.collect()
    assert len(rows) == len(awkward())
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert by[2] == [None] and by[3] == [""] and by[7] == [""] and by[5] == ["one"]
    assert by[1][0] == by[1][1] == by[1][2] != ""
    assert by[8].count("line one has five words here\nline two has five words here") == 1
    assert line_stage(spark, empty(spark), "").count() == 0


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a b c d e", 7, 8)], "doc_id long, text string, n_lines int, n_removed int")
    assert dedup_lines(df).columns == ["doc_id", "text", "n_lines", "n_removed", "n_lines_1", "n_removed_1"]


def test_short_lines_and_lines_without_spaces(spark):
    long = "日本語の行には空白がないので一語に数えられる"
    rows = [(1, f"All rights reserved.\n\nx\n{long}\nCode: 12"), (2, f"All rights reserved. \n\nx\ny\n{long}一\nCode: 13\nCode: 12")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\ny\nCode: 13", 4)}


def test_variants_in_blocks(monkeypatch):
    line, all_of = "the quick brown fox jumps over the lazy dog", line_dedup.SAME_AFTER | line_dedup.SAME_BEFORE | line_dedup.LONGER_AFTER | line_dedup.LONGER_BEFORE | line_dedup.SHORTER

    def keys(x):
        return sorted((int(k), int(r)) for ks, rs in line_dedup.neighbourhood(x, all_of) for k, r in zip(ks, rs, strict=True))

    whole = keys(line)
    assert len(whole) == 2 * len(line) + 1
    monkeypatch.setattr(line_dedup, "BLOCK_CHARS", 7)
    assert keys(line) == whole
    by_role = {r: {k for k, s in keys(line[:9] + line[10:]) if s == r} for r in range(3)}
    assert by_role[2] <= {k for k, r in whole if r == 1}


def test_equal_lines_only(spark):
    df = spark.createDataFrame([(1, "a line of some words\nb"), (2, "a line of same words\nb")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dedup_lines(df, near_chars=None).collect()}
    assert got == {1: "a line of some words\nb", 2: "a line of same words"}


def test_white_space_rule(spark):
    rows = [(1, "\u00a0\n \t\na\u00a0b"), (2, "\u00a0\n \t\n a\u00a0b\x0c")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: " \t"}


def test_stage_drops_documents_that_lost_all_they_said(spark):
    rows = [(1, "one line of some length\nand another one here"), (2, "and another one here\n \none line of some length"), (3, None), (4, ""), (5, " \n"), (6, "one line of some length\nnew words stay here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in line_stage(spark, docs, "").collect()} == {1, 3, 4, 5, 6}
    every = {r["doc_id"]: r["text"] for r in line_stage(spark, docs, "", drop_emptied=False).collect()}
    assert every == {1: rows[0][1], 2: " ", 3: None, 4: "", 5: " \n", 6: "new words stay here"}


def test_lines_emit_at_shared_pieces_only(monkeypatch):
    """Lines an edit apart share a piece's key and a variant of that piece; many lines with a half in common emit few."""
    rng = random.Random(8)
    every = line_dedup.SAME_AFTER | line_dedup.SAME_BEFORE | line_dedup.LONGER_AFTER | line_dedup.LONGER_BEFORE | line_dedup.SHORTER

    def emitted(x, wanted):
        return {int(k) for ks, _ in line_dedup.neighbourhood(x, every, wanted) for k in ks}

    for block in (1 << 19, 7):
        monkeypatch.setattr(line_dedup, "BLOCK_CHARS", block)
        for _ in range(150):
            x = "".join(rng.choice("abc é") for _ in range(rng.randrange(9, 60)))
            i = rng.randrange(len(x) + 1)
            longer = x[:i] + rng.choice("abé") + x[i:]
            j = rng.randrange(len(x))
            other = x[:j] + "z" + x[j + 1 :]
            shorts = {k: (a, b) for k, a, b, up in line_dedup.pieces(x, every) if not up}
            met = [(k, a, b) for k, a, b, up in line_dedup.pieces(longer, every) if up and k in shorts]
            assert met and all(shorts[k] == (a, b) for k, a, b in met)
            assert emitted(longer, [(line_dedup.LONGER, a, b) for _, a, b in met]) & emitted(x, [(line_dedup.ITSELF, a, b) for _, a, b in met])
            met = [(a, b) for k, a, b, up in line_dedup.pieces(other, every) if not up and k in shorts]
            same = [(line_dedup.SAME, a, b) for a, b in met]
            assert met and emitted(other, same) & emitted(x, same)
            assert len(emitted(x, same)) <= sum(b - a for a, b in met) < len(x)
