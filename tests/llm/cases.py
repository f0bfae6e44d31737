"""Small awkward tables: nulls in every column, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, key string, grp long, bucket int, lang_pred string"
WORDS = "the of and river stone bridge walked slowly under a grey evening sky while distant bells called people home again".split()
FRENCH = "le la les des une maison près rivière nous avons marché lentement sous un ciel gris pendant que cloches sonnaient".split()


def prose(seed: int, n: int, words=WORDS) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + (str(rng.randrange(50)) if rng.random() < 0.2 else "") for _ in range(n))


def awkward() -> list[tuple]:
    texts = {
        1: prose(1, 60),
        2: None,
        3: "",
        4: "   \n\t ",
        5: "one",
        6: prose(6, 30_000),
        7: prose(1, 60),
        8: "line one has five words here\nline two has five words here\nline one has five words here",
        9: "日本語のテキスト 😀 ééé",
        10: prose(1, 60).replace("river", "rivers", 1),
        11: "12345 !!! ???",
    }
    rows = [(i, t, None if i == 4 else "en", None if i == 5 else f"s{i % 2}", None, 0.5, i, "k", 1, 2, "x") for i, t in texts.items()]
    rows += [
        rows[0],
        rows[0],
        (None, "a row without an id that has words", "en", "s1", 3, None, None, None, None, None, None),
        (8, "another text with the same id as before", "en", "s0", 1, 0.0, 0, "", 0, 0, ""),
    ]
    return rows


def table(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
