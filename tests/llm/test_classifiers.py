from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from meritgrid.llm import language_id as lang
from meritgrid.llm import quality_classifier as quality
from tests.llm.cases import FRENCH, awkward, empty, prose, table


def labelled(spark, n=120):
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        text = prose(i, 80) if good else " | ".join(prose(i, 90, ["BUY", "$$$", "click", "!!!", "win"]).split())
        rows.append((i, text))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_on_texts_it_did_not_learn_from(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, quality.learnable(labels))
    scored = quality.score(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).collect()
    assert len(scored) > 15
    assert np.mean([(r["score"] >= quality.THRESHOLD) == bool(r["quality"]) for r in scored]) >= 0.95


def test_quality_against_plain_compression(spark):
    """Each text block by block through plain compressors, then the curve."""
    docs, labels = labelled(spark)
    model = quality.fit(docs, quality.learnable(labels))

    def size(dictionary: bytes, text: bytes) -> int:
        total = 0
        for i in range(0, len(text), quality.BLOCK):
            d = zstandard.ZstdCompressionDict(dictionary)
            packer = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
            total += len(packer.compress(text[i : i + quality.BLOCK]))
        return total

    rows = [(i, t) for i, t in enumerate(["", "ok", prose(3, 300), "BUY !!! click | win | $$$ " * 40, "日本語 " * 200, prose(9, 2)])]
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        raw = text.encode()
        good = size(model.good, raw)
        x = ((size(model.bad, raw) - good) / len(raw), good / len(raw)) if raw else (0.0, 1.0)
        z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.scale, strict=True))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), abs=1e-9)


def test_quality_awkward_rows(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    out = quality.score(table(spark), model, score_col="made")
    rows = out.collect()
    assert len(rows) == len(awkward()) and all(0 <= r["made"] <= 1 for r in rows)
    assert len({r["made"] for r in rows if not r["text"]}) == 1
    assert quality.score(empty(spark), model, score_col="made").count() == 0
    assert quality.score(table(spark), model).columns == [*table(spark).columns, "score_1"]
    both = labels.unionByName(labels.where("doc_id < 60").selectExpr("doc_id", "1 - quality AS quality"))
    assert quality.fit(docs, both) == quality.fit(docs, labels.where("doc_id >= 60"))
    none = quality.fit(docs, labels.where("false"))
    assert {r["made"] for r in quality.score(table(spark), none, score_col="made").collect()} == {1.0}


def bilingual() -> dict[str, list[str]]:
    return {"en": [prose(i, 60) for i in range(30)], "fr": [prose(i, 60, FRENCH) for i in range(30)]}


def test_language_on_texts_it_did_not_learn_from():
    model = lang.train(bilingual())
    texts = [prose(1000 + i, 25) for i in range(20)] + [prose(1000 + i, 25, FRENCH) for i in range(20)]
    got, scores = model.predict(texts)
    assert got == ["en"] * 20 + ["fr"] * 20 and (scores >= model.reject_below).all()
    _, foreign = model.predict(["Это русский текст, которого модель не знает, и его следует отвергнуть"])
    assert foreign[0] < model.reject_below


class PlainKneserNey:
    """Interpolated Kneser-Ney of one language in dictionaries of strings."""

    def __init__(self, texts: list[str], alphabet: int):
        self.base = 1 / (1 + alphabet)
        grams = [g for t in texts for g in self.grams(t)]
        self.count = {lang.ORDER: Counter(grams)}
        for n in range(lang.ORDER - 1, 0, -1):
            self.count[n] = Counter(g[1:] for g in self.count[n + 1])
        self.discount, self.total, self.types = {}, {}, {}
        for n, count in self.count.items():
            once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
            self.discount[n] = min(max(once / (once + 2 * twice), 0.05), 0.95) if twice else 0.5
            self.total[n], self.types[n] = Counter(), Counter()
            for g, c in count.items():
                self.total[n][g[:-1]] += c
                self.types[n][g[:-1]] += 1

    @staticmethod
    def grams(text: str) -> list[str]:
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        line = "".join(w + " " for w in letters.split())
        return [(" " * (lang.ORDER - 1) + line)[i : i + lang.ORDER] for i in range(len(line))]

    def p(self, gram: str) -> float:
        n = len(gram)
        if n == 0:
            return self.base
        lower, total = self.p(gram[1:]), self.total[n][gram[:-1]]
        if not total:
            return lower
        return (max(self.count[n][gram] - self.discount[n], 0) + self.discount[n] * self.types[n][gram[:-1]] * lower) / total

    def cross_entropy(self, text: str) -> float:
        grams = self.grams(text)
        return -sum(math.log2(self.p(g)) for g in grams) / max(len(grams), 1)


def test_language_against_plain_kneser_ney(spark):
    samples = bilingual()
    model = lang.train(samples)
    taught = {k: [t for i, t in enumerate(v) if i % 4] for k, v in samples.items()}
    alphabet = len({g[-1] for v in taught.values() for t in v for g in PlainKneserNey.grams(t)})
    plain = {k: PlainKneserNey(v, alphabet) for k, v in taught.items()}
    texts = [
        prose(77, 40),
        prose(78, 3, FRENCH),
        "La rivière, 12 ponts -- under THE sky!",
        "zzz qqq",
        "é",
        "the",
        prose(5, 400) + "\n" + prose(5, 400, FRENCH),
    ]
    h, n, _, _ = model.cross_entropy(texts)
    for i, text in enumerate(texts):
        assert n[i] == len(PlainKneserNey.grams(text))
        assert [h[i][k] for k in range(2)] == pytest.approx([plain[k].cross_entropy(text) for k in model.languages], abs=1e-4)
    rows = list(enumerate([*texts, None, "", "123"]))
    made = lang.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    best = {i: min(model.languages, key=lambda k: plain[k].cross_entropy(t)) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["lang_pred"] for r in made} == best | dict.fromkeys((7, 8, 9), "und")
    assert all((r["score"] == 0) == (r["lang_pred"] == "und") and 0 <= r["score"] <= 1 for r in made)


def test_language_model_is_a_distribution():
    """The probabilities of all characters after a context add up to about one, for seen and unseen contexts."""
    model = lang.train(bilingual())
    letters = sorted({c for v in bilingual().values() for t in v for c in t.lower() if c.isalpha()})
    for context in ("the ", "qqqq"):
        total = np.zeros(2)
        for c in [*letters, " "]:
            g = lang.grams([context.strip() + c if context.strip() == "qqqq" else "the" + (c if c != " " else "")])
            last = len(g.doc) - (1 if c == " " else 2)
            total += 2.0 ** model.log2_p(g, np.array([last]), lang.ORDER)[0].astype(float)
        assert (total <= 1.0 + 1e-3).all() and (total > 0.7).all()


def test_language_does_not_depend_on_the_batch():
    model = lang.train(bilingual())
    texts = [prose(5, 10), "", prose(6, 10, FRENCH), "une", "!!!"]
    alone = [model.predict([t]) for t in texts]
    langs, scores = model.predict(texts)
    assert langs == [a[0][0] for a in alone] and np.allclose(scores, [a[1][0] for a in alone])


def test_language_awkward_rows(spark):
    model = lang.fit(table(spark))
    out = lang.identify(table(spark), model, lang_col="made", score_col="made_score").collect()
    assert len(out) == len(awkward())
    by = {r["doc_id"]: r["made"] for r in out}
    assert lang.identify(table(spark), model).columns[-2:] == ["lang_pred_1", "score_1"]
    few = lang.fit(
        spark.createDataFrame([(i, prose(i, 9), f"l{i % 9}") for i in range(90)], "doc_id long, text string, lang string"),
        max_langs=3,
        max_docs=12,
    )
    assert len(few.languages) == 3
    assert by[2] == by[3] == by[4] == by[11] == "und" and by[1] == "en"
    kept = lang.language_stage(spark, table(spark), "")
    assert kept.columns == table(spark).columns and 1 in [r["doc_id"] for r in kept.collect()]
    assert lang.language_stage(spark, empty(spark), "").count() == 0
    assert lang.LanguageModel([]).predict(["words"]) [0] == ["und"]


def test_language_of_a_long_text_goes_through_in_parts(monkeypatch):
    model = lang.train(bilingual())
    texts = [prose(k, 900, FRENCH) + " 12, 34! " * k + prose(k, 300) for k in range(4)] + ["1234 " * 900, "Σ" * 5000, "x" * 4500, " " * 5000 + "la maison"]
    whole = [model.cross_entropy([t]) for t in texts]
    fits = [model.fits(n, bits, of) for _, n, bits, of in whole]
    for size in (64, 257, 4096):
        for t, (h, n, _, _), fit in zip(texts, whole, fits, strict=True):
            own, m, own_fit = model._long(t, size)
            assert m == n and np.allclose(own, h, atol=1e-6) and np.allclose(own_fit, fit, atol=1e-6)
    want = model.predict(texts)
    monkeypatch.setattr(lang, "SLICE_CHARS", 100)
    got = model.predict(texts)
    assert got[0] == want[0] and np.allclose(got[1], want[1], atol=1e-6)


def test_an_id_of_many_rows_gives_one_text_to_either_sample(spark, monkeypatch):
    rows = [(7, prose(1, 30), "en")] * 300 + [(i, prose(i, 30, FRENCH), "fr") for i in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    monkeypatch.setattr(lang, "train", lambda samples: seen.update(samples))
    lang.fit(docs)
    assert {k: len(v) for k, v in seen.items()} == {"en": 1, "fr": 20}
    labels = spark.createDataFrame([(7, 1), *((i, 0) for i in range(20, 40))], "doc_id long, quality int")
    assert quality.fit(docs, labels).constant == pytest.approx(1 / 21)
