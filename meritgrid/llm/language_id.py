"""Language identification by interpolated Kneser-Ney character models.

For each language the counts of character n-grams up to `ORDER` give an interpolated Kneser-Ney model: raw
counts at the highest order, counts of distinct left neighbours below, and one discount an order. The models
of all languages share their tables: for each order, a sorted array of 64-bit n-gram hashes with one row of
finished log probabilities, a column a language, and a sorted array of context hashes with the weights of
backing off. A text goes to the language with the lowest cross-entropy a character; if even that language is
a poor or barely better fit, the text is rejected.

Letters are lower-cased, and each run of other characters counts as one space, so digits, punctuation and
markup say nothing about the language. A text's first letter follows spaces only.

The models are fitted on a bounded sample: at most `docs_per_lang` texts a language (those with the smallest
hashes of their id) of at most `max_bytes` each, and `max_docs` in all. A quarter of it is kept out of the counts to calibrate: the
fit and the margin of texts in their own language, and of the same texts as they look when their language is
taken away, give a logistic curve for `score`, the probability that the chosen language is right; a text is
rejected if its log odds lie `SLACK` below what all but one in a thousand of the former reach, and below
`MOST_LOG_ODDS`. Prediction covers whole texts.

Defined results: a text that is null or has no letter is `und` with score 0; equal cross-entropies go to the
language that sorts first; rows with a null language teach nothing; rows are judged one by one, so repeated
rows are harmless; extra columns pass through; an empty table gives an empty result; with no usable language
every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meritgrid.llm.arrowtext import mix64, slices
from meritgrid.llm.frames import free_name, modest_batches
from meritgrid.llm.quality_classifier import learnable, logistic, sigmoid

ORDER = 4
UNDETERMINED = "und"
#: Characters at which the fit of a text counts half.
SHRINK = 64
SLACK = 1.0
#: No text with log odds above these is rejected.
MOST_LOG_ODDS = -2.0
#: Characters whose language is judged together when a text's fit is measured.
RUN = 64
#: Characters that are judged at once in up to so many languages, fewer in more: a longer text goes through in parts.
SLICE_CHARS, FEW_LANGUAGES = 1 << 18, 16
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


@dataclass
class Grams:
    """The n-grams of some texts: `keys[n - 1][i]` is that which ends at character i of text `doc[i]`."""

    doc: np.ndarray
    keys: list[np.ndarray]
    contexts: list[np.ndarray]


def grams(texts: list[str]) -> Grams:
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    letter = letters()[codes]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    return _grams(doc[kept], np.where(letter, codes, 32)[kept].astype(np.uint64), len(texts))


def _pieces(text: str, size: int) -> Iterator[str]:
    """A long text in parts of about `size` characters that begin with a space where there is one."""
    start = 0
    while start < len(text):
        stop = start + size
        space = text.rfind(" ", start + 1, stop + 1) if stop < len(text) else -1
        stop = space if space > start else stop
        yield text[start:stop]
        start = stop


def _long_grams(text: str, size: int) -> Iterator[Grams]:
    """The n-grams of one long text, as `grams` has them, some runs at a time: what is left of a run waits for the next
    part, and the last characters of the part before stand in front."""
    waiting, context, after_letter = np.zeros(0, np.uint64), np.zeros(0, np.uint64), False

    def made(codes: np.ndarray) -> Grams:
        g = _grams(np.zeros(len(context) + len(codes), np.int64), np.concatenate([context, codes]), 1)
        n = len(context)
        return Grams(g.doc[n:], [k[n:] for k in g.keys], [c[n:] for c in g.contexts])

    for piece in chain(_pieces(text, size), [" "]):
        codes = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters()[codes]
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        kept[0] |= after_letter
        after_letter = bool(letter[-1])
        waiting = np.concatenate([waiting, np.where(letter, codes, 32)[kept].astype(np.uint64)])
        whole = len(waiting) // RUN * RUN
        if whole:
            yield made(waiting[:whole])
            context, waiting = np.concatenate([context, waiting[:whole]])[1 - ORDER :], waiting[whole:]
    if len(waiting):
        yield made(waiting)


def _grams(doc: np.ndarray, codes: np.ndarray, docs: int) -> Grams:
    first = np.searchsorted(doc, np.arange(docs))
    place = np.arange(len(doc)) - first[doc]
    key, context = codes.copy(), np.zeros(len(codes), np.uint64)
    keys, contexts = [mix64(key + np.uint64(1))], [mix64(context)]
    for back in range(1, ORDER):
        earlier = np.full(len(codes), 32, np.uint64)
        earlier[back:] = codes[:-back]
        earlier[place < back] = 32
        context = context * _MULTIPLIER + earlier + np.uint64(1)
        keys.append(mix64(mix64(context + np.uint64(back)) + key))
        contexts.append(mix64(context + np.uint64(back)))
    return Grams(doc, keys, contexts)


class HashArray:
    """A sorted array of 64-bit hashes; a table over their leading bits starts each search next to its goal."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.shift = np.uint64(64 - max(4, int(2 * max(len(keys), 1)).bit_length()))
        self.starts = np.searchsorted(keys, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Where each hash is, or -1."""
        at = self.starts[(wanted >> self.shift).astype(np.int64)]
        behind = np.flatnonzero(self.keys[at] < wanted)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < wanted[behind]]
        at[self.keys[at] != wanted] = -1
        return at


@dataclass
class LanguageModel:
    """Languages, tables of each order (hashes, log2 probabilities; context hashes, log2 weights), curve."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    typical: np.ndarray = field(default_factory=lambda: np.zeros(0))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))
    reject_below: float = 0.0
    #: Shares of the calibration texts that the bound treats wrongly: own-language texts that it rejects, and texts
    #: with their language taken away that it lets pass.
    lost: float = 0.0
    passed: float = 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "found"}

    def indexes(self) -> tuple[list[HashArray], list[HashArray]]:
        if "found" not in self.__dict__:
            self.found = [HashArray(k) for k, _ in self.grams], [HashArray(k) for k, _ in self.contexts]
        return self.found

    def log2_p(self, g: Grams, at: np.ndarray, n: int) -> np.ndarray:
        """Log2 probability, for each language, of the characters at `at` after their n - 1 predecessors."""
        if n == 0:
            return np.full((len(at), len(self.languages)), self.base, np.float32)
        by_gram, by_context = self.indexes()
        where = by_gram[n - 1].find(g.keys[n - 1][at])
        out = self.grams[n - 1][1][where]
        missing = np.flatnonzero(where < 0)
        if len(missing):
            lower = self.log2_p(g, at[missing], n - 1)
            known = by_context[n - 1].find(g.contexts[n - 1][at[missing]])
            lower[known >= 0] += self.contexts[n - 1][1][known[known >= 0]]
            out[missing] = lower
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the bits a character in each language and the characters counted; of each run of `RUN`
        characters the bits in each language and its text."""
        return self._cross_entropy(grams(texts), len(texts))

    def _cross_entropy(self, g: Grams, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p = self.log2_p(g, np.arange(len(g.doc)), ORDER)
        n = np.bincount(g.doc, minlength=docs)
        first, runs = np.cumsum(n) - n, -(-n // RUN)
        run = (np.arange(len(g.doc)) - first[g.doc]) // RUN + (np.cumsum(runs) - runs)[g.doc]
        bits = np.column_stack([-np.bincount(run, p[:, k], runs.sum()) for k in range(p.shape[1])])
        of = np.repeat(np.arange(docs), runs)
        total = np.column_stack([np.bincount(of, bits[:, k], docs) for k in range(p.shape[1])])
        return total / np.maximum(n, 1)[:, None], n, bits, of

    def _long(self, text: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one long text the bits a character in each language, the characters counted and the fit."""
        bits, best, n = np.zeros((1, len(self.languages))), 0.0, 0
        for g in _long_grams(text, size):
            h, m, runs, _ = self._cross_entropy(g, 1)
            bits, best, n = bits + h * m[0], best + float(runs.min(axis=1).sum()), n + int(m[0])
        return bits / max(n, 1), np.array([n]), np.array([best / max(n, 1)])

    def fits(self, n: np.ndarray, bits: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Bits a character if each run is in the language that suits it best: quotations in a second language
        do not make a text foreign."""
        return np.bincount(of, bits.min(axis=1), len(n)) / np.maximum(n, 1)

    def signs(self, h: np.ndarray, n: np.ndarray, fit: np.ndarray, best: np.ndarray) -> np.ndarray:
        """How much worse than usual for its language a text fits, less so if it is short, for then the fit
        varies; and how much worse the next language (or chance) is."""
        rows = np.arange(len(h))
        rest = np.column_stack([h, np.full(len(h), -self.base)])
        rest[rows, best] = np.inf
        worse = (fit - self.typical[best]) * n / (n + SHRINK)
        return np.column_stack([worse, np.minimum(rest.min(axis=1) - h[rows, best], 2.0)])

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return langs, scores
        start, most = 0, max(4096, SLICE_CHARS * FEW_LANGUAGES // max(FEW_LANGUAGES, len(self.languages)))
        while start < len(texts):
            stop, size = start + 1, len(texts[start])
            while stop < len(texts) and size + len(texts[stop]) < most:
                size += len(texts[stop])
                stop += 1
            if size > most:
                h, n, fit = self._long(texts[start], most)
            else:
                h, n, bits, of = self.cross_entropy(texts[start:stop])
                fit = self.fits(n, bits, of)
            best = h.argmin(axis=1)
            score = sigmoid(self.curve[0] + self.signs(h, n, fit, best) @ self.curve[1:])
            for i in np.flatnonzero(n):
                langs[start + i], scores[start + i] = self.languages[best[i]], score[i]
            start = stop
        return langs, scores


def _kneser_ney(per_language: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]], model: LanguageModel) -> None:
    """Fills the tables. Of each language and order: n-gram hashes, their counts, contexts, and their suffixes."""
    for n in range(ORDER):
        keys = np.unique(np.concatenate([x[n][0] for x in per_language]))
        contexts = np.unique(np.concatenate([x[n][2] for x in per_language]))
        p = np.zeros((len(keys), len(per_language)))
        weight = np.zeros((len(contexts), len(per_language)))
        context_of, suffix_of = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint64)
        for k, x in enumerate(per_language):
            gram, count, context, suffix = x[n]
            at, into = np.searchsorted(keys, gram), np.searchsorted(contexts, context)
            context_of[at], suffix_of[at] = into, suffix
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = min(max(once / (once + 2 * twice), 0.05), 0.95) if twice else 0.5
            total = np.bincount(into, count, len(contexts))
            types = np.bincount(into, minlength=len(contexts))
            seen = total > 0
            weight[:, k] = np.where(seen, discount * types / np.maximum(total, 1), 1.0)
            p[at, k] = np.maximum(count - discount, 0) / total[into]
        lower = np.full_like(
            p,
            2.0**model.base,
        ) if n == 0 else 2.0 ** model.grams[n - 1][1][np.searchsorted(model.grams[n - 1][0], suffix_of)].astype(float)
        p += weight[context_of] * lower
        model.grams.append((keys, np.log2(p).astype(np.float32)))
        model.contexts.append((contexts, np.log2(weight).astype(np.float32)))


def _counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Kneser-Ney counts of one language: raw at the highest order, distinct left neighbours below."""
    g = grams(texts)
    out = []
    above: np.ndarray | None = None
    for n in reversed(range(ORDER)):
        if above is None:
            keys, at, count = np.unique(g.keys[n], return_index=True, return_counts=True)
        else:
            keys, inverse, count = np.unique(g.keys[n][above], return_inverse=True, return_counts=True)
            at = np.zeros(len(keys), np.int64)
            at[inverse] = above
        out.append((keys, count.astype(float), g.contexts[n][at], g.keys[n - 1][at] if n else np.zeros(len(at), np.uint64)))
        above = at
    return out[::-1]


def train(samples: dict[str, list[str]]) -> LanguageModel:
    """Models of the languages in `samples`, and the curve that calibrates their scores."""
    samples = {k: v for k, v in sorted(samples.items()) if any(letters()[ord(c)] for t in v for c in t)}
    model = LanguageModel(sorted(samples))
    if not samples:
        return model
    held = {k: v[::4] if len(v) >= 4 else v for k, v in samples.items()}
    taught = {k: [t for i, t in enumerate(v) if i % 4] if len(v) >= 4 else v for k, v in samples.items()}
    counts = [_counts(taught[k]) for k in model.languages]
    model.base = -float(np.log2(1 + len(np.unique(np.concatenate([c[0][0] for c in counts])))))
    _kneser_ney(counts, model)
    right, wrong = [], []
    model.typical = np.zeros(len(model.languages))
    for k, name in enumerate(model.languages):
        texts = [t for t in held[name] if any(letters()[ord(c)] for c in t)]
        if not texts:
            continue
        h, n, bits, of = model.cross_entropy(texts)
        fit = model.fits(n, bits, of)
        model.typical[k] = np.median(fit)
        own = h.argmin(axis=1) == k
        right.append((k, h[own], n[own], fit[own], h[own].argmin(axis=1)))
        if len(model.languages) > 1:
            absent = np.where(np.arange(len(model.languages)) == k, np.inf, 0.0)
            wrong.append((k, h + absent, n, model.fits(n, bits + absent, of), (h + absent).argmin(axis=1)))
    right, wrong = ([model.signs(*x[1:]) for x in part] for part in (right, wrong))
    good = np.concatenate([*right, np.zeros((0, 2))])
    bad = np.concatenate(wrong) if wrong else good + np.array([1.5, -1.5])
    if not len(good):
        return model
    x, y = np.concatenate([good, bad]), np.repeat([1.0, 0.0], [len(good), len(bad)])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    beta = logistic((x - mean) / scale, y, np.ones(len(x)))
    model.curve = np.array([beta[0] - (beta[1:] * mean / scale).sum(), *(beta[1:] / scale)])
    logits = model.curve[0] + good @ model.curve[1:]
    bound = min(float(np.quantile(logits, 0.001)) - SLACK, MOST_LOG_ODDS)
    model.reject_below = float(sigmoid(np.array(bound)))
    model.lost = float((logits < bound).mean())
    model.passed = float((model.curve[0] + bad @ model.curve[1:] >= bound).mean())
    return model


def fit(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_lang: int = 400,
    max_bytes: int = 65_536,
    max_langs: int = 200,
    max_docs: int = 6_400,
) -> LanguageModel:
    """Fit on a bounded sample; only ids travel until it is chosen, and of each language only those with hashes so
    small that four times the sample is expected to have them. An id has one text (of several the least). `max_docs` texts in all, of the `max_langs` languages
    with the most documents, so the sample is bounded in a table with any number of languages, too."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    rows = rows.where(F.col("id").isNotNull() & F.col("l").isNotNull())
    counts = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(max_langs).collect()
    if not counts:
        return LanguageModel([])
    docs_per_lang = max(1, min(docs_per_lang, max_docs // len(counts)))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["l"], min(1.0, 4 * docs_per_lang / r["n"]))))
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    rows = rows.where((h < share[F.col("l")] * (1 << 40)) & F.octet_length("t").between(1, max_bytes))
    chosen = rows.select("id", "l").distinct().withColumn("k", F.row_number().over(W.partitionBy("l").orderBy(h, "id"))).where(F.col("k") <= docs_per_lang)
    ids = [(r["id"], r["l"]) for r in chosen.collect()]
    if not ids:
        return LanguageModel([])
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("l", docs.schema[lang_col].dataType)])
    wanted = docs.sparkSession.createDataFrame(ids, schema)
    texts = rows.join(F.broadcast(wanted), ["id", "l"]).groupBy("id", "l").agg(F.min("t").alias("t")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: (str(r["l"]), str(r["id"]), r["t"])):
        samples.setdefault(str(r["l"]), []).append(r["t"])
    return train(samples)


def identify(
    docs: DataFrame, model: LanguageModel, *, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score"
) -> DataFrame:
    """`docs` with the predicted language and its score; map only, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    lang_col, score_col = free_name(docs, lang_col), free_name(docs, score_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, text_col)):
            langs, scores = shared.value.predict([t or "" for t in batch.column(at).to_pylist()])
            made = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, lang_col, score_col])

    return docs.mapInArrow(
        run, T.StructType([*docs.schema, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(learnable(docs))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"), "lang_pred", "score"
    )


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; columns as they came."""
    modest_batches(spark)
    model = fit(learnable(docs))
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    seen = identify(docs, model, lang_col=lang, score_col=score)
    return seen.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= model.reject_below)).drop(lang, score)
