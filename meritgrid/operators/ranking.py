"""From percentiles to a ranking: quality prior, topical fit, recency, final score, bands, re-ranking."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.functions.positions import midpoint_percentile
from meritgrid.operators.features import mechanism_weight

# Defaults of the formula rank = integrity * quality^alpha * topic^beta * recency^gamma.
ALPHA, BETA, GAMMA = 0.7, 1.0, 0.4
EXPONENT_BOUNDS = {"alpha": (0.3, 1.2), "beta": (0.5, 1.5), "gamma": (0.1, 0.8)}
LEAST_PERCENTILE = 0.01
HALF_LIFE_YEARS, SQUASH, PREPRINT = 3.0, 3.0, 0.6
TOP_ARTIFACTS = 3
FAMILIES = ["f1_rcr", "f2_funding", "f3_leadership", "f4_apex", "f5_translational", "f6_lineage", "f7_clinician"]


def quality_raw(percentiles: dict[str, Column], weights: dict[str, float]) -> Column:
    """exp of the weighted sum of log percentiles; a missing family counts as the least percentile."""
    used = {k: w for k, w in weights.items() if w}
    if not used:
        return F.lit(0.0)
    floor = F.lit(LEAST_PERCENTILE)
    logs = [F.lit(w) * F.log(F.greatest(F.coalesce(percentiles.get(k, F.lit(None).cast("double")), F.lit(0.0)), floor)) for k, w in used.items()]
    return F.exp(reduce(lambda a, b: a + b, logs))


def quality_prior(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """From a percentile column a family: raw_score and percentile in the cohort."""
    have = {k: F.col(k) for k in FAMILIES if k in candidates.columns}
    out = midpoint_percentile(candidates.withColumn("_raw", quality_raw(have, weights)), "_raw", "uuid")
    return out.withColumn("raw_score", F.round("_raw", 8)).withColumn("percentile", F.round("percentile", 6)).drop("_raw")


def topic_vectors(artifacts: DataFrame, weight: Column, terms: str = "terms") -> DataFrame:
    """(uuid, term, w): the weights of each artifact added for each of its distinct terms, scaled to length 1."""
    long = artifacts.select("uuid", weight.alias("w"), F.explode(F.array_distinct(terms)).alias("term"))
    summed = long.groupBy("uuid", "term").agg(F.sum("w").alias("w"))
    length = summed.groupBy("uuid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return summed.join(length, "uuid").select("uuid", "term", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(F.col("w")).alias("w"))


def query_vector(terms: dict[str, float]) -> dict[str, float]:
    """The terms' weights scaled to length 1."""
    norm = float(np.sqrt(sum(w * w for w in terms.values())))
    return {t: w / norm for t, w in terms.items()} if norm else {}


def topical_fit(vectors: DataFrame, query: dict[str, float]) -> DataFrame:
    """(uuid, topical_fit): the cosine, from 0 to 1. A query has a handful of terms, so they are literals and only
    rows with one of them leave the scan."""
    if not query:
        return vectors.select("uuid").distinct().withColumn("topical_fit", F.lit(0.0))
    weights = F.create_map(*(x for t, w in query.items() for x in (F.lit(t), F.lit(w))))
    hits = vectors.where(F.col("term").isin(list(query))).groupBy("uuid").agg(F.sum(F.col("w") * weights[F.col("term")]).alias("dot"))
    return hits.select("uuid", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("dot"))).alias("topical_fit"))


def recency(artifacts: DataFrame, query_terms: list[str], reference: Column, half_life: float = HALF_LIFE_YEARS, squash: float = SQUASH) -> DataFrame:
    """(uuid, recency) from (uuid, published, role_weight, type_weight, is_preprint, terms)."""
    wanted = F.array(*(F.lit(t) for t in query_terms)) if query_terms else F.array().cast("array<string>")
    years = F.datediff(reference, F.col("published")) / 365.25
    decay = F.exp(-years / F.lit(half_life / float(np.log(2))))
    part = F.col("role_weight") * F.col("type_weight") * F.when(F.col("is_preprint"), PREPRINT).otherwise(1.0) * decay
    mass = artifacts.groupBy("uuid").agg(F.sum(F.when(F.arrays_overlap("terms", wanted), part).otherwise(0.0)).alias("a"))
    return mass.select("uuid", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.exp(-F.col("a") / squash))).alias("recency"))


def linear_recency(last_updated: Column, reference: Column) -> Column:
    """The live path's recency: a straight line over five years, from 0.1 to 1; unknown is 0.5."""
    line = F.least(F.lit(1.0), F.greatest(F.lit(0.1), 1.0 - F.datediff(reference, last_updated) / 1825.0))
    return F.coalesce(line, F.lit(0.5))


def power(base: Column, exponent: Column | float) -> Column:
    return F.when(base <= 0, 0.0).otherwise(F.pow(base, exponent if isinstance(exponent, Column) else F.lit(exponent)))


def scored(candidates: DataFrame, alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA) -> DataFrame:
    """The candidates that no gate removes, with powered parts and the final score, all rounded to 8 places."""
    allowed = candidates.where(~F.coalesce(F.col("is_hard_zero"), F.lit(False)) & (F.col("integrity") != 0))
    parts = {
        "quality_powered": power(F.col("quality"), alpha),
        "topical_powered": power(F.col("topical"), beta),
        "recency_powered": power(F.col("recency"), gamma),
    }
    out = allowed.withColumns(parts)
    final = F.col("integrity") * F.col("quality_powered") * F.col("topical_powered") * F.col("recency_powered")
    return out.withColumn("_final", final).withColumns({k: F.round(k, 8) for k in parts} | {"score": F.round(final, 8)})


def ranked(candidates: DataFrame, k: int | None = None, **exponents: float) -> DataFrame:
    """The top k by score, ties by uuid, with ranks from 1. The limit is applied in every task before the rows
    meet, and only those k rows are numbered."""
    from meritgrid.functions.positions import numbered

    all_rows = scored(candidates, **exponents)
    if k is None:
        down = all_rows.withColumn("_down", -F.col("_final"))
        return numbered(down, ["_down", "uuid"], "rank", "_n").drop("_down", "_n", "_final")
    top = all_rows.orderBy(F.desc("_final"), "uuid").limit(k)
    rows = top.agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("_final")).alias("_d"), "uuid", *[c for c in top.columns if c not in ("uuid", "_final")]))
        ).alias("r")
    )
    return rows.select(F.posexplode("r")).select((F.col("pos") + 1).alias("rank"), "col.*").drop("_d")


def exponent_draws(mean: tuple[float, float, float], covariance: list[list[float]], samples: int = 200, seed: int = 42) -> np.ndarray:
    """Exponents drawn from a normal distribution and clipped to their bounds, a row a draw."""
    draws = np.random.default_rng(seed).multivariate_normal(mean, np.array(covariance), size=samples)
    for i, bounds in enumerate(EXPONENT_BOUNDS.values()):
        draws[:, i] = np.clip(draws[:, i], *bounds)
    return draws


def score_bands(
    candidates: DataFrame,
    mean: tuple[float, float, float],
    covariance: list[list[float]],
    samples: int = 200,
    seed: int = 42,
) -> DataFrame:
    """2.5, 50 and 97.5 % of the score under drawn exponents. The draws are few and shared: one row with an array, that
    every task gets. Percentiles interpolate linearly."""
    draws = exponent_draws(mean, covariance, samples, seed)
    table = candidates.sparkSession.createDataFrame([([tuple(d) for d in draws.tolist()],)], "_draws array<struct<a:double,b:double,g:double>>")
    drawn = F.col("_draws")
    score = lambda d: F.col("integrity") * power(
        F.col("quality"),
        d["a"],
    ) * power(F.col("topical"), d["b"]) * power(F.col("recency"), d["g"])
    shared = candidates.withColumn("_one", F.lit(1)).join(F.broadcast(table.withColumn("_one", F.lit(1))), "_one")
    rows = shared.withColumn("_s", F.array_sort(F.transform(drawn, score)))

    def at(p: float) -> Column:
        place = p * (samples - 1)
        low, share = int(place), place - int(place)
        first = F.element_at("_s", low + 1)
        return first + (F.element_at("_s", min(low + 2, samples)) - first) * share

    return rows.select("uuid", at(0.025).alias("low"), at(0.5).alias("median"), at(0.975).alias("high"), F.lit(samples).alias("n_samples"))


def rerank(results: DataFrame, alpha: float, beta: float, gamma: float) -> DataFrame:
    """A saved result in the order of other exponents; integrity is left out, as it is in the client."""
    return results.withColumn(
        "rescored",
        F.pow("quality", F.lit(alpha)) * F.pow("topical", F.lit(beta)) * F.pow("recency", F.lit(gamma)),
    ).orderBy(F.desc("rescored"), "uuid")


def result_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(uuid, old_rank, new_rank, change) of two results by uuid: new, gone, up, down or same."""
    both = old.select("uuid", F.col("rank").alias("old_rank")).join(new.select("uuid", F.col("rank").alias("new_rank")), "uuid", "full_outer")
    change = (
        F.when(F.col("old_rank").isNull(), "new")
        .when(F.col("new_rank").isNull(), "gone")
        .when(F.col("new_rank") < F.col("old_rank"), "up")
        .when(F.col("new_rank") > F.col("old_rank"), "down")
        .otherwise("same")
    )
    return both.withColumn("change", change)


def live_features(candidates: DataFrame, rcr: DataFrame, apex_names: DataFrame) -> DataFrame:
    """The live path's simplified raw features f1 to f7, each from 0 to 1, from the id lists of a candidate.

    `candidates`: uuid, name, pmids, nct_ids, grant_ids, patent_ids, evidence_trail, sources, affiliations.
    """
    ratios = candidates.select(
        "uuid",
        F.explode(F.array_distinct("pmids")).alias("pmid"),
    ).join(rcr, "pmid").groupBy("uuid").agg(F.avg("rcr").alias("_rcr"))
    named = apex_names.select(F.lower("name").alias("_name")).distinct().withColumn("_apex", F.lit(1.0))
    c = candidates.join(ratios, "uuid", "left").withColumn("_name", F.lower("name")).join(named, "_name", "left")
    count = {k: F.coalesce(F.size(k), F.lit(0)).cast("double") for k in ("pmids", "nct_ids", "grant_ids", "patent_ids")}
    one = lambda x: F.least(F.lit(1.0), x)
    total = F.aggregate("grant_ids", F.lit(0.0), lambda a, g: a + mechanism_weight(g))
    told = F.size(F.filter("evidence_trail", lambda e: e.contains("Principal Investigator") | e.contains("PI on ")))
    kinds = reduce(lambda a, b: a + b, [(v > 0).cast("double") for v in count.values()])
    career = F.size(F.filter("grant_ids", lambda g: g.rlike("^(K08|K23|K24)")))
    clinical = F.exists("affiliations", lambda a: F.lower(a).rlike("hospital|medical center|clinic"))
    return c.select(
        *candidates.columns,
        one(F.coalesce(F.col("_rcr") / 5.0, count["pmids"] / 20.0)).alias("f1"),
        F.when(count["grant_ids"] > 0, 1.0 - F.exp(-total / 3.0)).otherwise(0.0).alias("f2"),
        one((told + F.least(count["nct_ids"], F.lit(5.0)) * 0.6 + F.least(count["grant_ids"], F.lit(5.0)) * 0.4) / 5.0).alias("f3"),
        F.coalesce("_apex", F.lit(0.0)).alias("f4"),
        one((count["nct_ids"] + count["patent_ids"]) / 5.0).alias("f5"),
        one((F.size(F.array_distinct("sources")) * 0.6 + kinds * 0.4) / 3.0).alias("f6"),
        one((career / 3.0 + (count["nct_ids"] > 0).cast("double") + F.coalesce(clinical, F.lit(False)).cast("double")) / 3.0).alias("f7"),
    )


def live_topical_fit(mesh: Column, text: Column, names: Column, query_terms: list[str], query_text: str) -> Column:
    """Cosine of term sets (0.7) and share of the query's longer words in the evidence (0.3); words only, over
    names as well, if a candidate has no terms."""
    words = sorted({w.lower() for w in query_text.split() if len(w) > 3})
    terms = list(dict.fromkeys(query_terms))
    counts = [query_terms.count(t) for t in terms]
    norm = float(np.sqrt(sum(n * n for n in counts))) or 1.0
    own = F.array_distinct(mesh)
    dot = reduce(lambda a, b: a + b, [F.array_contains(own, t).cast("double") * (n / norm) for t, n in zip(terms, counts, strict=True)], F.lit(0.0))
    cosine = F.least(F.lit(1.0), dot / F.sqrt(F.size(own).cast("double")))
    share = lambda x: reduce(
        lambda a, b: a + b,
        [F.lower(x).contains(w).cast("double") for w in words],
        F.lit(0.0),
    ) / max(len(words), 1)
    return F.when(F.size(own) > 0, 0.7 * cosine + 0.3 * share(text)).otherwise(share(F.concat_ws(" ", names, text)))
