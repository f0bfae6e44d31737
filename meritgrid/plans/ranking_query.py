"""The flagship: from a query's terms to the top k candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgrid.functions.positions import midpoint_percentiles
from meritgrid.operators import features, ranking
from meritgrid.plans import standins

QUERY_TERMS = ["PROMO", "ECONOMY"]
REFERENCE_DAY = "1999-01-01"
WEIGHTS = {"f1_rcr": 0.5, "f2_funding": 0.5}


def rank_experts(papers: DataFrame, grants: DataFrame, cohort: DataFrame, terms: dict[str, float], reference: str, k: int = 50) -> DataFrame:
    """Features of the cohort, quality prior, topical fit and recency for the terms, final score, the top k."""
    impact = features.citation_impact(papers).select(F.lit("f1_rcr").alias("which"), "uuid", features.citation_score().alias("score"))
    money = features.funding(grants).select(F.lit("f2_funding").alias("which"), "uuid", features.funding_score().alias("score"))
    shares = midpoint_percentiles(impact.unionByName(money), "uuid")
    families = shares.groupBy("uuid").agg(*(F.max(F.when(F.col("which") == k, F.round("percentile", 6))).alias(k) for k in WEIGHTS))
    quality = ranking.quality_prior(cohort.select("uuid").join(families, "uuid", "left"), WEIGHTS)
    vectors = ranking.topic_vectors(papers.select("uuid", "author_weight", F.array("term").alias("terms")), F.col("author_weight"))
    fit = ranking.topical_fit(vectors, ranking.query_vector(terms))
    fresh = ranking.recency(
        papers.select(
            "uuid",
            "published",
            F.col("author_weight").alias("role_weight"),
            F.lit(0.01).alias("type_weight"),
            F.lit(False).alias("is_preprint"),
            F.array("term").alias("terms"),
        ),
        list(terms),
        F.lit(reference).cast("date"),
    )
    scores = quality.select("uuid", F.col("percentile").alias("quality")).join(fit, "uuid").join(fresh, "uuid")
    rows = scores.select(
        "uuid",
        F.lit(1.0).alias("integrity"),
        "quality",
        F.col("topical_fit").alias("topical"),
        "recency",
        F.lit(False).alias("is_hard_zero"),
    )
    return ranking.ranked(rows, k)


def rank_topk(spark: SparkSession, d: str) -> DataFrame:
    papers = standins.papers(spark, d)
    top = rank_experts(papers, standins.grants(spark, d), standins.candidates(spark, d), dict.fromkeys(QUERY_TERMS, 1.0), REFERENCE_DAY)
    return top.select(
        "rank",
        "uuid",
        F.round("quality", 6).alias("quality"),
        F.round("topical", 6).alias("topical"),
        F.round("recency", 6).alias("recency"),
        "score",
    )
