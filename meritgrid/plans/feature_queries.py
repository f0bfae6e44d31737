"""Queries over features, percentiles and the ranking, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgrid.functions import positions
from meritgrid.operators import features, ranking
from meritgrid.plans import standins
from meritgrid.plans.ranking_query import REFERENCE_DAY, rank_topk
from meritgrid.plans.standins import GRANTS_SQL, PAPERS_SQL


#: Mean and covariance of the exponents, and draws, of the bands.
BANDS = ((0.7, 1.0, 0.4), [[0.01, 0.0, 0.0], [0.0, 0.01, 0.0], [0.0, 0.0, 0.01]], 50)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def percentile_midpoint(spark: SparkSession, d: str) -> DataFrame:
    rows = standins.candidates(spark, d).select("uuid", "balance")
    return _rounded(positions.midpoint_percentile(rows, "balance", "uuid"), 8, "percentile")


def percentile_span(spark: SparkSession, d: str) -> DataFrame:
    rows = standins.candidates(spark, d).select("uuid", "balance")
    return _rounded(positions.span_percentile(rows, "balance", "uuid"), 8, "percentile")


def percentile_below(spark: SparkSession, d: str) -> DataFrame:
    orders = standins.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("uuid"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("score"),
    )
    return positions.below_share(orders, "score").select("uuid", "score", "percentile")


def citation_impact(spark: SparkSession, d: str) -> DataFrame:
    return features.citation_percentile(features.citation_impact(standins.papers(spark, d).select("uuid", "rcr", "author_weight", "article_type")))


def funding(spark: SparkSession, d: str) -> DataFrame:
    return features.funding_percentile(features.funding(standins.grants(spark, d)))


def leadership(spark: SparkSession, d: str) -> DataFrame:
    p = standins.papers(spark, d)
    roles = p.groupBy("uuid").agg(
        F.count(F.lit(1)).alias("total_papers"),
        F.count_if(F.col("position") == "last").alias("last_author_papers"),
        F.count_if(F.col("position") == "first").alias("corresponding_author_papers"),
        F.countDistinct("term").alias("trial_pi_roles"),
        (F.countDistinct("work") % 3).alias("trial_chair_roles"),
        (F.max("work") % 2 == 0).alias("has_editorial_role"),
    )
    return _rounded(
        features.leadership_percentile(features.leadership(roles)),
        6,
        "last_author_rate",
        "corresponding_author_rate",
        "trial_pi_count",
        "percentile",
    )


def membership(spark: SparkSession, d: str) -> DataFrame:
    rows = standins.candidates(spark, d).select("uuid", (F.col("uuid") % 8).alias("membership_count"))
    return _rounded(features.membership(rows), 8, "percentile")


def translational(spark: SparkSession, d: str) -> DataFrame:
    rows = standins.candidates(spark, d).select(
        "uuid", (F.col("uuid") % 5).alias("fda_submission_count"), (F.col("uuid") % 7).alias("phase2plus_trial_count"),
            (F.col("uuid") % 11 == 0).alias("is_nccn_panel_member")
    )
    return _rounded(features.translational(rows), 6, "composite")


def lineage(spark: SparkSession, d: str) -> DataFrame:
    rows = standins.candidates(spark, d).select(
        "uuid", (F.col("uuid") % 13).alias("traceable_trainee_count"), (F.col("uuid") % 6).alias("r01_trainee_count"),
            ((F.col("uuid") % 10) / 10.0).alias("aft_link_confidence")
    )
    return _rounded(features.lineage(rows), 6, "composite")


def clinician(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("uuid")
    severity = F.when(u % 5 == 0, "suspension").when(u % 5 == 1, "probation").when(u % 5 == 2, "public_reprimand")
    rows = standins.candidates(spark, d).select(
        "uuid",
        (u % 3 != 0).alias("is_board_certified"),
        (u % 2 == 0).alias("has_moc"),
        (u % 4).alias("certification_count"),
        (u % 7 != 0).alias("has_active_license"),
        (u % 6 == 0).alias("has_disciplinary_action"),
        severity.alias("action_severity"),
        (u % 4).cast("int").alias("hospital_tier"),
        F.when(u % 3 == 0, u % 9).alias("specialty_rank"),
        (u % 8).alias("trial_pi_count"),
        F.array((u % 4).cast("int")).alias("trial_phases"),
        (u % 700).alias("total_procedures"),
        (u % 10 != 0).alias("procedure_volume_available"),
    )
    return features.clinician(rows)


def quality_prior(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("uuid")
    rows = standins.candidates(spark, d).select(
        "uuid",
        ((u % 97) / 97.0).alias("f1_rcr"),
        ((u % 89) / 89.0).alias("f2_funding"),
        ((u % 83) / 83.0).alias("f3_leadership"),
    )
    weights = {"f1_rcr": 0.45, "f2_funding": 0.20, "f3_leadership": 0.20, "f4_apex": 0.0, "f5_translational": 0.05, "f6_lineage": 0.10}
    return ranking.quality_prior(rows, weights).select("uuid", "raw_score")


def topical_fit(spark: SparkSession, d: str) -> DataFrame:
    p = standins.papers(spark, d)
    vectors = ranking.topic_vectors(p, F.col("author_weight"))
    return _rounded(ranking.topical_fit(vectors, ranking.query_vector({"PROMO": 1.0, "Brand#12": 2.0})), 6, "topical_fit")


def topical_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector to the mean vector of its label: the mean is built by component, so that it is combined
    before the shuffle, and there is one of them a label."""
    e = standins.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    size = F.size("v")
    mean = e.select(
        "label",
        F.posexplode("v").alias("i", "x"),
    ).groupBy(
        "label",
        "i",
    ).agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v, c = F.col("v"), F.col("c")
    return e.where(size > 0).join(mean, "label").select("vec_id", "label", F.round(dot(v, c) / F.sqrt(dot(v, v) * dot(c, c)), 6).alias("cosine"))


def recency(spark: SparkSession, d: str) -> DataFrame:
    p = standins.papers(spark, d)
    rows = p.select(
        "uuid",
        "published",
        F.col("author_weight").alias("role_weight"),
        F.lit(0.2).alias("type_weight"),
        (F.col("article_type") == "Letter").alias("is_preprint"),
        "terms",
    )
    return _rounded(ranking.recency(rows, ["PROMO", "Brand#3"], F.lit(REFERENCE_DAY).cast("date")), 6, "recency")


def linear_recency(spark: SparkSession, d: str) -> DataFrame:
    last = standins.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("uuid")).agg(F.max(F.to_date("o_orderdate")).alias("last"))
    return standins.candidates(spark, d).select("uuid").join(last, "uuid", "left").select(
        "uuid",
        F.round(ranking.linear_recency(F.col("last"), F.lit("2002-01-01").cast("date")), 6).alias("recency"),
    )


def _score_rows(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("uuid")
    return standins.candidates(spark, d).select(
        "uuid", F.when(
            u % 17 == 0,
            0.0,
        ).otherwise(1.0).alias("integrity"), ((u % 97 + 1) / 97.0).alias("quality"), ((u % 31) / 31.0).alias("topical"),
            ((u % 53 + 1) / 53.0).alias("recency"), (u % 23 == 0).alias("is_hard_zero")
    )


def rank_scores(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranked(_score_rows(spark, d), 100).select("rank", "uuid", "score")


def score_bands(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ranking.score_bands(_score_rows(spark, d), *BANDS), 8, "low", "median", "high")


def rerank_client(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rerank(
        _score_rows(spark, d).where("not is_hard_zero"),
        1.2,
        0.5,
        0.8,
    ).limit(50).select("uuid", F.round("rescored", 6).alias("rescored"))


def result_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = _score_rows(spark, d)
    return ranking.result_diff(ranking.ranked(rows, 40), ranking.ranked(rows, 40, alpha=1.2, gamma=0.1))


def live_scoring(spark: SparkSession, d: str) -> DataFrame:
    """The live path's features for customers whose orders and lines are lists of ids."""
    o = standins.table(spark, d, "orders")
    ids = o.groupBy(F.col("o_custkey").alias("uuid")).agg(
        F.collect_list(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string"))).alias("pmids"),
        F.collect_list(F.when(F.col("o_orderkey") % 9 == 0, F.col("o_orderkey").cast("string"))).alias("nct_ids"),
        F.collect_list(
            F.when(
                F.col("o_orderkey") % 7 == 0,
                F.concat(F.when(F.col("o_orderstatus") == "O", "R01").otherwise("K23"), F.col("o_orderkey").cast("string")),
            )
        ).alias("grant_ids"),
    )
    c = standins.candidates(spark, d).join(ids, "uuid").select(
        "uuid", "name", "pmids", "nct_ids", "grant_ids", F.array().cast("array<string>").alias("patent_ids"),
            F.array(F.lit("PI on trial")).alias("evidence_trail"), F.array(
            F.lit("pubmed"),
            "segment",
        ).alias("sources"), F.array(F.lit("City Hospital")).alias("affiliations")
    )
    rcr = o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").cast("string").alias("pmid"), (F.col("o_totalprice") / 100000.0).alias("rcr"))
    apex = standins.candidates(spark, d).where("uuid % 40 = 0").select("name")
    out = ranking.live_features(c, rcr, apex)
    return out.select("uuid", *(F.round(f"f{i}", 6).alias(f"f{i}") for i in range(1, 8)))


QUERIES = {
    f.__name__: f
    for f in (
        rank_topk, percentile_midpoint, percentile_span, percentile_below, citation_impact, funding, leadership, membership, translational, lineage,
            clinician,
        quality_prior, topical_fit, topical_embedding, recency, linear_recency, rank_scores, score_bands, rerank_client, result_diff, live_scoring,
    )
}

_IMPACT = """logs AS (SELECT uuid, ln(rcr + 1e-9) * author_weight AS v FROM papers WHERE rcr > 0 AND article_type <> 'Letter'),
 placed AS (SELECT uuid, v, row_number() OVER (PARTITION BY uuid ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY uuid) AS n FROM logs),
 impact AS (SELECT uuid, avg(v) AS mean_log, max(v) FILTER (i = least(floor(n * 0.9), n - 1)) AS top_log, count(*) AS n FROM placed GROUP BY uuid),
 impacts AS (SELECT u.uuid, coalesce(mean_log, 0) AS mean_log, coalesce(top_log, 0) AS top_log, coalesce(n, 0) AS n FROM (SELECT DISTINCT uuid
   FROM papers) u LEFT JOIN impact USING (uuid)),
 f1 AS (SELECT *, (row_number() OVER (ORDER BY 0.6 * mean_log + 0.4 * top_log, uuid) - 0.5) / count(*) OVER () AS p FROM impacts)"""
_FUNDING = """money AS (SELECT uuid, ln(sum(cost * role_weight * CASE code WHEN 'R01' THEN 1.0 WHEN 'K23' THEN 0.6 WHEN 'R21' THEN 0.4
      ELSE 0.2 END::DOUBLE * CASE WHEN active THEN 2.0 ELSE 1.0 END::DOUBLE / pis) + 1) AS cost_log,
   sum(CASE WHEN code = 'R01' AND active THEN role_weight / pis ELSE 0 END) AS r01, count(*) AS n FROM grants GROUP BY uuid),
 f2 AS (SELECT *, (row_number() OVER (ORDER BY 0.7 * cost_log + 0.3 * r01, uuid) - 0.5) / count(*) OVER () AS p FROM money)"""
_SCORES = """scores AS (SELECT c_custkey AS uuid, CASE WHEN c_custkey % 17 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS integrity,
      (c_custkey % 97 + 1) / 97.0::DOUBLE AS quality,
  (c_custkey % 31) / 31.0::DOUBLE AS topical, (c_custkey % 53 + 1) / 53.0::DOUBLE AS recency, c_custkey % 23 = 0 AS hard FROM customer)"""
_DRAWS = ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE, {g!r}::DOUBLE)" for a, b, g in ranking.exponent_draws(*BANDS).tolist())
_TOP = "SELECT row_number() OVER (ORDER BY s DESC, uuid) AS rank, uuid, s FROM (SELECT uuid, integrity * pow(quality, {a}) * (CASE WHEN topical <= 0 THEN 0 ELSE pow(topical, 1.0) END) * pow(recency, {g}) AS s FROM scores WHERE NOT hard AND integrity <> 0) QUALIFY rank <= {k}"

ORACLE_SQL = {
    "percentile_midpoint": """SELECT c_custkey AS uuid, c_acctbal AS balance, round((row_number() OVER (ORDER BY c_acctbal,
          c_custkey) - 0.5) / count(*) OVER (), 8) AS percentile FROM customer""",
    "percentile_span": """SELECT c_custkey AS uuid, c_acctbal AS balance, round((row_number() OVER (ORDER BY c_acctbal,
          c_custkey) - 1)::DOUBLE / greatest(count(*) OVER () - 1, 1), 8) AS percentile FROM customer""",
    "percentile_below": """SELECT o_orderkey AS uuid, floor(o_totalprice / 1000)::BIGINT AS score, round((rank()
          OVER (ORDER BY floor(o_totalprice / 1000)) - 1)::DOUBLE / count(*) OVER (), 4) AS percentile FROM orders""",
    "citation_impact": f"""WITH {PAPERS_SQL}, {_IMPACT} SELECT uuid, round(mean_log, 6) AS mean_rcr_log, round(top_log, 6) AS top_rcr_log,
          n < 10 AS low_confidence, n AS eligible_paper_count, round(p, 6) AS percentile FROM f1""",
    "funding": f"""WITH {GRANTS_SQL}, {_FUNDING} SELECT uuid, round(cost_log, 6) AS total_cost_log, round(r01, 6) AS active_r01_equivalent,
          n AS grant_count, round(p, 6) AS percentile FROM f2""",
    "leadership": f"""WITH {PAPERS_SQL}, r AS (SELECT uuid, count(*) AS n, count(*) FILTER (position = 'last') AS l, count(*)
          FILTER (position = 'first') AS c, count(DISTINCT term) AS t, count(DISTINCT work) % 3 AS ch, max(work) % 2 = 0 AS e FROM papers
            GROUP BY uuid),
      s AS (SELECT uuid, l::DOUBLE / n AS lr, c::DOUBLE / n AS cr, t + 0.7::DOUBLE * ch AS tp, e FROM r)
      SELECT uuid, round(lr, 6) AS last_author_rate, round(tp, 6) AS trial_pi_count, round(cr, 6) AS corresponding_author_rate,
        e AS editorial_role_flag,
        round((row_number() OVER (ORDER BY 0.35::DOUBLE * lr + 0.30::DOUBLE * least(tp / 5.0, 1.0) + 0.25::DOUBLE * cr + 0.10::DOUBLE * e::INT,
          uuid) - 1)::DOUBLE / greatest(count(*) OVER () - 1, 1), 6) AS percentile FROM s""",
    "membership": """WITH s AS (SELECT c_custkey AS uuid, c_custkey % 8 AS n, CASE c_custkey % 8 WHEN 0 THEN 0.0 WHEN 1 THEN 0.4 WHEN 2 THEN 0.65
          WHEN 3 THEN 0.8 WHEN 4 THEN 0.9 ELSE 1.0 END::DOUBLE AS score FROM customer)
      SELECT uuid, n AS membership_count, score, round((row_number() OVER (ORDER BY score, uuid) - 1)::DOUBLE / greatest(count(*) OVER () - 1, 1),
        8) AS percentile FROM s""",
    "translational": """WITH s AS (SELECT c_custkey AS uuid, c_custkey % 5 AS f, c_custkey % 7 AS t, c_custkey % 11 = 0 AS p FROM customer),
          c AS (SELECT *, 0.35::DOUBLE * least(f / 3.0::DOUBLE, 1.0) + 0.40::DOUBLE * least(t / 5.0::DOUBLE, 1.0) + 0.25::DOUBLE * p::INT AS x FROM s)
      SELECT uuid, f AS fda_submission_count, t AS phase2plus_trial_count, p AS is_nccn_panel_member, round(x, 6) AS composite, round((row_number()
        OVER (ORDER BY x, uuid) - 0.5) / count(*) OVER (), 6) AS percentile FROM c""",
    "lineage": """WITH s AS (SELECT c_custkey AS uuid, c_custkey % 13 AS t, c_custkey % 6 AS r, (c_custkey % 10) / 10.0::DOUBLE AS l FROM customer),
          c AS (SELECT *, (0.4::DOUBLE * least(t / 10.0::DOUBLE, 1.0) + 0.6::DOUBLE * least(r / 5.0::DOUBLE, 1.0)) * l AS x FROM s)
      SELECT uuid, t AS traceable_trainee_count, r AS r01_trainee_count, l AS aft_link_confidence, round(x, 6) AS composite, round((row_number()
        OVER (ORDER BY x, uuid) - 0.5) / count(*) OVER (), 6) AS percentile FROM c""",
    "clinician": f"""WITH c AS (SELECT c_custkey AS u, CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 0.7 END::DOUBLE AS base, CASE c_custkey % 4
          WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 WHEN 3 THEN 0.4 ELSE 0.2 END::DOUBLE AS tier,
        least((c_custkey % 8) / 5.0::DOUBLE, 1.0) AS trials FROM customer),
      s AS (SELECT u, (CASE WHEN u % 3 = 0 THEN 0.0 WHEN u % 4 > 1 THEN least(base + 0.1::DOUBLE * (u % 4 - 1), 1.0) ELSE base END)::DOUBLE AS b,
        (CASE WHEN u % 7 = 0 THEN 0.0 WHEN u % 6 <> 0 THEN 1.0 WHEN u % 5 = 0 THEN 0.1 WHEN u % 5 = 1 THEN 0.5 WHEN u % 5 = 2 THEN 0.7
              ELSE 1.0 END)::DOUBLE AS l,
        (CASE WHEN u % 3 = 0 AND u % 9 <= 5 THEN greatest(tier, 0.9) ELSE tier END)::DOUBLE AS h, (CASE WHEN u % 8 = 0 THEN 0.0
              WHEN u % 4 >= 3 THEN least(trials + 0.2::DOUBLE, 1.0) ELSE trials END)::DOUBLE AS t,
        (CASE WHEN u % 10 <> 0 THEN least((u % 700) / 500.0::DOUBLE, 1.0) ELSE 0.0 END)::DOUBLE AS v FROM c),
      k AS (SELECT *, 0.30::DOUBLE * b + 0.15::DOUBLE * l + 0.25::DOUBLE * h + 0.15::DOUBLE * t + 0.15::DOUBLE * v AS x FROM s)
      SELECT u AS uuid, round(b, 4) AS board_certification_score, round(l, 4) AS license_score, round(h, 4) AS hospital_tier_score, round(t,
        4) AS trial_pi_score, round(v, 4) AS procedure_volume_score,
        CASE WHEN u % 10 <> 0 THEN 1.0 ELSE 0.3 END::DOUBLE AS procedure_volume_confidence, CASE
          WHEN u % 10 = 0 THEN '{features.NO_VOLUME_CAVEAT}' END AS coverage_caveat,
        round((row_number() OVER (ORDER BY x, u) - 0.5) / count(*) OVER (), 6) AS percentile FROM k""",
    "score_bands": f"""WITH {_SCORES}, d(a, b, g) AS (VALUES {_DRAWS}), s AS (SELECT uuid, integrity * pow(quality, a) * (CASE
          WHEN topical <= 0 THEN 0 ELSE pow(topical, b) END) * pow(recency, g) AS s FROM scores, d)
      SELECT uuid, round(quantile_cont(s, 0.025), 8) AS low, round(quantile_cont(s, 0.5), 8) AS median, round(quantile_cont(s, 0.975), 8) AS high,
        50 AS n_samples FROM s GROUP BY uuid""",
    "live_scoring": """WITH i AS (SELECT o_custkey AS u, count(*) FILTER (o_orderkey % 2 = 0) AS p, count(*) FILTER (o_orderkey % 9 = 0) AS n,
          count(*) FILTER (o_orderkey % 7 = 0) AS g, count(*) FILTER (o_orderkey % 7 = 0 AND o_orderstatus = 'O') AS r,
        avg(o_totalprice / 100000.0::DOUBLE) FILTER (o_orderkey % 4 = 0) AS rcr FROM orders GROUP BY 1)
      SELECT u AS uuid, round(least(1.0, coalesce(rcr / 5.0, p / 20.0::DOUBLE)), 6) AS f1, round(CASE
        WHEN g > 0 THEN 1 - exp(-(r + 0.6::DOUBLE * (g - r)) / 3.0) ELSE 0 END, 6)::DOUBLE AS f2,
        round(least(1.0, (1 + least(n, 5) * 0.6::DOUBLE + least(g, 5) * 0.4::DOUBLE) / 5.0), 6) AS f3, CASE WHEN u % 40 = 0 THEN 1.0
          ELSE 0.0 END::DOUBLE AS f4, round(least(1.0, n / 5.0::DOUBLE), 6) AS f5,
        round(least(1.0, (2 * 0.6::DOUBLE + ((p > 0)::INT + (n > 0)::INT + (g > 0)::INT) * 0.4::DOUBLE) / 3.0), 6) AS f6, round(least(1.0,
          ((g - r) / 3.0::DOUBLE + (n > 0)::INT + 1) / 3.0), 6) AS f7 FROM i JOIN customer ON c_custkey = u""",
    "quality_prior": """SELECT c_custkey AS uuid, round(exp(0.45 * ln(greatest((c_custkey % 97) / 97.0::DOUBLE,
          0.01)) + 0.20 * ln(greatest((c_custkey % 89) / 89.0::DOUBLE, 0.01)) + 0.20 * ln(greatest((c_custkey % 83) / 83.0::DOUBLE,
                0.01)) + 0.05 * ln(0.01) + 0.10 * ln(0.01)), 8) AS raw_score FROM customer""",
    "topical_fit": f"""WITH {PAPERS_SQL}, w AS (SELECT uuid, t, sum(author_weight) AS w FROM (SELECT uuid, author_weight, unnest([term, brand]) AS t
          FROM papers) GROUP BY uuid, t), n AS (SELECT uuid, sqrt(sum(w * w)) AS n FROM w GROUP BY uuid)
      SELECT uuid, round(least(1.0, sum(w / n * CASE t WHEN 'PROMO' THEN 1 ELSE 2 END / sqrt(5.0::DOUBLE))), 6) AS topical_fit FROM w
        JOIN n USING (uuid) WHERE t IN ('PROMO', 'Brand#12') GROUP BY uuid""",
    "topical_embedding": """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
          m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i)
      SELECT vec_id, label, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) AS cosine FROM e JOIN m USING (label, i) GROUP BY vec_id, label""",
    "recency": f"""WITH {PAPERS_SQL} SELECT uuid, round(greatest(0.0, least(1.0, 1 - exp(-sum(CASE WHEN term = 'PROMO'
          OR brand = 'Brand#3' THEN author_weight * 0.2::DOUBLE * CASE WHEN article_type = 'Letter' THEN 0.6
            ELSE 1.0 END::DOUBLE * exp(-(DATE '{REFERENCE_DAY}' - published) / 365.25::DOUBLE / (3.0 / ln(2.0))) ELSE 0 END) / 3.0))), 6) AS recency
              FROM papers GROUP BY uuid""",
    "linear_recency": """SELECT c_custkey AS uuid, round(coalesce(least(1.0, greatest(0.1,
          1.0 - (DATE '2002-01-01' - max(o_orderdate::DATE)) / 1825.0::DOUBLE)), 0.5), 6) AS recency FROM customer LEFT
                JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "rank_scores": f"WITH {_SCORES}, r AS ({_TOP.format(a=0.7, g=0.4, k=100)}) SELECT rank::INT AS rank, uuid, round(s, 8) AS score FROM r",
    "rerank_client": f"""WITH {_SCORES} SELECT uuid, round(pow(quality, 1.2) * pow(topical, 0.5) * pow(recency, 0.8), 6) AS rescored FROM scores
          WHERE NOT hard ORDER BY pow(quality, 1.2) * pow(topical, 0.5) * pow(recency, 0.8) DESC, uuid LIMIT 50""",
    "result_diff": f"""WITH {_SCORES}, o AS ({_TOP.format(a=0.7, g=0.4, k=40)}), n AS ({_TOP.format(a=1.2, g=0.1, k=40)})
      SELECT uuid, o.rank::INT AS old_rank, n.rank::INT AS new_rank, CASE WHEN o.rank IS NULL THEN 'new' WHEN n.rank IS NULL THEN 'gone'
        WHEN n.rank < o.rank THEN 'up' WHEN n.rank > o.rank THEN 'down' ELSE 'same' END AS change FROM o FULL JOIN n USING (uuid)""",
    "rank_topk": f"""WITH {PAPERS_SQL}, {GRANTS_SQL}, {_IMPACT}, {_FUNDING},
      q AS (SELECT c_custkey AS uuid, exp(0.5 * ln(greatest(coalesce(round(f1.p, 6), 0), 0.01)) + 0.5 * ln(greatest(coalesce(round(f2.p, 6), 0),
        0.01))) AS raw FROM customer LEFT JOIN f1 ON f1.uuid = c_custkey LEFT JOIN f2 ON f2.uuid = c_custkey),
      qp AS (SELECT uuid, round((row_number() OVER (ORDER BY raw, uuid) - 0.5) / count(*) OVER (), 6)::DOUBLE AS quality FROM q),
      w AS (SELECT uuid, term, sum(author_weight) AS w FROM papers GROUP BY uuid, term), n AS (SELECT uuid, sqrt(sum(w * w)) AS n FROM w
        GROUP BY uuid),
      t AS (SELECT uuid, least(1.0, sum(w / n / sqrt(2.0::DOUBLE))) AS topical FROM w JOIN n USING (uuid) WHERE term IN ('PROMO', 'ECONOMY')
        GROUP BY uuid),
      r AS (SELECT uuid, greatest(0.0, least(1.0, 1 - exp(-sum(CASE WHEN term IN ('PROMO',
        'ECONOMY') THEN author_weight * 0.01::DOUBLE * exp(-(DATE '{REFERENCE_DAY}' - published) / 365.25::DOUBLE / (3.0 / ln(2.0)))
              ELSE 0 END) / 3.0))) AS recency FROM papers GROUP BY uuid),
      s AS (SELECT uuid, quality, topical, recency, pow(quality, 0.7) * topical * pow(recency, 0.4) AS score FROM qp JOIN t USING (uuid)
        JOIN r USING (uuid))
      SELECT (row_number() OVER (ORDER BY score DESC, uuid))::INT AS rank, uuid, round(quality, 6) AS quality, round(topical, 6) AS topical,
        round(recency, 6) AS recency, round(score, 8) AS score FROM s QUALIFY rank <= 50""",
}
