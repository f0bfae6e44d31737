"""The seven quality features of a candidate, raw and as percentiles of the cohort.

Every function takes rows with a `uuid` column and returns one row per uuid. A percentile is positional; ties
go by uuid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.functions.positions import midpoint_percentile, span_percentile

# Weights, caps and word lists that define the features.
AUTHOR_WEIGHTS = {"last": 1.0, "corresponding": 1.0, "first": 0.7, "middle": 0.3}
NOT_RESEARCH = ["Editorial", "Letter", "Published Erratum", "Corrected and Republished Article", "Comment"]
FEW_PAPERS = 10
CONTACT_ROLES = ["contact pi", "contact pi/project leader"]
SHARED_ROLES = ["multi-pi", "co-pi", "multi-pi/co-pi"]
LARGE_GRANTS = ["R01", "U01", "P01"]
SMALL_GRANTS = ["R03", "R21"]
MEMBERSHIP_STEPS = {1: 0.4, 2: 0.65, 3: 0.8, 4: 0.9}
CHAIR_WEIGHT = 0.7
HOSPITAL_TIERS = {1: 1.0, 2: 0.7, 3: 0.4}
NO_VOLUME_CAVEAT = "Procedure volume data unavailable; score based on available signals only"


def _starts(column: Column, prefixes: list[str]) -> Column:
    return column.rlike("^(" + "|".join(prefixes) + ")")


def citation_impact(papers: DataFrame) -> DataFrame:
    """From (uuid, rcr, author_weight, article_type): mean and 90 % order statistic of weighted log ratios.

    The order statistic is an element of the sorted values, found by counting positions in a window per uuid,
    so that no candidate's papers are gathered in an array.
    """
    from pyspark.sql import Window as W

    used = papers.where((F.col("rcr") > 0) & ~F.coalesce(F.col("article_type").isin(NOT_RESEARCH), F.lit(False)))
    value = used.select("uuid", (F.log(F.col("rcr") + 1e-9) * F.col("author_weight")).alias("v"))
    by_uuid = W.partitionBy("uuid")
    placed = value.select(
        "uuid", "v", (F.row_number().over(by_uuid.orderBy("v")) - 1).alias("i"), F.count(F.lit(1)).over(by_uuid).alias("n")
    )
    top = F.least(F.floor(F.col("n") * F.lit(0.9)), F.col("n") - 1)
    scored = placed.groupBy("uuid").agg(
        F.avg("v").alias("mean_rcr_log"), F.max(F.when(F.col("i") == top, F.col("v"))).alias("top_rcr_log"), F.count(F.lit(1)).alias("papers")
    )
    everyone = papers.select("uuid").distinct().join(scored, "uuid", "left")
    return everyone.select(
        "uuid",
        F.coalesce("mean_rcr_log", F.lit(0.0)).alias("mean_rcr_log"),
        F.coalesce("top_rcr_log", F.lit(0.0)).alias("top_rcr_log"),
        (F.coalesce("papers", F.lit(0)) < FEW_PAPERS).alias("low_confidence"),
        F.coalesce("papers", F.lit(0)).alias("eligible_paper_count"),
    )


def citation_score() -> Column:
    return 0.6 * F.col("mean_rcr_log") + 0.4 * F.col("top_rcr_log")


def citation_percentile(raw: DataFrame) -> DataFrame:
    scored = raw.withColumn("_c", citation_score())
    out = midpoint_percentile(scored, "_c", "uuid").drop("_c")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_rcr_log", "top_rcr_log", "percentile")})


def funding(grants: DataFrame) -> DataFrame:
    """From (uuid, activity_code, pi_role, total_cost, is_active, pi_count): weighted cost, active large grants."""
    role, code = F.lower(F.trim("pi_role")), F.upper(F.trim("activity_code"))
    role_weight = F.when(role.isin(CONTACT_ROLES), 1.0).when(role.isin(SHARED_ROLES), 0.7).otherwise(0.3)
    large = _starts(code, LARGE_GRANTS)
    type_weight = F.when(large, 1.0).when(code.startswith("K"), 0.6).when(_starts(code, SMALL_GRANTS), 0.4).otherwise(0.2)
    share = 1.0 / F.greatest(F.col("pi_count"), F.lit(1))
    cost = F.coalesce(F.col("total_cost"), F.lit(0)).cast("double")
    return (
        grants.groupBy("uuid")
        .agg(
            F.sum(cost * role_weight * type_weight * F.when(F.col("is_active"), 2.0).otherwise(1.0) * share).alias("_cost"),
            F.sum(F.when(large & F.col("is_active"), share * role_weight).otherwise(0.0)).alias("active_r01_equivalent"),
            F.count(F.lit(1)).alias("grant_count"),
        )
        .select("uuid", F.log(F.col("_cost") + 1.0).alias("total_cost_log"), "active_r01_equivalent", "grant_count")
    )


def funding_score() -> Column:
    return 0.7 * F.col("total_cost_log") + 0.3 * F.col("active_r01_equivalent")


def funding_percentile(raw: DataFrame) -> DataFrame:
    scored = raw.withColumn("_c", funding_score())
    out = midpoint_percentile(scored, "_c", "uuid").drop("_c")
    return out.withColumns({c: F.round(c, 6) for c in ("total_cost_log", "active_r01_equivalent", "percentile")})


def mechanism_weight(code: Column) -> Column:
    """The five-tier weight by grant mechanism of the live scoring path.

    Fixed values; the tiers differ from those of `funding`.
    """
    c = F.upper(F.trim(code))
    return (
        F.when(_starts(c, ["R01", "R37", "U01", "P01", "DP2"]), 1.0)
        .when(c.startswith("K"), 0.6)
        .when(_starts(c, ["R03", "R21", "R15"]), 0.4)
        .when(_starts(c, ["R", "U", "P", "T", "F"]), 0.3)
        .otherwise(0.2)
    )


def leadership(roles: DataFrame) -> DataFrame:
    """From paper and trial role counts: rates and weighted trial roles; no papers give rates of 0."""
    none = F.col("total_papers") == 0
    return roles.select(
        "uuid",
        F.when(none, 0.0).otherwise(F.col("last_author_papers") / F.col("total_papers")).alias("last_author_rate"),
        (F.col("trial_pi_roles") + F.lit(CHAIR_WEIGHT) * F.col("trial_chair_roles")).alias("trial_pi_count"),
        F.when(none, 0.0).otherwise(F.col("corresponding_author_papers") / F.col("total_papers")).alias("corresponding_author_rate"),
        F.col("has_editorial_role").alias("editorial_role_flag"),
    )


def leadership_percentile(raw: DataFrame) -> DataFrame:
    composite = (
        0.35 * F.col("last_author_rate")
        + 0.30 * F.least(F.col("trial_pi_count") / 5.0, F.lit(1.0))
        + 0.25 * F.col("corresponding_author_rate")
        + 0.10 * F.col("editorial_role_flag").cast("double")
    )
    return span_percentile(raw.withColumn("_c", composite), "_c", "uuid").drop("_c")


def membership_score(count: Column) -> Column:
    """A step table of society memberships; five or more are 1."""
    out = F.when(count <= 0, 0.0)
    for n, score in MEMBERSHIP_STEPS.items():
        out = out.when(count == n, score)
    return out.otherwise(1.0)


def membership(rows: DataFrame) -> DataFrame:
    """From (uuid, membership_count): score and percentile."""
    return span_percentile(rows.withColumn("score", membership_score(F.col("membership_count"))), "score", "uuid")


def translational_score(fda: Column, trials: Column, panel: Column) -> Column:
    return 0.35 * F.least(fda / 3.0, F.lit(1.0)) + 0.40 * F.least(trials / 5.0, F.lit(1.0)) + 0.25 * panel.cast("double")


def translational(rows: DataFrame) -> DataFrame:
    """From (uuid, fda_submission_count, phase2plus_trial_count, is_nccn_panel_member)."""
    score = translational_score(F.col("fda_submission_count"), F.col("phase2plus_trial_count"), F.col("is_nccn_panel_member"))
    out = midpoint_percentile(rows.withColumn("composite", score), "composite", "uuid")
    return out.withColumn("percentile", F.round("percentile", 6))


def lineage(rows: DataFrame) -> DataFrame:
    """From (uuid, traceable_trainee_count, r01_trainee_count, aft_link_confidence)."""
    trainees = 0.4 * F.least(F.col("traceable_trainee_count") / 10.0, F.lit(1.0))
    funded = 0.6 * F.least(F.col("r01_trainee_count") / 5.0, F.lit(1.0))
    scored = rows.withColumn("composite", (trainees + funded) * F.col("aft_link_confidence"))
    return midpoint_percentile(scored, "composite", "uuid").withColumn("percentile", F.round("percentile", 6))


def clinician(rows: DataFrame) -> DataFrame:
    """From certification, licence, hospital, trial and volume facts: five part scores and a percentile."""
    more = 0.1 * (F.col("certification_count") - 1)
    base = F.when(F.col("has_moc"), 1.0).otherwise(0.7)
    board = F.when(~F.col("is_board_certified"), 0.0).when(F.col("certification_count") > 1, F.least(base + more, F.lit(1.0))).otherwise(base)
    severity = F.col("action_severity")
    licence = (
        F.when(~F.col("has_active_license"), 0.0)
        .when(~F.col("has_disciplinary_action"), 1.0)
        .when(severity.isin("revocation", "suspension"), 0.1)
        .when(severity.isin("restriction", "probation"), 0.5)
        .when(severity == "public_reprimand", 0.7)
        .otherwise(1.0)
    )
    tier = F.lit(None).cast("double")
    for n, score in HOSPITAL_TIERS.items():
        tier = F.coalesce(tier, F.when(F.col("hospital_tier") == n, score))
    tier = F.coalesce(tier, F.lit(0.2))
    hospital = F.when(F.col("specialty_rank") <= 5, F.greatest(tier, F.lit(0.9))).otherwise(tier)
    trials = F.least(F.col("trial_pi_count") / 5.0, F.lit(1.0))
    late = F.exists("trial_phases", lambda p: p >= 3)
    trial = F.when(F.col("trial_pi_count") <= 0, 0.0).when(late, F.least(trials + 0.2, F.lit(1.0))).otherwise(trials)
    known = F.col("procedure_volume_available")
    parts = {
        "board_certification_score": board,
        "license_score": licence,
        "hospital_tier_score": hospital,
        "trial_pi_score": trial,
        "procedure_volume_score": F.when(known, F.least(F.col("total_procedures") / 500.0, F.lit(1.0))).otherwise(0.0),
        "procedure_volume_confidence": F.when(known, 1.0).otherwise(0.3),
    }
    scored = rows.select("uuid", *(v.alias(k) for k, v in parts.items()), F.when(~known, NO_VOLUME_CAVEAT).alias("coverage_caveat"))
    composite = (
        0.30 * F.col("board_certification_score")
        + 0.15 * F.col("license_score")
        + 0.25 * F.col("hospital_tier_score")
        + 0.15 * F.col("trial_pi_score")
        + 0.15 * F.col("procedure_volume_score")
    )
    out = midpoint_percentile(scored.withColumn("_c", composite), "_c", "uuid").drop("_c")
    return out.withColumns({k: F.round(k, 4) for k in parts} | {"percentile": F.round("percentile", 6)})
