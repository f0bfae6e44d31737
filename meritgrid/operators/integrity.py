"""Integrity: exclusion lists, the ladder of hard gates, retraction triage, predatory load, soft discounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists, weights, floors and thresholds of the rules.
TRIAGE_WORDS = [
    ("fabrication", ["fabricat", "made up"]),
    ("falsification", ["falsif", "manipulat", "image manipulation"]),
    ("honest_error", ["honest error", "inadvertent"]),
    ("duplicate_publication", ["overlapping publication"]),
]
TRIAGE_DISCOUNTS = {
    "fabrication": 0.0,
    "falsification": 0.0,
    "honest_error": 0.85,
    "duplicate_publication": 0.7,
    "no_statement": 0.6,
    "unclassifiable": 0.7,
}
HARD_SEVERITIES = ["fabrication", "falsification"]
SUBDOMAIN_OVERLAP = 0.6
POSITION_WEIGHTS = {"last": 1.0, "first": 0.8}
OTHER_POSITION = 0.5
PREDATORY_FLOOR, RETRACTION_FLOOR, PAPERMILL_FACTOR = 0.5, 0.4, 0.7
TORTURED_PHRASES = [
    "counterfeit writing",
    "sham composition",
    "neural system",
    "profound learning",
    "huge portions",
    "counterfeit neural organization",
    "irregular conduct",
    "area of start",
    "particular go",
    "arbitrary forest",
    "help vector machine",
    "calculated motion",
    "hereditary calculation",
    "calculated complexity",
    "enormous information",
    "back brain network",
    "fluffy rationale",
    "component extraction",
    "property extraction",
    "information mining",
    "straight relapse",
    "calculated relapse",
    "principal worth disintegration",
]


def excluded(candidates: DataFrame, leie: DataFrame) -> DataFrame:
    """`candidates` (uuid, name, npi) with `leie_excluded`: false without a match, null if any match is
    reinstated, else true. A candidate with an NPI that is listed is matched by it, otherwise by name, written
    as "First Last" or "Last, First". Lists are joined by their key, so any size will do."""
    first, last = F.lower("first_name"), F.lower("last_name")
    back = F.col("reinstate_date").isNotNull()
    state = lambda key, as_: leie.where(key.isNotNull() & (key != "")).groupBy(key.alias("_k")).agg(F.max(back).alias(as_))
    by_npi = state(F.col("npi"), "_npi")
    names = leie.select(F.explode(F.array(F.concat(first, F.lit(" "), last), F.concat(last, F.lit(", "), first))).alias("_k"), back.alias("_b"))
    by_name = names.groupBy("_k").agg(F.max("_b").alias("_name"))
    joined = candidates.join(by_npi, candidates["npi"] == by_npi["_k"], "left").drop("_k")
    joined = joined.withColumn("_n", F.lower("name")).join(by_name.withColumnRenamed("_k", "_n"), "_n", "left").drop("_n")
    reinstated = F.coalesce("_npi", "_name")
    return joined.withColumn("leie_excluded", F.when(reinstated.isNull(), False).when(~reinstated, True)).drop("_npi", "_name")


def listed(candidates: DataFrame, sanctions: DataFrame) -> DataFrame:
    """`candidates` with `sanctioned`: the name equals a primary name or an alias, whatever the case."""
    names = sanctions.select(F.explode(F.array_union(F.array("primary_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_x"))
    names = names.select(F.lower("_x").alias("_n")).distinct().withColumn("sanctioned", F.lit(True))
    out = candidates.withColumn("_n", F.lower("name")).join(names, "_n", "left").drop("_n")
    return out.withColumn("sanctioned", F.coalesce("sanctioned", F.lit(False)))


def recent_finding(candidates: DataFrame, findings: DataFrame, as_of: Column, years: int = 10) -> DataFrame:
    """`candidates` with `recent_finding`: a misconduct finding under the name within so many years. From 29
    February the bound falls on the 28th in years without one."""
    recent = findings.where(F.col("finding_date") >= F.add_months(as_of, -12 * years))
    names = recent.select(F.lower("name").alias("_n")).distinct().withColumn("recent_finding", F.lit(True))
    out = candidates.withColumn("_n", F.lower("name")).join(names, "_n", "left").drop("_n")
    return out.withColumn("recent_finding", F.coalesce("recent_finding", F.lit(False)))


def triage_severity(notice: Column) -> Column:
    """The severity that a retraction notice states, by the first list with a word in it."""
    text = F.lower(F.coalesce(notice, F.lit("")))
    out = None
    for severity, words in TRIAGE_WORDS:
        hit = reduce(lambda a, b: a | b, [text.contains(w) for w in words])
        out = F.when(hit, severity) if out is None else out.when(hit, severity)
    return out.when(F.trim(text) == "", "no_statement").otherwise("unclassifiable")


def triage_confidence(severity: Column) -> Column:
    return F.when(severity == "no_statement", 0.9).when(severity == "unclassifiable", 0.5).otherwise(0.8)


def triage_discount(severity: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in TRIAGE_DISCOUNTS.items() for x in kv))[severity]


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets of strings; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def hard_gate(candidates: DataFrame, notices: DataFrame, query_terms: list[str]) -> DataFrame:
    """The ladder over candidates that carry leie_excluded, sanctioned, recent_finding and terms: is_zero, reason
    and the number of rules looked at. `notices` (uuid, pmid, notice) are those of each candidate's papers."""
    grave = notices.withColumn("severity", triage_severity(F.col("notice"))).where(F.col("severity").isin(HARD_SEVERITIES))
    worst = grave.groupBy("uuid").agg(F.min(F.struct("pmid", "severity")).alias("_w"))
    wanted = F.array(*(F.lit(t) for t in query_terms)) if query_terms else F.array().cast("array<string>")
    joined = candidates.join(worst, "uuid", "left")
    near = F.col("_w").isNotNull() & (jaccard(F.coalesce("terms", F.array().cast("array<string>")), wanted) >= SUBDOMAIN_OVERLAP)
    rules = [
        (F.coalesce("leie_excluded", F.lit(False)), F.lit("LEIE federal exclusion")),
        (F.col("sanctioned"), F.lit("OFAC/SAM listing")),
        (F.col("recent_finding"), F.lit("ORI misconduct finding (10yr)")),
        (near, F.concat(F.lit("retraction ("), F.col("_w.severity"), F.lit(") in subdomain"))),
    ]
    reason, count = F.lit(None).cast("string"), F.lit(5)
    for number, (test, text) in reversed(list(enumerate(rules, start=1))):
        reason, count = F.when(test, text).otherwise(reason), F.when(test, number).otherwise(count)
    return joined.withColumn("reason", reason).withColumn("rules_evaluated", count).withColumn("is_zero", F.col("reason").isNotNull()).drop("_w")


def predatory(medline: Column, doaj: Column, cabells: Column, flags: Column) -> Column:
    return ~medline & (cabells | (~doaj & (F.size(flags) >= 2)))


def predatory_load(papers: DataFrame) -> DataFrame:
    """(uuid, predatory_load): the weighted share of predatory papers, from (uuid, is_predatory, position)."""
    weight = F.when(F.col("position") == "last", POSITION_WEIGHTS["last"]).when(
        F.col("position") == "first",
        POSITION_WEIGHTS["first"],
    ).otherwise(OTHER_POSITION)
    return papers.groupBy("uuid").agg((F.sum(F.when(F.col("is_predatory"), weight).otherwise(0.0)) / F.sum(weight)).alias("predatory_load"))


def tortured_phrases(text: Column) -> Column:
    """All of the known reworded phrases in a text, in order; of two at one place the one listed first."""
    return F.regexp_extract_all(text, F.lit("(?i)(" + "|".join(TORTURED_PHRASES) + ")"), F.lit(1))


def papermill(papers: DataFrame) -> DataFrame:
    """`papers` (title, abstract, coordinated_authorship_score) with phrases, their number and the suspicion."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    out = papers.withColumn("phrases", tortured_phrases(text)).withColumn("phrase_count", F.size("phrases"))
    return out.withColumn("suspected", (F.col("phrase_count") >= 2) | (F.coalesce("coordinated_authorship_score", F.lit(0.0)) > 0.7))


def soft_discount(load: Column, retractions: Column, suspected: Column) -> Column:
    """The product of the factors for predatory load, retractions elsewhere and paper-mill signs."""
    by_load = F.when(load > 0, F.greatest(1.0 - load * (1.0 - PREDATORY_FLOOR), F.lit(PREDATORY_FLOOR))).otherwise(1.0)
    by_retraction = F.when(retractions > 0, F.greatest(1.0 - 0.1 * retractions, F.lit(RETRACTION_FLOOR))).otherwise(1.0)
    return by_load * by_retraction * F.when(suspected, PAPERMILL_FACTOR).otherwise(1.0)


def override_active(log: DataFrame) -> DataFrame:
    """(uuid, overridden): whether the latest contest action of a candidate is an override."""
    latest = log.groupBy("uuid").agg(F.max_by("action", F.struct("ts", "seq")).alias("a"))
    return latest.select("uuid", (F.col("a") == "override").alias("overridden"))
