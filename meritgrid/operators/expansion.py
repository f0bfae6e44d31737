"""From a query's text to vocabulary terms: candidates, lookup, validation, the ladder of methods, crosswalks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meritgrid.operators.identity import longest_prefix

# Words that are not looked up alone, caps and confidences.
STOP_WORDS = ["the", "for", "and", "with", "using", "from", "into", "that", "this", "are"]
LABELS_PER_TERM = 5
FOUND_CONFIDENCE, FALLBACK_CONFIDENCE = 0.8, 0.3
VOCABULARIES = ["mesh", "cpc", "chembl"]
# Terms of the commonest diagnosis and procedure codes, as (descriptor, qualifier, major).
DIAGNOSES = {
    "C34": [("Lung Neoplasms", None, True)],
    "C34.1": [("Carcinoma, Non-Small-Cell Lung", None, True)],
    "C34.9": [("Lung Neoplasms", None, True)],
    "C50": [("Breast Neoplasms", None, True)],
    "C61": [("Prostatic Neoplasms", None, True)],
    "C18": [("Colonic Neoplasms", None, True)],
    "C71": [("Brain Neoplasms", None, True)],
    "C91.0": [("Precursor Cell Lymphoblastic Leukemia-Lymphoma", None, True)],
    "C92.0": [("Leukemia, Myeloid, Acute", None, True)],
    "I21": [("Myocardial Infarction", None, True)],
    "I25": [("Coronary Artery Disease", None, True)],
    "I48": [("Atrial Fibrillation", None, True)],
    "I50": [("Heart Failure", None, True)],
    "R91": [("Solitary Pulmonary Nodule", None, True)],
    "R93": [("Diagnostic Imaging", "abnormal findings", True)],
    "E11": [("Diabetes Mellitus, Type 2", None, True)],
    "E10": [("Diabetes Mellitus, Type 1", None, True)],
    "E05": [("Hyperthyroidism", None, True)],
    "G20": [("Parkinson Disease", None, True)],
    "G30": [("Alzheimer Disease", None, True)],
    "G35": [("Multiple Sclerosis", None, True)],
}
PROCEDURES = {
    "71250": [("Tomography, X-Ray Computed", "methods", True)],
    "71260": [("Tomography, X-Ray Computed", "methods", True), ("Contrast Media", None, False)],
    "71275": [("Computed Tomography Angiography", None, True)],
    "74177": [("Tomography, X-Ray Computed", "methods", True), ("Abdomen", "diagnostic imaging", True)],
    "77065": [("Mammography", None, True)],
    "77066": [("Mammography", None, True)],
    "93000": [("Electrocardiography", None, True)],
    "93306": [("Echocardiography", None, True)],
    "93350": [("Echocardiography, Stress", None, True)],
    "93458": [("Cardiac Catheterization", None, True)],
    "93459": [("Cardiac Catheterization", None, True)],
    "92928": [("Percutaneous Coronary Intervention", None, True)],
    "47600": [("Cholecystectomy", None, True)],
    "44970": [("Appendectomy", None, True)],
    "27447": [("Arthroplasty, Replacement, Knee", None, True)],
    "88305": [("Biopsy", "pathology", True)],
    "88342": [("Immunohistochemistry", None, True)],
    "96413": [("Antineoplastic Agents", "administration & dosage", True)],
    "96415": [("Infusions, Intravenous", None, True)],
}


def code_table(spark: SparkSession, codes: dict[str, list[tuple[str, str | None, bool]]]) -> DataFrame:
    """(code, term, qualifier, major) of a table of codes, for `diagnosis_terms` and `procedure_terms`."""
    rows = [(code, *entry) for code, entries in codes.items() for entry in entries]
    return spark.createDataFrame(rows, "code string, term string, qualifier string, major boolean")


def words(query: Column, longer_than: int) -> Column:
    bare = F.transform(F.split(F.trim(query), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:!?()\[\]]+|[.,;:!?()\[\]]+$", ""))
    return F.filter(bare, lambda w: F.length(w) > longer_than)


def lookup_terms(query: Column) -> Column:
    """The whole query, its pairs of neighbouring words, then single words, each once whatever its case."""
    w = words(query, 2)
    pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
    single = F.filter(w, lambda x: ~F.lower(x).isin(STOP_WORDS))
    every = F.concat(F.array(F.trim(query)), pairs, single)
    lower = F.transform(every, F.lower)
    return F.filter(every, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def _grams(text: Column) -> Column:
    """The pieces of up to three characters of a text."""
    n = F.length(text)
    cut = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))
    return F.array_distinct(F.filter(F.concat(cut(1), cut(2), cut(3)), lambda g: F.length(g) > 0))


def _longest_grams(text: Column) -> Column:
    size = F.least(F.length(text), F.lit(3))
    return F.filter(_grams(text), lambda g: F.length(g) == size)


def expand(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, terms, confidence) from (id, query) and labels (label): for each lookup term the first five labels that
    contain it, in the order of the terms; without any, the query's longer words in title case.

    A label that contains a term has all its pieces of three characters, so term and labels are joined on the piece of
    the term that the fewest labels have; whether a label contains the term is then looked at."""
    asked = queries.select("id", F.posexplode(lookup_terms(F.col("query"))).alias("p", "term")).withColumn("t", F.lower("term"))
    labels = vocabulary.select("label", F.lower("label").alias("l")).distinct()
    pieces = labels.select("label", "l", F.explode(_grams(F.col("l"))).alias("g"))
    often = pieces.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    own = asked.select("t").distinct().select("t", F.explode(_longest_grams(F.col("t"))).alias("g"))
    rarest = own.join(often, "g", "left").groupBy("t").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("m")).where("m.df > 0")
    hits = rarest.select("t", F.col("m.g").alias("g")).join(pieces, "g").where(F.contains("l", "t")).select("t", "label")
    top = hits.withColumn("k", F.row_number().over(W.partitionBy("t").orderBy("label"))).where(F.col("k") <= LABELS_PER_TERM)
    first = asked.join(top, "t").groupBy("id", F.lower("label").alias("l")).agg(F.min(F.struct("p", "k", "label")).alias("m"))
    found = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["label"]).alias("found"))
    fallback = F.transform(words(F.col("query"), 3), F.initcap)
    joined = queries.join(found, "id", "left")
    return joined.select(
        "id",
        F.coalesce("found", fallback).alias("terms"),
        F.when(F.col("found").isNotNull(), FOUND_CONFIDENCE).otherwise(FALLBACK_CONFIDENCE).alias("confidence"),
    )


def validate(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, valid, rejected) from (id, terms): each term is valid if the vocabulary (name, label) has it, whatever its
    case; both lists keep the order of the terms. Unknown vocabularies count for nothing."""
    known = vocabulary.where(F.col("name").isin(VOCABULARIES)).select(F.lower("label").alias("l")).distinct().withColumn("ok", F.lit(True))
    long = terms.select("id", F.posexplode_outer("terms").alias("p", "term")).withColumn("l", F.lower(F.trim("term")))
    marked = long.join(known, "l", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    pick = lambda test: F.transform(
        F.array_sort(F.collect_list(F.when(test & F.col("term").isNotNull(), F.struct("p", "term")))),
        lambda s: s["term"],
    )
    return marked.groupBy("id").agg(pick(F.col("ok")).alias("valid"), pick(~F.col("ok")).alias("rejected"))


def expansion_method(override: Column, proposed: Column, valid: Column) -> tuple[Column, Column]:
    """The method whose terms are used, and whether confidence is low: an override, a model's proposal with a valid
    term, the lookup after a proposal without one, or the lookup alone."""
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    method = F.when(has(override), "override").when(has(proposed) & has(valid), "llm").when(
        has(proposed),
        "llm_fallback_metamap",
    ).otherwise("metamap")
    return method, method.isin("llm_fallback_metamap", "metamap")


def diagnosis_terms(codes: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Diagnosis codes to terms: the code as written, without its dot, or by its longest known prefix."""
    plain = codes.select("code", F.upper(F.trim("code")).alias("dotted")).distinct()
    table = crosswalk.select(F.upper("code").alias("prefix"), "term")
    bare = table.select(F.regexp_replace("prefix", r"\.", "").alias("k"), "term").distinct()
    exact = plain.join(table.withColumnRenamed("prefix", "dotted"), "dotted").select("code", "term", F.lit("exact").alias("via"))
    undotted = plain.withColumn("k", F.regexp_replace("dotted", r"\.", "")).join(bare, "k").select("code", "term", F.lit("undotted").alias("via"))
    rest = plain.join(exact.select("code"), "code", "left_anti").join(undotted.select("code"), "code", "left_anti")
    by_prefix = longest_prefix(rest.select("code"), table, "code", 1).where("term is not null").select("code", "term", F.lit("prefix").alias("via"))
    return exact.unionByName(undotted.join(exact.select("code"), "code", "left_anti")).unionByName(by_prefix)


def procedure_terms(codes: DataFrame, crosswalk: DataFrame) -> DataFrame:
    return codes.withColumn("_c", F.trim("code")).join(crosswalk.withColumnRenamed("code", "_c"), "_c", "left").drop("_c")
