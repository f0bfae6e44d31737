"""What a ranking is shown as: links, evidence, facets, export; and the specialty of a candidate by a trained model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Addresses of artifacts by type, widths of a missing band, and the features of the model.
LINKS = {
    "pmid": "https://pubmed.ncbi.nlm.nih.gov/",
    "nct_id": "https://clinicaltrials.gov/study/",
    "grant": "https://reporter.nih.gov/project-details/",
}
OTHER_LINK = "https://search.crossref.org/?q="
BAND = (0.88, 1.12)
FEATURES = [
    "total_papers", "last_author_rate", "mean_rcr", "rcr_above_2", "total_patents", "lead_inventor_count", "total_grants", "r01_equivalent_count",
        "total_trials",
    "phase3_trials", "has_npi", "has_abms_certification", "has_hospital_affiliation", "procedure_volume",
]
AMBIGUOUS_BELOW = 0.6


def artifact_link(kind: Column, identifier: Column) -> Column:
    base = F.create_map(*(F.lit(x) for kv in LINKS.items() for x in kv))[kind]
    return F.concat(F.coalesce(base, F.lit(OTHER_LINK)), identifier)


def shown(ranked: DataFrame, artifacts: DataFrame, bands: DataFrame, affiliations: DataFrame, most: int = 3) -> DataFrame:
    """The ranked rows with their three strongest artifacts and links, band, and affiliation ("Unknown" without one).
    `artifacts` (uuid, kind, identifier, contribution) are cut to the ranked candidates before they are ordered."""
    own = artifacts.join(ranked.select("uuid"), "uuid", "left_semi")
    top = own.groupBy("uuid").agg(
        F.slice(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        (-F.col("contribution")).alias("d"),
                        "identifier",
                        "kind",
                        artifact_link(F.col("kind"), F.col("identifier")).alias("url"),
                    )
                )
            ),
            1,
            most,
        ).alias("artifacts")
    )
    joined = ranked.join(top, "uuid", "left").join(bands.select("uuid", "low", "high"), "uuid", "left").join(
        affiliations.select("uuid", "affiliation"),
        "uuid",
        "left",
    )
    return joined.withColumns(
        {
            "low": F.coalesce("low", F.col("score") * BAND[0]),
            "high": F.coalesce("high", F.col("score") * BAND[1]),
            "affiliation": F.coalesce("affiliation", F.lit("Unknown")),
        }
    )


def evidence(publications: DataFrame, grants: DataFrame, trials: DataFrame) -> DataFrame:
    """One feed (uuid, category, identifier, contribution, day) of three kinds; a paper's contribution is its citation
    ratio over five, one at most."""
    p = publications.select(
        "uuid",
        F.lit("publication").alias("category"),
        "identifier",
        F.least(F.col("rcr") / 5.0, F.lit(1.0)).alias("contribution"),
        "day",
    )
    g = grants.select("uuid", F.lit("grant").alias("category"), "identifier", F.lit(None).cast("double").alias("contribution"), "day")
    t = trials.select("uuid", F.lit("trial").alias("category"), "identifier", F.lit(None).cast("double").alias("contribution"), "day")
    return p.unionByName(g).unionByName(t)


def facets(feed: DataFrame) -> DataFrame:
    return feed.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uuid").alias("people"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Quotes inside a value are doubled, as spreadsheets expect."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def with_proportions(mix: DataFrame) -> DataFrame:
    total = F.greatest(F.col("total_papers") + F.col("total_patents") + F.col("total_grants") + F.col("total_trials"), F.lit(1))
    out = mix.withColumns({c: F.col(c).cast("double") for c in FEATURES})
    shares = {f"{k}_share": F.col(f"total_{k}") / total for k in ("patents", "grants", "trials")}
    return out.withColumns(shares | {"clinical": F.greatest("has_npi", "has_abms_certification")})


def train_specialty(mix: DataFrame, label: str = "specialty", trees: int = 100, depth: int = 4, seed: int = 42) -> PipelineModel:
    """Boosted trees, one against the rest: trained where the rows are."""
    names = [*FEATURES, "patents_share", "grants_share", "trials_share", "clinical"]
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc")
    trees_ = GBTClassifier(
        maxIter=trees,
        maxDepth=depth,
        stepSize=0.1,
        seed=seed,
        featuresCol="_features",
        labelCol="_label",
    ).setRawPredictionCol("_raw")
    rest = OneVsRest(classifier=trees_, featuresCol="_features", labelCol="_label", rawPredictionCol="_raw", predictionCol="_predicted")
    return Pipeline(stages=[index, VectorAssembler(inputCols=names, outputCol="_features"), rest]).fit(with_proportions(mix))


def classify_specialty(model: PipelineModel, mix: DataFrame) -> DataFrame:
    """(uuid, specialty, confidence, ambiguous): the margins of the classes as probabilities, the largest wins."""
    labels = model.stages[0].labels
    scored = with_proportions(mix)
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    raw = vector_to_array(F.col("_raw"))
    odds = F.transform(raw, lambda x: 1 / (1 + F.exp(-x)))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    name = F.element_at(F.array(*(F.lit(x) for x in labels)), F.col("_predicted").cast("int") + 1)
    return scored.select(
        "uuid",
        name.alias("specialty"),
        F.round(F.array_max(odds) / total, 6).alias("confidence"),
    ).withColumn("ambiguous", F.col("confidence") < AMBIGUOUS_BELOW)
