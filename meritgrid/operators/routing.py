"""Weights by specialty, the specialty of a query, fallbacks of weak rankings, and reassignment between runs."""

from __future__ import annotations

import re
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meritgrid.operators.ranking import FAMILIES, LEAST_PERCENTILE

# The specialty of last resort, floors and thresholds.
DEFAULT_SPECIALTY = "translational"
COLLAPSE_FLOOR = 0.05
MAJOR_SHIFT, CHURN_RATE, STABLE_RUNS = 0.3, 0.05, 7
EXPONENTS = ["alpha", "beta", "gamma"]
SHIFT_PERCENT = 20.0


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """Where a path or address of a shared folder is."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", str(path)))


def _text(path: str) -> str:
    fs, at = _place(path)
    with fs.open_input_stream(at) as f:
        return f.read().decode()


def _files(folder: str, specialty: str = "") -> list[str]:
    """The files of vectors (of one specialty) in a folder, by name."""
    fs, at = _place(folder)
    found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    pattern = re.compile(rf"{re.escape(specialty) if specialty else '.*'}_v.*[.]yaml")
    return sorted(f"{folder}/{f.base_name}" for f in found if f.type == pafs.FileType.File and pattern.fullmatch(f.base_name))


def _version(path: str) -> int:
    tail = path.rpartition("_v")[2].removesuffix(".yaml").removesuffix("_pending")
    return int(tail) if tail.isdigit() else -1


def read_vector(path: str) -> dict[str, Any]:
    """A weight vector out of a YAML file, a small file on the driver's side; weights must add up to one."""
    import yaml

    vector = yaml.safe_load(_text(path))
    total = sum(vector["weights"].values())
    if abs(total - 1.0) >= 0.001:
        raise ValueError(f"the weights of {vector['specialty']} add up to {total}")
    unknown = set(vector["weights"]) - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown families of features: {sorted(unknown)}")
    return vector | {"exponent_bounds": vector.get("exponent_bounds") or {}}


def weight_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(specialty, version, created, parameter, value) of all `*_v*.yaml` of a folder: one row a weight or exponent.
    The latest versions are `latest_vectors`, all of them the history that `monitoring.jumps` looks at."""
    rows = []
    for path in _files(folder):
        v = read_vector(path)
        own = [(k, float(x)) for k, x in v["weights"].items()] + [(f"exponent.{k}", float(x)) for k, x in v["exponents"].items()]
        rows += [(v["specialty"], int(v["version"]), str(v.get("created") or ""), k, x) for k, x in own]
    table = spark.createDataFrame(rows, "specialty string, version int, created string, parameter string, value double")
    return table.withColumn("created", F.to_date(F.nullif("created", F.lit(""))))


def latest_vectors(vectors: DataFrame) -> DataFrame:
    """The rows of each specialty's highest version."""
    newest = vectors.groupBy("specialty").agg(F.max("version").alias("version"))
    return vectors.join(newest, ["specialty", "version"])


def write_vector(vector: dict[str, Any], exponents: tuple[float, float, float], folder: str, day: str, staging: bool = False) -> str:
    """The next version of a vector with fitted exponents, as YAML in the folder, or in `staging` below it to wait for
    approval; its path."""
    import yaml

    target = f"{folder}/staging" if staging else folder
    version = max((_version(p) for p in _files(folder, vector["specialty"])), default=0) + 1
    content = {
        "version": version,
        "specialty": vector["specialty"],
        "created": day,
        "weights": dict(vector["weights"]),
        "exponents": {k: round(v, 4) for k, v in zip(EXPONENTS, exponents, strict=True)},
        "exponent_bounds": {k: list(v) for k, v in vector["exponent_bounds"].items()},
    }
    path = f"{target}/{vector['specialty']}_v{version}{'_pending' if staging else ''}.yaml"
    fs, at = _place(target)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(_place(path)[1]) as f:
        f.write(yaml.safe_dump(content).encode())
    return path


def selected_specialty(distribution: Column, asked: Column, available: list[str]) -> Column:
    """What the query asks for if there are weights for it, else the likeliest of the map of probabilities (of equals
    the first entry) if there are weights for that, else the default."""
    best = F.array_max(
        F.transform(F.map_entries(distribution), lambda e, i: F.struct(e["value"].alias("p"), (-i).alias("i"), e["key"].alias("s")))
    )["s"]
    return F.when(asked.isin(available), asked).when(best.isin(available), best).otherwise(F.lit(DEFAULT_SPECIALTY))


def routed_quality(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """`candidates` (specialty and percentiles of families) with raw_score by the weights of their specialty; null
    where there are none. The weights are one row a specialty and join by it."""
    wide = vectors.where(F.col("parameter").isin(FAMILIES)).groupBy("specialty").pivot("parameter", FAMILIES).agg(F.first("value"))
    wide = wide.select("specialty", *(F.coalesce(F.col(f), F.lit(0.0)).alias(f"_w_{f}") for f in FAMILIES))
    raw = F.lit(0.0)
    for family in FAMILIES:
        percentile = F.coalesce(F.col(family), F.lit(0.0)) if family in candidates.columns else F.lit(0.0)
        weight = F.col(f"_w_{family}")
        raw = raw + F.when(weight != 0, weight * F.log(F.greatest(percentile, F.lit(LEAST_PERCENTILE)))).otherwise(0.0)
    joined = candidates.join(wide, "specialty", "left")
    raw_score = F.when(F.col(f"_w_{FAMILIES[0]}").isNotNull(), F.round(F.exp(raw), 8))
    return joined.withColumn("raw_score", raw_score).drop(*(f"_w_{f}" for f in FAMILIES))


def collapsed(queries: DataFrame, scores: DataFrame, parents: DataFrame, floor: float = COLLAPSE_FLOOR) -> DataFrame:
    """(query, collapsed, terms, flag) of queries (query, terms): a ranking collapses if no score (query, score)
    reaches the floor; then the terms and their parents (term, parent), sorted, are what to ask with next."""
    best = scores.groupBy("query").agg(F.max("score").alias("_best"))
    wider = queries.select(
        "query",
        F.explode("terms").alias("term"),
    ).join(parents, "term").groupBy("query").agg(F.collect_set("parent").alias("_parents"))
    joined = queries.join(best, "query", "left").join(wider, "query", "left")
    gone = ~F.coalesce(F.col("_best") >= floor, F.lit(False))
    expanded = F.array_sort(F.array_union(F.array_distinct("terms"), F.coalesce("_parents", F.array().cast("array<string>"))))
    return joined.select(
        "query",
        gone.alias("collapsed"),
        F.when(gone, expanded).otherwise(F.col("terms")).alias("terms"),
        F.when(gone, "low_confidence_ranking").otherwise("normal").alias("flag"),
    )


def reassigned(before: DataFrame, now: DataFrame) -> DataFrame:
    """(uuid, previous, new, previous_confidence, new_confidence, shift, major) of candidates (uuid, specialty,
    confidence, probabilities) whose specialty changed: the shift is the largest change of confidence or of a
    probability, major from 0.3 on."""
    both = before.toDF(*(f"_{c}" for c in before.columns)).join(now, F.col("_uuid") == F.col("uuid")).where(F.col("_specialty") != F.col("specialty"))
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    changes = F.map_values(F.map_zip_with("_probabilities", "probabilities", lambda k, a, b: F.abs(zero(b) - zero(a))))
    shift = F.greatest(F.abs(F.col("confidence") - F.col("_confidence")), F.array_max(changes))
    return both.select(
        "uuid",
        F.col("_specialty").alias("previous"),
        F.col("specialty").alias("new"),
        F.col("_confidence").alias("previous_confidence"),
        F.col("confidence").alias("new_confidence"),
        F.round(shift, 4).alias("shift"),
        (shift >= MAJOR_SHIFT).alias("major"),
    )


def reassignment_rates(runs: DataFrame, threshold: float = CHURN_RATE) -> DataFrame:
    """Runs (run_date, total, reassigned, major) with their rate, whether it is over the threshold, and whether the
    last seven runs up to each were not."""
    rate = F.col("reassigned") / F.greatest("total", F.lit(1))
    recent = W.orderBy("run_date").rowsBetween(1 - STABLE_RUNS, 0)  # a row a run: some hundred a year
    rows = runs.withColumn("rate", F.round(rate, 4)).withColumn("alert", rate > threshold)
    return rows.withColumn("stable", F.max("rate").over(recent) <= threshold)


def collapsed_again(first: DataFrame, scores: DataFrame, floor: float = COLLAPSE_FLOOR) -> DataFrame:
    """(query, collapsed, terms, flag, retries): what becomes of the queries that `collapsed` asked again, by the scores of
    their wider terms. One that collapses again falls back to its cohort, without terms; others are as they were."""
    best = scores.groupBy("query").agg(F.max("score").alias("_best"))
    joined = first.join(best, "query", "left")
    again = F.col("collapsed") & ~F.coalesce(F.col("_best") >= floor, F.lit(False))
    return joined.select(
        "query",
        again.alias("collapsed"),
        F.when(again, F.array().cast("array<string>")).otherwise(F.col("terms")).alias("terms"),
        F.when(again, "cohort_fallback").when(F.col("collapsed"), "expanded").otherwise(F.col("flag")).alias("flag"),
        F.when(again, 2).when(F.col("collapsed"), 1).otherwise(0).alias("retries"),
    )


def vector_shifts(old: DataFrame, new: DataFrame, threshold: float = SHIFT_PERCENT) -> DataFrame:
    """(specialty, parameter, old_value, new_value, change, change_pct, exceeds) of two vectors (specialty, parameter,
    value), a parameter that one lacks as zero. From zero, a change of over 0.01 counts as one of 100 %."""
    both = old.withColumnRenamed("value", "_old").join(new.withColumnRenamed("value", "_new"), ["specialty", "parameter"], "full_outer")
    a, b = F.coalesce("_old", F.lit(0.0)), F.coalesce("_new", F.lit(0.0))
    change = F.abs(b - a)
    percent = F.when(F.abs(a) < 1e-10, F.when(change > 0.01, 100.0).otherwise(0.0)).otherwise(100.0 * change / F.abs(a))
    return both.select(
        "specialty", "parameter", a.alias("old_value"), b.alias("new_value"), F.round(change, 6).alias("change"), F.round(percent,
            2).alias("change_pct"), (percent > threshold).alias("exceeds")
    )


def newest_file(folder: str, specialty: str) -> str:
    """The file of a specialty's highest version."""
    known = [p for p in _files(folder, specialty) if _version(p) >= 0]
    if not known:
        raise FileNotFoundError(f"no vector of {specialty} in {folder}")
    return max(known, key=_version)


def approve(staged: str) -> str:
    """Makes a vector that waits in `staging` a version of its own, the next one there is by then; its path."""
    vector = read_vector(staged)
    folder = staged.rpartition("/")[0].rpartition("/")[0]
    exponents = tuple(float(vector["exponents"][k]) for k in EXPONENTS)
    path = write_vector(vector, exponents, folder, str(vector["created"]))
    fs, at = _place(staged)
    fs.delete_file(at)
    return path


def roll_back(folder: str, specialty: str, day: str) -> str:
    """Writes the version before the highest anew as the next one, so what was used when stays on file; its path."""
    known = sorted((p for p in _files(folder, specialty) if _version(p) >= 0), key=_version)
    if len(known) < 2:
        raise ValueError(f"{specialty} has no version to go back to")
    before = read_vector(known[-2])
    return write_vector(before, tuple(float(before["exponents"][k]) for k in EXPONENTS), folder, day)
