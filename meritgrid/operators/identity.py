"""Who is who: keys, names, organisations, fuzzy links, merges, contradictions and co-author cohorts.

Candidates for a comparison share a key and comparisons run where such rows meet; names that are near share a piece.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meritgrid.functions import joins
from meritgrid.functions.joins import in_places, pairs_by_key, places
from meritgrid.functions.positions import settled
from meritgrid.operators.closeness import HALF, HELD, NameTree, best_ratio, close_pairs, closest_names, masks, most_common, prepared
from meritgrid.operators.integrity import jaccard

# Weights and thresholds of the links, word lists and abbreviations.
LINK_WEIGHTS = {"name": 0.35, "affiliation": 0.25, "coauthor": 0.15, "mesh": 0.15, "time": 0.10}
AUTO_LINK, REVIEW = 0.75, 0.5
STRICT_AUTO_LINK = 0.95
MERGE_KEYS = ["orcid", "npi", "patent_inventor_id"]
INDUSTRY_WORDS = ["pharma", "therapeutics", "biosciences", "biotech", "inc", "corp", "ltd", "gmbh", "labs", "laboratories"]
ACADEMIC_WORDS = [
    "university", "college", "institute", "school", "hospital", "medical center",
    "cancer center", "cancer centre", "clinic", "national", "centre", "center",
]
ABBREVIATIONS = {
    "univ": "university",
    "hosp": "hospital",
    "med": "medical",
    "dept": "department",
    "ctr": "center",
    "inst": "institute",
    "sch": "school",
    "sci": "science",
    "res": "research",
    "natl": "national",
    "intl": "international",
    "coll": "college",
    "hlth": "health",
}


def strong_key_id(prefix: str, value: Column) -> Column:
    """A stable id: the first 32 hex digits of the SHA-256 of the key."""
    return F.substring(F.sha2(F.concat(F.lit(f"{prefix}:"), value), 256), 1, 32)


def candidate_id(orcid: Column, era: Column, name: Column, affiliation: Column) -> Column:
    """Id by ORCID, else by eRA account in upper case, else by name and the first 80 characters of affiliation."""
    by_name = F.concat_ws(":", F.lower(F.trim(name)), F.substring(F.lower(F.trim(F.coalesce(affiliation, F.lit("")))), 1, 80))
    return F.when(orcid.isNotNull(), strong_key_id("orcid", orcid)).when(
        era.isNotNull(),
        strong_key_id("era", F.upper(era)),
    ).otherwise(strong_key_id("name", by_name))


def normal_orcid(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), r"^https?://(www\.)?orcid\.org/", "")


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Unicode composition, which no built-in does."""
    return values.str.normalize("NFC")


def normal_name(name: Column) -> Column:
    return F.trim(F.lower(nfc(name)))


def first_email(affiliations: Column) -> Column:
    pattern = r"[\w.+-]+@[\w-]+\.[\w.-]+"
    return F.get(F.filter(F.transform(affiliations, lambda a: F.regexp_extract(a, pattern, 0)), lambda e: e != ""), F.lit(0))


def resolve_strong_keys(records: DataFrame, registry: DataFrame) -> DataFrame:
    """`records` (id, orcid, era) with the `uuid` and `matched_by` of the registry (key_type, key_value, uuid),
    ORCID before eRA; other key types are not looked at."""
    keys = records.select(
        "id",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("p"), F.lit("orcid").alias("key_type"), F.col("orcid").alias("key_value")),
                F.struct(F.lit(1).alias("p"), F.lit("era_commons").alias("key_type"), F.col("era").alias("key_value")),
            )
        ).alias("k"),
    ).select("id", "k.*")
    best = keys.where("key_value is not null").join(
        registry,
        ["key_type", "key_value"],
    ).groupBy("id").agg(F.min(F.struct("p", "uuid", "key_type")).alias("m"))
    return records.join(best, "id", "left").select(*records.columns, F.col("m.uuid").alias("uuid"), F.col("m.key_type").alias("matched_by"))


def get_or_create(records: DataFrame, registry: DataFrame, order: list[str]) -> DataFrame:
    """(id, uuid, is_new): the registered uuid of the first key type in `order` that matches, else a new one made
    of the record's own first key, so that a repeated run makes the same."""
    long = records.select(
        "id",
        F.posexplode(F.array(*(F.struct(F.lit(t).alias("key_type"), F.col("strong_keys")[t].alias("key_value")) for t in order))).alias("p", "k"),
    ).select("id", "p", "k.*").where("key_value is not null")
    known = long.join(registry, ["key_type", "key_value"]).groupBy("id").agg(F.min(F.struct("p", "uuid")).alias("m"))
    own = long.groupBy("id").agg(F.min(F.struct("p", F.concat_ws(":", "key_type", "key_value").alias("k"))).alias("o"))
    joined = records.select("id").join(known, "id", "left").join(own, "id", "left")
    made = F.substring(F.sha2(F.coalesce("o.k", F.concat(F.lit("id:"), F.col("id").cast("string"))), 256), 1, 32)
    return joined.select("id", F.coalesce("m.uuid", made).alias("uuid"), F.col("m").isNull().alias("is_new"))


def time_continuity(year: Column, first: Column, last: Column) -> Column:
    """1 inside the active years, falling to 0 over twenty years outside, 0.5 if unknown."""
    away = F.least(F.abs(year - first), F.abs(year - last))
    inside = (year >= first) & (year <= last)
    return F.when(year.isNull() | first.isNull() | last.isNull(), 0.5).when(inside, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - away / 20.0))


def affiliation_similarity(ror: Column, parent: Column, candidate_rors: Column) -> Column:
    same = F.coalesce(F.array_contains(candidate_rors, ror), F.lit(False))
    above = F.coalesce(F.array_contains(candidate_rors, parent), F.lit(False))
    return F.when(ror.isNotNull() & same, 1.0).when(ror.isNotNull() & above, 0.5).otherwise(0.0)


def link_confidence(features: dict[str, Column], has_coauthors: Column, has_mesh: Column) -> Column:
    """The weighted features; the weight of absent co-authors or terms goes to the rest in proportion."""
    used = {k: F.lit(w) for k, w in LINK_WEIGHTS.items()}
    used["coauthor"] = F.when(has_coauthors, used["coauthor"]).otherwise(0.0)
    used["mesh"] = F.when(has_mesh, used["mesh"]).otherwise(0.0)
    total = reduce(lambda a, b: a + b, used.values())
    return reduce(lambda a, b: a + b, [used[k] * features[k] for k in used]) / total


def link_action(confidence: Column, auto: float = AUTO_LINK, review: float = REVIEW) -> Column:
    return F.when(confidence >= auto, "auto-link").when(confidence >= review, "review").otherwise("reject")


#: Ratios of names at which candidates are looked for; a pair that shares nothing but a name needs the last of them.
LINK_ROUNDS = (0.93, 0.85, 0.78, 0.72)
#: Similarity of terms from which a pair can be a link with a ratio of names below all rounds.
CLOSE_TERMS = 0.5
#: Candidates of one organisation and the same years up to which all are compared; of more the closest names are searched
#: for, by so many tasks a group, each with so many artifacts.
CROWD, SHARES, SHARE = 512, 4, 50_000


def _with_masks(names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.length(n).alias("n"), masks(n).alias("m")))


def _able(a: Column, c: Column) -> Column:
    """No ratio of two lists of names with masks is higher."""

    def ratio(x: Column, y: Column) -> Column:
        total = x["n"] + y["n"]
        most = F.greatest(most_common(x["n"], x["m"], y["n"], y["m"]), F.lit(0))
        return F.when(total > 0, 2 * most / total + HALF).otherwise(F.lit(1.0))

    return F.coalesce(F.array_max(F.transform(a, lambda x: F.array_max(F.transform(c, lambda y: ratio(x, y))))), F.lit(0.0))


def _links(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The best candidate of each artifact among pairs (artifact_id, uuid), where it is a link: artifact_id, uuid,
    confidence and features. A ratio of names is measured only where its bound would make a link."""
    both = pairs.join(left, "artifact_id").join(right, "uuid")
    features = both.select(
        "artifact_id",
        "uuid",
        "names",
        "c_names",
        _able(F.col("names"), F.col("c_names")).alias("able"),
        affiliation_similarity(F.col("ror_id"), F.col("parent_ror_id"), F.col("rors")).alias("f_affiliation"),
        jaccard(F.col("people"), F.col("name_set")).alias("f_coauthor"),
        jaccard(F.col("term_set"), F.col("c_terms")).alias("f_mesh"),
        time_continuity(F.col("year"), F.col("first_year"), F.col("last_year")).alias("f_time"),
        (F.size("people") > 0).alias("_co"),
        ((F.size("term_set") > 0) & (F.size("c_terms") > 0)).alias("_me"),
    )

    def score(name: str) -> Column:
        return link_confidence({k: F.col(name if k == "name" else f"f_{k}") for k in LINK_WEIGHTS}, F.col("_co"), F.col("_me"))

    likely = features.where(score("able") >= REVIEW)
    text = lambda names: F.transform(names, lambda n: n["name"])
    measured = likely.withColumn("f_name", best_ratio(text(F.col("names")), text(F.col("c_names"))))
    kept = measured.withColumn("confidence", score("f_name")).where(F.col("confidence") >= REVIEW)
    rows = F.struct((-F.col("confidence")).alias("d"), "uuid", "confidence", *(f"f_{k}" for k in LINK_WEIGHTS))
    return kept.groupBy("artifact_id").agg(F.min(rows).alias("m")).select("artifact_id", "m.*").drop("d")


def _close_terms(left: DataFrame, right: DataFrame) -> DataFrame:
    """(artifact_id, uuid) that may have similar terms: pairs that share one of the rarer terms of either, as many as
    sets of that similarity cannot all lack."""
    one = left.select("artifact_id", F.explode("term_set").alias("term"), F.size("term_set").alias("n"))
    two = right.select("uuid", F.explode("c_terms").alias("term"), F.size("c_terms").alias("n"))
    common = two.groupBy("term").agg(F.count(F.lit(1)).alias("f"))

    def rarest(rows: DataFrame, key: str) -> DataFrame:
        placed = rows.join(common, "term", "left").withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(F.coalesce("f", F.lit(0)), "term")))
        return placed.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * CLOSE_TERMS) + 1)

    x, y = rarest(one, "artifact_id").select("artifact_id", "term", "n"), rarest(two, "uuid").select("uuid", "term", F.col("n").alias("m"))
    return x.join(y, "term").where((F.col("n") * CLOSE_TERMS <= F.col("m")) & (F.col("m") * CLOSE_TERMS <= F.col("n"))).select("artifact_id", "uuid")


def _closest_of_group(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
    """(artifact_id, uuid): for each name asked the candidate with the closest one, of equals the one of the first uuid."""
    if not len(asked) or not len(offered):
        return pd.DataFrame({"artifact_id": asked["artifact_id"].head(0), "uuid": offered["uuid"].head(0)})
    first = offered.groupby("name")["uuid"].min().sort_index()
    uuids = first.tolist()
    place = {u: i for i, u in enumerate(sorted(set(uuids)))}
    names = first.index.tolist()
    tree, at = NameTree(names, np.array([place[u] for u in uuids])), dict(zip(names, uuids, strict=True))
    known: dict[str, str] = {}
    for x in asked["name"]:
        if x not in known:
            known[x] = at[tree.closest(x)[0]]
    return pd.DataFrame({"artifact_id": asked["artifact_id"], "uuid": asked["name"].map(known)})


def _sharing(own: DataFrame, other: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(artifact_id, uuid) that share a key of `own` (artifact_id, key) and `other` (uuid, key), as far as they may be the
    best link of the artifact.

    Without co-authors and terms a link of an organisation is told by name and years. So where many candidates have an
    organisation and years in common, only those with the closest names are taken, the first uuid of equals; candidates
    without names, and all for artifacts without, are as close as each other, so the first uuid stands for them."""
    years = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("first_year", "last_year")]
    grouped = other.join(right.select("uuid", "first_year", "last_year", "c_names"), "uuid").withColumn("g", F.concat_ws("\0", "key", *years))
    counts = grouped.where(F.col("key").startswith("o")).groupBy("key", "g").agg(
        F.count(F.lit(1)).alias("m"), F.min("uuid").alias("any"), F.min(F.when(F.size("c_names") == 0, F.col("uuid"))).alias("bare")
    )
    large = settled(counts.where(F.col("m") > CROWD).withColumn("tables", F.ceil(F.col("m") / F.lit(HELD)).cast("int")))
    plain = own.join(other, "key").select("artifact_id", "uuid")
    if large.isEmpty():
        return plain
    simple = left.where((F.size("people") == 0) & (F.size("term_set") == 0)).select("artifact_id", "names")
    some = own.join(simple, "artifact_id")
    hard = own.join(simple, "artifact_id", "left_anti").join(other, "key").select("artifact_id", "uuid")
    small = grouped.join(large.select("g"), "g", "left_anti").select("key", "uuid")
    few = some.select("artifact_id", "key").join(small, "key").select("artifact_id", "uuid")
    asked = some.join(large.select("key", "g", "any", "bare", "tables"), "key")
    first = asked.select("artifact_id", F.when(F.size("names") == 0, F.col("any")).otherwise(F.col("bare")).alias("uuid")).where("uuid is not null")
    sizes = some.groupBy("key").agg(F.count(F.lit(1)).alias("a"))
    shares = F.greatest(F.least(F.lit(SHARES), F.ceil(F.col("a") / F.lit(CROWD))), F.ceil(F.col("a") / F.lit(SHARE))).cast("int")
    sizes = sizes.select("key", shares.alias("shares"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    x = asked.join(sizes, "key").withColumn("share", part("artifact_id", "shares")).withColumn("t", each("tables"))
    x = x.select("g", "share", "t", "artifact_id", F.explode(F.transform("names", lambda n: n["name"])).alias("name"))
    y = grouped.join(large.select("g", "tables"), "g").join(sizes, "key").withColumn("t", part("uuid", "tables")).withColumn("share", each("shares"))
    y = y.select("g", "share", "t", "uuid", F.explode(F.transform("c_names", lambda n: n["name"])).alias("name"))
    schema = T.StructType([T.StructField(c, d.schema[c].dataType) for c, d in (("artifact_id", left), ("uuid", right))])
    by = ["g", "share", "t"]
    near = x.groupBy(*by).cogroup(y.groupBy(*by)).applyInPandas(lambda a, b: _closest_of_group(a, b), schema)
    return hard.unionByName(few).unionByName(first).unionByName(near)


def link(artifacts: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best candidate of each artifact: artifact_id, uuid (null if rejected), confidence, action, features.

    `artifacts`: artifact_id, names, ror_id, parent_ror_id, coauthors, terms, year; `candidates`: uuid, names,
    rors, terms, first_year, last_year. The links are those of a comparison of all with all, without making it. A pair
    can only reach the review threshold if it shares an organisation or the name of a co-author, or has similar terms,
    or if its names are close: the former meet by key, the latter by pieces of names (`closeness`), in rounds of
    falling ratios. An artifact whose best link is better than any pair of the next round can be goes no further.
    An artifact without a link is rejected with confidence 0 and features 0.
    """
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    lower = lambda c: F.array_distinct(F.array_compact(F.transform(texts(c), F.lower)))
    left = settled(
        artifacts.select(
            "artifact_id", _with_masks(lower(F.col("names"))).alias("names"), "ror_id", "parent_ror_id", lower(F.col("coauthors")).alias("people"),
            lower(F.col("terms")).alias("term_set"), F.col("year").cast("double").alias("year"),
        )
    )
    right = settled(
        candidates.select(
            "uuid", _with_masks(lower(F.col("names"))).alias("c_names"), F.array_distinct(F.array_compact(texts(F.col("rors")))).alias("rors"),
            lower(F.col("names")).alias("name_set"), lower(F.col("terms")).alias("c_terms"),
            F.col("first_year").cast("double").alias("first_year"), F.col("last_year").cast("double").alias("last_year"),
        )
    )
    kind = lambda k, c: F.transform(c, lambda v: F.concat(F.lit(k), v))
    places = F.when(F.col("ror_id").isNotNull(), F.array_compact(F.array("ror_id", "parent_ror_id"))).otherwise(F.array().cast("array<string>"))
    own = left.select("artifact_id", F.explode(F.array_distinct(F.concat(kind("o", places), kind("p", F.col("people"))))).alias("key"))
    other = right.select("uuid", F.explode(F.concat(kind("o", F.col("rors")), kind("p", F.col("name_set")))).alias("key"))
    shared = _sharing(own, other, left, right).unionByName(_close_terms(left, right)).distinct()
    best = settled(_links(shared, left, right))

    asked, offered = (side.select(key, F.explode(F.transform(names, lambda n: n["name"])).alias(k)) for side, key, names, k in ((left, "artifact_id",
        "names", "x"), (right, "uuid", "c_names", "y")))
    known = settled(prepared(offered.select("y"), "y"))
    w = LINK_WEIGHTS
    for i, ratio in enumerate(LINK_ROUNDS):
        ahead = (w["name"] * ((LINK_ROUNDS[i - 1] - 0.01) if i else 1.0) + w["time"]) / (w["name"] + w["affiliation"] + w["time"])
        # co-authors without a common one weigh against a link, unless terms speak for it
        low = F.lit(ratio < LINK_ROUNDS[0]) & (F.size("people") > 0) & (F.size("term_set") == 0)
        done = best.where(F.col("confidence") > ahead + 1e-9).select("artifact_id")
        open_ = left.where(~low).select("artifact_id").join(done, "artifact_id", "left_anti")
        names = settled(asked.join(open_, "artifact_id"))
        if names.isEmpty():
            break
        near = settled(close_pairs(prepared(names.select("x"), "x"), known, ratio).select("x", "y"))
        pairs = names.join(near, "x").join(offered, "y").select("artifact_id", "uuid").distinct()
        both = best.unionByName(_links(pairs, left, right))
        rows = F.struct((-F.col("confidence")).alias("d"), "uuid", *(c for c in best.columns if c not in ("artifact_id", "uuid")))
        best = settled(both.groupBy("artifact_id").agg(F.min(rows).alias("m")).select("artifact_id", "m.*").drop("d").select(*best.columns))
    out = artifacts.select("artifact_id").join(best, "artifact_id", "left")
    out = out.select(
        "artifact_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), *(F.coalesce(f"f_{k}", F.lit(0.0)).alias(f"f_{k}") for k in w),
            "uuid"
    )
    return out.withColumn("action", link_action(F.col("confidence")))


def npi_match(pairs: DataFrame) -> DataFrame:
    """Confidence and action for pairs (npi_name, npi_specialty, npi_state, author, mesh, affiliation)."""
    a, b = F.lower(F.trim("npi_name")), F.lower(F.trim("author"))
    last = lambda c: F.substring_index(c, " ", -1)
    name = F.when(a == b, 1.0).when(last(a) == last(b), 0.7).otherwise(0.3)
    specialty = (F.coalesce("npi_specialty", F.lit("")) != "") & (F.coalesce(F.size("mesh"), F.lit(0)) > 0)
    address = (F.coalesce("npi_state", F.lit("")) != "") & F.upper("affiliation").contains(F.upper("npi_state"))
    address = F.coalesce(address, F.lit(False))
    signals = F.array_compact(
        F.array(
            F.when((a != b) & (last(a) != last(b)), "name_mismatch"),
            F.when(~specialty, "specialty_mismatch"),
            F.when(~address, "address_mismatch"),
        )
    )
    confidence = F.least(name + 0.1 * specialty.cast("double") + 0.1 * address.cast("double"), F.lit(1.0))
    out = pairs.withColumns({"confidence": F.round(confidence, 6), "specialty_match": specialty, "address_match": address, "signals": signals})
    return out.withColumn("action", link_action(F.col("confidence"), STRICT_AUTO_LINK, REVIEW))


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """Pairs (a, b) of candidates (uuid, strong_keys, names) that share a strong key or a name, a < b, with
    confidence, kind and the number of shared keys or names."""
    keys = candidates.select(
        "uuid",
        F.explode(F.map_filter("strong_keys", lambda k, v: k.isin(MERGE_KEYS) & v.isNotNull())).alias("t", "v"),
    ).select("uuid", F.concat_ws(":", F.lit("k"), "t", "v").alias("k"), F.lit(True).alias("strong"))
    names = candidates.select("uuid", F.explode(F.array_distinct(F.transform("names", F.lower))).alias("n")).select(
        "uuid",
        F.concat_ws(":", F.lit("n"), "n").alias("k"),
        F.lit(False).alias("strong"),
    )
    both = settled(keys.unionByName(names).distinct(), "keys and names")
    sizes = both.groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    meetings = sizes.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()[0]
    shared = in_places(pairs_by_key(both, "k", "uuid", rows_n=both.count()), meetings, "a", "b").groupBy("a", "b").agg(
        F.count_if(F.col("strong_a")).alias("n_keys"),
        F.count_if(~F.col("strong_a")).alias("n_names"),
    )
    strong = F.col("n_keys") > 0
    confidence = F.when(strong, F.least(0.95 + 0.02 * F.col("n_keys"), F.lit(1.0))).otherwise(F.least(0.5 + 0.15 * F.col("n_names"), F.lit(0.9)))
    return shared.select(
        "a",
        "b",
        "n_keys",
        "n_names",
        F.round(confidence, 6).alias("confidence"),
        F.when(strong, "strong_key").otherwise("review_needed").alias("kind"),
    ).where(F.col("confidence") >= REVIEW)


def merged_record(a: str, b: str) -> Column:
    """The rules by which two records become one: ordered union of populations, larger probability of each
    specialty. `a` and `b` are struct columns with populations and specialties; a keeps its id."""
    populations = F.array_distinct(F.concat(F.col(f"{a}.populations"), F.col(f"{b}.populations")))
    specialties = F.map_zip_with(f"{a}.specialties", f"{b}.specialties", lambda k, x, y: F.greatest(x, y))
    return F.struct(F.col(f"{a}.uuid").alias("uuid"), populations.alias("populations"), specialties.alias("specialties"))


def longest_prefix(codes: DataFrame, crosswalk: DataFrame, code: str = "code", least: int = 4) -> DataFrame:
    """Left join to (prefix, ...) by the longest prefix of the code of at least `least` characters; several rows
    of one prefix all match. Prefixes are exploded, so it is an equi-join."""
    own = F.upper(F.trim(F.col(code)))
    sizes = F.sequence(F.lit(least), F.greatest(F.length(own), F.lit(least)))
    wide = codes.select(code, F.explode(F.array_distinct(F.transform(sizes, lambda n: F.substring(own, F.lit(1), n)))).alias("prefix")).distinct()
    hits = wide.join(crosswalk, "prefix").withColumn("_n", F.length("prefix"))
    best = hits.groupBy(code).agg(F.max("_n").alias("_n"))
    return codes.join(hits.join(best, [code, "_n"]).drop("_n"), code, "left")


def normal_organisation(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def expanded_organisation(text: Column) -> Column:
    """Common abbreviations written out, word by word, whatever stands around a word."""
    table = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))

    def word(w: Column) -> Column:
        clean = F.regexp_replace(w, r"^[.,;:()]+|[.,;:()]+$", "")
        return F.when(table[clean].isNotNull(), F.replace(w, clean, table[clean])).otherwise(w)

    return F.array_join(F.transform(F.split(text, " "), word), " ")


def resolve_organisations(raw: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """`raw` (affiliation) resolved against a dictionary `names` (canonical_name, ror_id, ...) of any size: alias, then
    exact name, then the closest name by `name_ratio`, the first of equals in lower case. Only distinct strings that neither alias nor name resolves
    are looked for (`closeness`)."""
    text = raw.select("affiliation").distinct().withColumn("_t", normal_organisation(F.col("affiliation")))
    alias = aliases.groupBy(F.lower("alias").alias("_t")).agg(F.min("canonical_name").alias("_a"))
    exact = names.groupBy(F.lower("canonical_name").alias("_t")).agg(F.min("canonical_name").alias("_e"))
    known = text.join(alias, "_t", "left").join(exact, "_t", "left")
    open_ = known.where("_a is null and _e is null and _t <> ''").select("affiliation", expanded_organisation(F.col("_t")).alias("x"))
    best = closest_names(open_.select("x"), names.select(F.lower("canonical_name")))
    spelled = names.where("canonical_name is not null").groupBy(F.lower("canonical_name").alias("name")).agg(F.min("canonical_name").alias("spelled"))
    best = best.join(spelled, "name").select("x", F.struct(F.col("spelled").alias("name"), "ratio").alias("m"))
    matched = open_.join(best, "x").select("affiliation", "m")
    found = known.join(matched, "affiliation", "left").select(
        "affiliation",
        F.coalesce("_a", "_e", "m.name").alias("canonical_name"),
        F.when(F.coalesce("_a", "_e").isNotNull(), 1.0).otherwise(F.col("m.ratio")).alias("confidence"),
        F.when(F.col("_a").isNotNull(), "alias").when(F.col("_e").isNotNull(), "exact").when(F.col("m.ratio") >= 0.7, "fuzzy").when(
            F.col("m.ratio").isNotNull(),
            "fuzzy-low",
        ).alias("matched_via"),
    )
    return raw.join(found.join(names, "canonical_name", "left"), "affiliation", "left")


def organisation_type(name: Column) -> Column:
    lower = F.lower(name)
    has = lambda words: reduce(lambda a, b: a | b, [lower.contains(w) for w in words])
    return F.when(has(INDUSTRY_WORDS), "industry").when(has(ACADEMIC_WORDS), "academic").otherwise("unknown")


def contradictions(pairs: DataFrame) -> DataFrame:
    """Pairs (uuid, name_a, ror_a, country_a, name_b, ror_b, country_b) whose organisations differ, with severity:
    major if countries or kinds of organisation differ, else minor; major ones are flagged."""
    differ = pairs.where(F.col("ror_a").isNull() | F.col("ror_b").isNull() | (F.col("ror_a") != F.col("ror_b")))
    a, b = organisation_type(F.col("name_a")), organisation_type(F.col("name_b"))
    major = F.coalesce(F.col("country_a") != F.col("country_b"), F.lit(False)) | ((a != b) & (a != "unknown") & (b != "unknown"))
    return differ.withColumn("severity", F.when(major, "major").otherwise("minor")).withColumn("flagged", major)


#: A member in one number: where it stands, whether works of its set are left out, and the size of the set, which is cut
#: off at the most that so many bits hold.
SIZE_BITS = 16
LEFT_OUT, LARGE = 1 << SIZE_BITS, (1 << SIZE_BITS) - 1
#: Pairs that a block of members has about, and the most, in places of `PLACE_ROWS`.
BLOCK, BLOCK_MOST = 8, 16


def similar_sets(members: DataFrame, least: float, rows_n: int | None = None) -> DataFrame:
    """(a, b, jaccard), a < b, of the sets of (uuid, work) whose Jaccard similarity is about `least` or more. `rows_n`,
    where the number of rows is about known, saves counting them.

    Members are dealt by ranges into blocks. A work goes once to each block that has some of its members, as the list of
    them and those after them, and pairs are made and counted only there: what is shuffled are lists, not pairs.
    Works of very many members are cut into tiles, and a set leaves out its commonest ones of these: all but its first
    n - ceil(least * n) + 1 works, in an order in which they stand last. What two sets share of the others, and as much
    as was left out, must reach the overlap that the sizes ask for; such pairs are counted whole."""
    t = least - 1e-6
    named = members.select("uuid", "work").where(F.col("uuid").isNotNull())
    ranges = named.repartitionByRange(places(2 * (members.count() if rows_n is None else rows_n)), "uuid").distinct()
    own = ranges.groupBy("uuid").agg(F.count(F.lit(1)).alias("n"), F.collect_list("work").alias("works"))
    sets = settled(own.withColumn("_id", F.monotonically_increasing_id()), "sets")
    inside = (1 << 33) - 1  # bits of such an id below the partition's number
    last, n_sets, links = sets.agg(F.max(F.col("_id").bitwiseAND(inside)), F.count(F.lit(1)), F.sum("n")).first()
    width = 1 + (last or 0)
    sets = sets.withColumn("at", F.shiftright("_id", 33) * width + F.col("_id").bitwiseAND(inside)).drop("_id")

    bound = max(joins.TILE, (links or 0) // joins.BROADCAST_KEYS)  # so works of more members are no more than can be broadcast
    rows = sets.select("uuid", "at", "n", F.explode("works").alias("work"))
    common = settled(rows.groupBy("work").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > bound), "common works")
    hot = common.count()
    v = F.shiftleft("at", SIZE_BITS + 1).bitwiseOR(F.col("left_out") * LEFT_OUT).bitwiseOR(F.least("n", F.lit(LARGE))).alias("v")
    if hot:
        kept = settled(_without_commonest(rows, common, t).select("work", v), "works that are not left out")
        common = settled(kept.groupBy("work").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > bound), "common works")
        rows = kept.join(F.broadcast(common), "work", "left_anti")
    else:
        rows = rows.withColumn("left_out", F.lit(0).cast("long")).select("work", v)
    lists = in_places(rows, links, "work").groupBy("work").agg(F.sort_array(F.collect_list("v")).alias("tail"))
    lists = settled(lists.where(F.size("tail") > 1).select("tail"), "members of works")
    pairs = lambda m: F.sum(m.cast("double") * (m - 1) / 2)
    meetings = sum(f.agg(pairs(m)).first()[0] or 0 for f, m in ((lists, F.size("tail")), (common, F.col("m"))))

    wide = max(1, int((n_sets or 0) * BLOCK * joins.PLACE_ROWS / (meetings or 1)))
    at = lambda v: F.shiftright(v, SIZE_BITS + 1)
    block = lambda v: F.floor(at(v) / F.lit(wide))
    first = F.filter(F.sequence(F.lit(1), F.size("tail") - 1), lambda i: (i == 1) | (block(F.get("tail", i - 1)) != block(F.get("tail", i - 2))))
    met = lists.select("tail", F.explode(first).alias("_s")).select(
        block(F.get("tail", F.col("_s") - 1)).alias("a"),
        F.lit(None).cast("array<bigint>").alias("own"),
        F.slice("tail", F.col("_s"), F.size("tail") - F.col("_s") + 1).alias("tail"),
    )
    if hot:
        met = met.unionByName(_met_in_tiles(kept.join(F.broadcast(common), "work"), bound, block))
    # Those of the list in the block, where they are not given.
    own = F.coalesce("own", F.filter("tail", lambda y: block(y) == F.col("a")))
    sizes = settled(met.groupBy("a").agg(F.sum(F.size(own).cast("double") * F.size("tail")).alias("n")), "blocks")
    parts = sizes.select("a", F.ceil(F.col("n") / F.lit(BLOCK_MOST * joins.PLACE_ROWS)).cast("int").alias("parts")).where(F.col("parts") > 1)
    # A block of more pairs, which is rare, is cut by the second member.
    cut = met.join(F.broadcast(parts), "a", "left").withColumn("b", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    mine = F.filter("tail", lambda y: F.pmod(at(y), F.col("parts")) == F.col("b"))
    dealt = cut.select("a", "b", F.when(F.col("parts").isNotNull(), own).otherwise(F.col("own")).alias("own"),
        F.when(F.col("parts").isNotNull(), mine).otherwise(F.col("tail")).alias("tail")).where(F.size("tail") > 0)
    need = lambda n, m: (n + m) * (t / (1 + t))
    size = lambda v: v.bitwiseAND(LARGE)
    out = lambda v: v.bitwiseAND(LEFT_OUT) > 0
    rest = lambda v: F.when(out(v), F.when(size(v) == LARGE, float("inf")).otherwise(F.ceil(size(v) * t) - 1)).otherwise(0)
    enough = lambda x, y: need(size(x), size(y)) - F.greatest(rest(x), rest(y))
    some = lambda n: F.greatest(F.ceil(n), F.lit(1)).cast("int")
    x, y = F.col("x"), F.col("y")
    made = in_places(dealt, meetings, "a", "b").select("a", "b", "own", "tail", F.posexplode(own).alias("_p", "x"))
    # A list of no tile begins with those in the block.
    later = F.when(F.col("own").isNull(), F.slice("tail", F.col("_p") + 2, F.size("tail"))).otherwise(F.filter("tail", lambda y: y > x))
    others = made.select("a", "b", "x", later.alias("later")).groupBy("a", "b", "x").agg(
        F.sort_array(F.flatten(F.collect_list("later"))).alias("others"), F.max(some(size(x) * t)).alias("of_x"))
    # How often a second one stands there at least: where works are left out as both ask for, else as the first does.
    fewest = lambda y: some(enough(x, y)) if hot else F.col("of_x")
    often = F.filter("others", lambda y, i: F.get("others", i + fewest(y) - 1) == y)
    counted = others.select("a", "b", "x", "of_x", F.explode(often).alias("y")).groupBy("a", "b", "x", "of_x", "y").agg(F.count(F.lit(1)).alias("_more"))
    counted = counted.withColumn("k", F.col("_more") + fewest(y) - 1)
    able = counted.where(F.col("k") >= enough(x, y)).select(at(x).alias("x"), at(y).alias("y"), "k", (out(x) | out(y)).alias("unsure"))
    known = in_places(sets.select("at", "uuid", "n", *(["works"] if hot else [])), links if hot else n_sets, "at")
    side = lambda s: known.select(*(F.col(c).alias(s if c == "at" else f"{c}_{s}") for c in known.columns))
    both = able.join(side("x"), "x").join(side("y"), "y")
    k = F.when(F.col("unsure"), F.size(F.array_intersect("works_x", "works_y"))).otherwise(F.col("k")) if hot else F.col("k")
    shared = both.select(F.least("uuid_x", "uuid_y").alias("a"), F.greatest("uuid_x", "uuid_y").alias("b"), "n_x", "n_y", k.alias("k"))
    n, m, k = F.col("n_x"), F.col("n_y"), F.col("k")
    return shared.where((k > 0) & (k >= need(n, m))).select("a", "b", (k / (n + m - k)).alias("jaccard"))


def _without_commonest(rows: DataFrame, common: DataFrame, t: float) -> DataFrame:
    """`rows` (uuid, at, n, work) without those works of `common` (work, m) that stand behind the first n - ceil(t * n) + 1
    of a set in the order of how common they are, and whether (1, else 0) the set has such."""
    own = W.partitionBy("uuid")
    placed = rows.join(F.broadcast(common), "work", "left").withColumn("_p", F.row_number().over(own.orderBy(F.coalesce("m", F.lit(0)), "work")))
    late = F.col("m").isNotNull() & (F.col("_p") > F.col("n") - F.ceil(F.col("n") * t) + 1)
    marked = placed.withColumn("_late", late).withColumn("left_out", F.max(F.col("_late").cast("long")).over(own))
    return marked.where(~F.col("_late")).select("at", "n", "work", "left_out")


def _met_in_tiles(rows: DataFrame, tile: int, block) -> DataFrame:
    """(a, own, tail) of the works of `rows` (work, v, m), which have too many members for one list: members are dealt into
    tiles of about `tile`, and those of each block meet each tile, in which they look for those after them."""
    tiles = F.ceil(F.col("m") / F.lit(tile)).cast("int")
    tails = rows.groupBy("work", F.pmod(F.xxhash64("v"), tiles).cast("int").alias("t")).agg(F.sort_array(F.collect_list("v")).alias("tail"))
    asked = rows.select("work", "v", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("t"))
    owns = asked.groupBy("work", "t", block(F.col("v")).alias("a")).agg(F.collect_list("v").alias("own"))
    after = F.filter("tail", lambda y: y > F.array_min("own"))
    return owns.join(tails, ["work", "t"]).select("a", "own", after.alias("tail")).where(F.size("tail") > 0)


def coauthors(authorship: DataFrame, fanout: int, of: DataFrame | None = None) -> DataFrame:
    """(a, b): for each author, or for those `of` (uuid), the first `fanout` others, by id, that share a work of (uuid,
    work). They are among the first `fanout` + 1 authors of a work, so only those are offered, not all pairs of it.
    Offers are counted first, and then dealt into as many places as they need."""
    links = authorship.select("uuid", "work").where("work is not null").distinct()
    n = links.count()
    asked = links if of is None else in_places(links, n, "uuid").join(of.select("uuid").distinct(), "uuid", "left_semi")
    links, asked = in_places(links, n, "work"), in_places(asked, n, "work")
    most = F.least(F.count(F.lit(1)), F.lit(fanout + 1)).alias("n")
    offers = asked.join(links.groupBy("work").agg(most), "work").agg(F.sum("n")).first()[0]
    first = links.withColumn("_k", F.row_number().over(W.partitionBy("work").orderBy("uuid"))).where(F.col("_k") <= fanout + 1).drop("_k")
    met = asked.toDF("a", "work").join(first.select(F.col("uuid").alias("b"), "work"), "work").where("a <> b").select("a", "b")
    pairs = in_places(met, offers, "a", "b").distinct()
    return pairs.withColumn("_k", F.row_number().over(W.partitionBy("a").orderBy("b"))).where(F.col("_k") <= fanout).drop("_k")


def cohort(seeds: DataFrame, authorship: DataFrame, hops: int = 2, rows_n: int | None = None) -> DataFrame:
    """(uuid, hop, seed): seeds and whom they reach over co-authors within so many hops; each is reached once, in
    the first hop that does, and credited to the smallest seed that does.

    A hop takes all co-authors: works get the smallest seed of their authors of the last hop, and authors the smallest
    of their works. So rows grow with authorship, not with pairs of authors, and no co-author is left out. `rows_n`, where
    the number of rows of authorship is about known, says how many places they are dealt into before each is taken once."""
    named = authorship.select("uuid", "work").where("uuid is not null and work is not null")
    links = settled((named if rows_n is None else in_places(named, rows_n, "uuid")).distinct(), "authorship")
    n = links.count()
    by_author, by_work = in_places(links, n, "uuid"), in_places(links, n, "work")
    reached = seeds.select("uuid", F.lit(0).alias("hop"), F.col("uuid").alias("seed"))
    frontier = reached
    for hop in range(1, hops + 1):
        works = in_places(by_author.join(frontier.select("uuid", "seed"), "uuid"), n, "work").groupBy("work").agg(F.min("seed").alias("seed"))
        new = in_places(by_work.join(works, "work"), n, "uuid").groupBy("uuid").agg(F.min("seed").alias("seed"))
        frontier = settled(new.join(reached, "uuid", "left_anti").select("uuid", F.lit(hop).alias("hop"), "seed"), "reached")
        reached = reached.unionByName(frontier)
    return reached


def merged_people(people: DataFrame) -> DataFrame:
    """(last_name, full_name, grant_ids): people (full_name, seq, grant_ids) of one last name, whatever its case, as
    one, with the name of the first and all grants, each once."""
    last = F.lower(F.substring_index(F.trim("full_name"), " ", -1))
    keyed = people.withColumn("last_name", last)
    names = keyed.groupBy("last_name").agg(F.min_by("full_name", "seq").alias("full_name"))
    ids = keyed.select("last_name", F.explode("grant_ids").alias("g")).groupBy("last_name").agg(F.array_sort(F.collect_set("g")).alias("grant_ids"))
    return names.join(ids, "last_name", "left").withColumn("grant_ids", F.coalesce("grant_ids", F.array().cast("array<string>")))


def merged_terms(terms: DataFrame, most: int = 10) -> DataFrame:
    """(uuid, descriptor, major, place) out of (uuid, pos, descriptor, major): each descriptor once whatever its case,
    in the order of first mention, major if a mention is, the first ten of a candidate. The spelling is that of the
    first major mention, else of the first."""
    spelling = F.min_by("descriptor", F.struct(~F.col("major"), "pos"))
    one = terms.groupBy("uuid", F.lower("descriptor").alias("_l")).agg(
        spelling.alias("descriptor"),
        F.max("major").alias("major"),
        F.min("pos").alias("_p"),
    )
    placed = one.withColumn("place", F.row_number().over(W.partitionBy("uuid").orderBy("_p")))
    return placed.where(F.col("place") <= most).select("uuid", "descriptor", "major", "place")


def median_ratio(people: DataFrame, ratios: DataFrame) -> DataFrame:
    """(uuid, median): the middle citation ratio of each person's papers (uuid, pmid) that have one, 0 without."""
    own = people.select("uuid", "pmid").distinct().join(ratios.select("pmid", "rcr"), "pmid", "left")
    w = W.partitionBy("uuid")
    placed = own.withColumn("_k", F.row_number().over(w.orderBy(F.col("rcr").asc_nulls_last()))).withColumn("_n", F.count("rcr").over(w))
    middle = F.col("_k").isin(F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2))
    return placed.groupBy("uuid").agg(F.coalesce(F.avg(F.when(middle, F.col("rcr"))), F.lit(0.0)).alias("median"))
