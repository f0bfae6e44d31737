"""Queries over routing by specialty, expansion, landed records, disputes and people, with the same in SQL."""

from __future__ import annotations

import uuid as uuids

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgrid.functions.positions import shared_folder
from meritgrid.operators import expansion, identity, monitoring, results, routing, store
from meritgrid.plans.standins import PAPERS_SQL, candidates, papers, table
from meritgrid.sources import records

# Weights of two specialties, as in their first versions.
VECTORS = {
    "basic_research": {"f1_rcr": 0.45, "f2_funding": 0.20, "f3_leadership": 0.20, "f4_apex": 0.0, "f5_translational": 0.05, "f6_lineage": 0.10},
    "clinician": {
        "f1_rcr": 0.15,
        "f2_funding": 0.10,
        "f3_leadership": 0.30,
        "f4_apex": 0.0,
        "f5_translational": 0.20,
        "f6_lineage": 0.05,
        "f7_clinician": 0.20,
    },
}


#: Records of a landed page, about.
PAGE_RECORDS = 5000


def _landed(rows: DataFrame, *path: str) -> str:
    """Lands rows as a source does, in files that are one JSON object with a list of records at the path, and returns
    their folder."""
    folder = f"{shared_folder(rows.sparkSession)}/landed-{uuids.uuid4().hex}"
    page = F.pmod(F.xxhash64(*rows.columns), F.lit(rows.count() // PAGE_RECORDS + 1)).alias("page")
    content = F.col("r")
    for name in reversed(path):
        content = F.struct(content.alias(name))
    pages = rows.groupBy(page).agg(F.collect_list(F.struct(*rows.columns)).alias("r"))
    pages.select(F.to_json(content).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)  # a page a file
    return folder


def expand_terms(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's segment and country as a query against the labels of both."""
    c = candidates(spark, d)
    asked = c.select(F.col("uuid").alias("id"), F.concat_ws(" ", "segment", "country").alias("query"))
    both = F.concat_ws(", ", "country", "segment")
    labels = c.select(F.explode(F.array(F.initcap("segment"), "country", both)).alias("label")).distinct()
    return expansion.expand(asked, labels).select("id", F.array_join("terms", "|").alias("terms"), "confidence")


def resolve_organisations(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' names, some as they are, some with an alias, some misspelt, against a dictionary of all of them."""
    s, n = table(spark, d, "supplier"), F.col("s_suppkey")
    names = s.select(F.col("s_name").alias("canonical_name"), F.concat(F.lit("r"), "s_suppkey").alias("ror_id"))
    aliases = s.where("s_suppkey % 5 = 0").select(F.concat(F.lit("The "), "s_suppkey").alias("alias"), F.col("s_name").alias("canonical_name"))
    text = F.when(n % 5 == 0, F.concat(F.lit("the  "), "s_suppkey")).when(n % 5 == 1, F.upper("s_name")).otherwise(F.translate("s_name", "up", "o"))
    raw = s.select("s_suppkey", text.alias("affiliation"))
    return identity.resolve_organisations(raw, names, aliases).select("s_suppkey", "canonical_name", "confidence", "matched_via")


def _vectors(spark: SparkSession) -> DataFrame:
    rows = [(s, 1, k, v) for s, w in VECTORS.items() for k, v in w.items()]
    return spark.createDataFrame(rows, "specialty string, version int, parameter string, value double")


def routed_quality(spark: SparkSession, d: str) -> DataFrame:
    """Raw quality by the weights of the specialty that each candidate's probabilities, or the query, select."""
    u = F.col("uuid")
    odds = F.create_map(F.lit("clinician"), (u % 7) / 7.0, F.lit("basic_research"), (u % 5) / 5.0, F.lit("policy_epi"), F.lit(0.3))
    asked = F.when(u % 10 == 0, "basic_research").when(u % 10 == 1, "unknown")
    rows = candidates(spark, d).select(
        "uuid",
        routing.selected_specialty(odds, asked, list(VECTORS)).alias("specialty"),
        ((u % 97) / 97.0).alias("f1_rcr"),
        ((u % 89) / 89.0).alias("f3_leadership"),
        ((u % 83) / 83.0).alias("f7_clinician"),
    )
    return routing.routed_quality(rows, _vectors(spark)).select("uuid", "specialty", "raw_score")


def score_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Orders as queries: their priorities are the terms, the discounts of their lines the scores."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    asked = o.select(F.col("o_orderkey").alias("query"), F.array("o_orderpriority", "o_orderstatus").alias("terms"))
    scores = li.where("l_linenumber <> 1").select(F.col("l_orderkey").alias("query"), F.col("l_discount").alias("score"))
    parents = spark.createDataFrame([("1-URGENT", "HIGH"), ("2-HIGH", "HIGH"), ("O", "STATUS")], "term string, parent string")
    return routing.collapsed(asked, scores, parents).select("query", "collapsed", F.array_join("terms", "|").alias("terms"), "flag")


def specialty_reassigned(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("uuid")

    def snapshot(n: int) -> DataFrame:
        a, b = (u * n % 11) / 10.0, (u * n % 7) / 10.0
        odds = F.create_map(F.lit("clinician"), a, F.lit("policy_epi" if n == 3 else "translational"), b)
        return candidates(spark, d).select(
            "uuid",
            F.when(a >= b, "clinician").otherwise("other").alias("specialty"),
            F.greatest(a, b).alias("confidence"),
            odds.alias("probabilities"),
        )

    return routing.reassigned(snapshot(3), snapshot(5)).withColumns({c: F.round(c, 4) for c in ("previous_confidence", "new_confidence")})


def reassignment_rates(spark: SparkSession, d: str) -> DataFrame:
    """A day of events as a run: errors are reassignments, those of high value major ones."""
    e = table(spark, d, "events")
    gone = F.col("event_type") == "error"
    runs = e.groupBy(F.to_date("ts").alias("run_date")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(gone).alias("reassigned"),
        F.count_if(gone & (F.col("value") > 50)).alias("major"),
    )
    return routing.reassignment_rates(runs, 0.2)


def coverage_delta(spark: SparkSession, d: str) -> DataFrame:
    from meritgrid.plans.monitoring_queries import _cohort

    now = _cohort(spark, d)
    return monitoring.coverage_delta(monitoring.coverage(now), monitoring.coverage(now.where("uuid % 7 <> 0")))


def clinician_coverage(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("uuid")
    flags = {
        "has_candidate": u % 3 != 0,
        "has_abms": u % 5 == 0,
        "has_state_board": u % 2 == 0,
        "has_hospital_tier": u % 7 == 0,
        "has_publications": u % 4 == 0,
    }
    rows = candidates(spark, d).select(F.substring("country", 1, 2).alias("practice_state"), *(v.alias(k) for k, v in flags.items()))
    row = monitoring.clinician_coverage(rows)
    return row.withColumns({c: F.array_join(c, ",") for c in ("covered_states", "gap_states", "caveats")})


def dispute_feedback(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    kinds = F.array(*(F.lit(k) for k in ("low_quality_output", "incorrect_ranking", "missing_expertise", "integrity_concern", "other")))
    disputes = o.select(
        F.col("o_orderkey").alias("dispute"),
        F.col("o_custkey").alias("uuid"),
        F.lit(None).cast("string").alias("query"),
        F.element_at(kinds, (F.col("o_orderkey") % 5).cast("int") + 1).alias("category"),
    )
    decisions = li.select(
        F.col("l_orderkey").alias("dispute"),
        (F.col("l_quantity") > 25).alias("confirmed"),
        (F.col("l_linenumber") * 100 + F.col("l_quantity")).alias("decided_at"),
    )
    return store.dispute_feedback(disputes, decisions).select("dispute", "uuid", "category", "direction", "weight")


def review_training(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    queue = o.select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("uuid"), F.col("o_totalprice").alias("features"))
    decisions = li.where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("item"),
        F.col("l_linestatus").alias("decision"),
        F.col("l_linenumber").alias("decided_at"),
    )
    return store.training_rows(queue, decisions)


def patents_without_conflicts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "pending").when(F.col("l_returnflag") == "A", "excluded").otherwise("resolved")
    conflicts = li.where("l_quantity > 49").select(F.col("l_partkey").alias("patent"), status.alias("status"))
    return store.without_conflicts(table(spark, d, "part").select(F.col("p_partkey").alias("patent")), conflicts)


def session_rule(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    sessions = e.where("event_type = 'view'").select(
        "event_id",
        F.col("user_id").alias("reviewer"),
        (F.col("event_id") % 30).alias("judgments"),
        F.col("ts").alias("started"),
    )
    ended = e.where("event_type = 'purchase'").select(F.col("user_id").alias("reviewer"), F.col("ts").alias("ended"))
    return store.may_continue(sessions, ended).select("event_id", "allowed")


def term_cohort(spark: SparkSession, d: str) -> DataFrame:
    terms = papers(spark, d).groupBy("uuid").agg(F.collect_set("term").alias("terms"))
    return store.with_terms(terms, ["promo", "Nothing"]).select("uuid")


def merged_people(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    name = F.concat_ws(
        " ",
        F.element_at(F.array(F.lit("Ann"), F.lit("Bo")), (F.col("o_orderkey") % 2).cast("int") + 1),
        F.concat(F.when(F.col("o_orderkey") % 3 == 0, "Smith").otherwise("SMITH"), "o_custkey"),
    )
    people = o.select(
        name.alias("full_name"),
        F.col("o_orderkey").alias("seq"),
        F.array(F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)).alias("grant_ids"),
    )
    return identity.merged_people(people).withColumn("grant_ids", F.array_join("grant_ids", ","))


def merged_terms(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    word = F.element_at(F.array(*map(F.lit, ("Lung", "Heart", "Skin", "Liver"))), (F.col("l_suppkey") % 4).cast("int") + 1)
    word = F.when(F.col("l_linenumber") % 2 == 0, F.lower(word)).otherwise(word)
    terms = li.select(
        F.col("l_orderkey").alias("uuid"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_suppkey")).alias("pos"),
        word.alias("descriptor"),
        (F.col("l_returnflag") == "R").alias("major"),
    )
    return identity.merged_terms(terms, 3)


def median_ratio(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    ratios = p.where("article_type <> 'Letter'").groupBy("pmid").agg(F.max("rcr").alias("rcr"))
    return identity.median_ratio(p.select("uuid", "pmid"), ratios).withColumn("median", F.round("median", 6))


def landed_citations(spark: SparkSession, d: str) -> DataFrame:
    """Orders as landed pages of citation ratios, read back."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select(
        k.alias("pmid"),
        F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("relative_citation_ratio"),
        F.when(k % 3 > 0, F.col("o_custkey")).alias("citation_count"),
        F.when(k % 5 > 0, k % 2 == 0).alias("is_research_article"),
    )
    return records.citation_ratios(spark, _landed(rows, "data")).select("pmid", "year", "rcr", "citation_count", "is_research_article")


def landed_works_people(spark: SparkSession, d: str) -> DataFrame:
    """Orders as landed works with two authors, their people merged into candidates."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    author = lambda name, orcid, place: F.struct(
        F.struct(F.lit("A1").alias("id"), name.alias("display_name"), orcid.alias("orcid")).alias("author"),
        F.lit(place).alias("author_position"),
    )
    last = author(
        F.concat(F.lit("Person "), "o_custkey"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("https://orcid.org/"), "o_custkey")),
        "last",
    )
    rows = o.select(
        F.concat(F.lit("https://example.org/W"), k).alias("id"),
        F.struct(F.concat(F.lit("https://example.org/"), k).alias("pmid")).alias("ids"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"),
        F.array(author(F.lit("First"), F.lit(None).cast("string"), "first"), last).alias("authorships"),
        F.array(F.struct(F.col("o_orderpriority").alias("display_name"))).alias("concepts"),
        F.array(F.struct(F.when(k % 3 == 0, k.cast("string")).alias("award_id"), F.lit("Fund").alias("funder_display_name"))).alias("grants"),
    )
    people = records.work_people(records.works(spark, _landed(rows, "results")))
    found = records.ingest(people)
    return found.select(
        F.get("name_variants", F.lit(0)).alias("name"),
        "orcid",
        F.size("pmids").alias("n_papers"),
        F.size("grant_ids").alias("n_grants"),
        F.size("terms").alias("n_terms"),
        "linkage_confidence",
        F.col("last_updated_per_source")["openalex"].alias("updated"),
    )


def landed_retractions(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    day = F.array(F.year("o_orderdate"), F.month("o_orderdate"), F.when(k % 5 == 0, F.lit(31)).otherwise(F.dayofmonth("o_orderdate")))
    rows = o.select(
        F.array(F.concat(F.lit("Notice "), k)).alias("title"),
        F.array(F.struct(F.lit("Ann").alias("given"), F.concat(F.lit("P"), "o_custkey").alias("family"))).alias("author"),
        F.concat(F.lit("10.1/"), k).alias("DOI"),
        F.struct(F.array(F.when(k % 7 == 0, F.slice(day, 1, 2)).otherwise(day)).alias("date-parts")).alias("issued"),
    )
    notices = records.retractions(spark, _landed(rows, "message", "items"))
    return notices.select("doi", "title", F.array_join("authors", ",").alias("authors"), "retraction_date")


def evidence_facets(spark: SparkSession, d: str) -> DataFrame:
    """Papers, grants and trials of all candidates as one feed, counted by kind."""
    p = papers(spark, d).select("uuid", F.col("pmid").alias("identifier"), "rcr", F.col("published").alias("day"))
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("uuid"),
        F.col("o_orderkey").cast("string").alias("identifier"),
        F.to_date("o_orderdate").alias("day"),
        "o_orderstatus",
    )
    feed = results.evidence(p, o.where("o_orderstatus <> 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'F'").drop("o_orderstatus"))
    return results.facets(feed)


def get_or_create(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    keys = F.create_map(
        F.lit("orcid"),
        F.when(k % 3 > 0, F.concat(F.lit("o"), "o_custkey")),
        F.lit("npi"),
        F.when(k % 2 == 0, F.concat(F.lit("n"), "o_custkey")),
    )
    rows = o.select(k.alias("id"), keys.alias("strong_keys"))
    c = candidates(spark, d)
    registry = c.where("uuid % 2 = 0").select(F.lit("npi").alias("key_type"), F.concat(F.lit("n"), "uuid").alias("key_value"), F.concat(F.lit("u"),
        "uuid").alias("uuid")).unionByName(
        c.where("uuid % 5 = 0").select(
            F.lit("orcid").alias("key_type"),
            F.concat(F.lit("o"), "uuid").alias("key_value"),
            F.concat(F.lit("v"), "uuid").alias("uuid"),
        )
    )
    return identity.get_or_create(rows, registry, ["orcid", "npi"])


QUERIES = {
    f.__name__: f
    for f in (
        expand_terms, resolve_organisations, routed_quality, score_collapse, specialty_reassigned, reassignment_rates, coverage_delta,
            clinician_coverage,
        dispute_feedback, review_training, patents_without_conflicts, session_rule, term_cohort, merged_people, merged_terms, median_ratio,
        landed_citations, landed_works_people, landed_retractions, evidence_facets, get_or_create,
    )
}

_STOP = ", ".join(f"'{w}'" for w in expansion.STOP_WORDS)
_SHARES = "round(100.0 * count(*) FILTER ({t}) / count(*), 2)::DOUBLE"
_METRICS = {
    "strong_key_pct": "uuid % 3 = 0 OR uuid % 5 = 0", "probabilistic_linkage_pct": "conf >= 0.7", "pubmed_pct": "p > 0", "reporter_pct": "g > 0",
        "ctgov_pct": "t > 0", "thin_record_pct": "p + g + t < 3",
}


def _delta(name: str) -> str:
    share = _SHARES.format(t=_METRICS[name])
    return f"SELECT '{name}' AS metric, round((SELECT {share} FROM cohort) - (SELECT {share} FROM cohort WHERE uuid % 7 <> 0), 2) AS delta"


def _weighted(specialty: str) -> str:
    """Log of the raw quality by the weights of a specialty; families without a percentile count 0.01."""
    have = {"f1_rcr": "(u % 97) / 97.0", "f3_leadership": "(u % 89) / 89.0", "f7_clinician": "(u % 83) / 83.0"}
    return " + ".join(f"{w} * ln(greatest({have.get(k, '0.0')}, 0.01)::DOUBLE)" for k, w in VECTORS[specialty].items() if w)


ORACLE_SQL = {
    "expand_terms": f"""WITH c AS (SELECT c_custkey AS id, c_mktsegment AS s, n_name AS n FROM customer JOIN nation ON n_nationkey = c_nationkey),
      v AS (SELECT DISTINCT unnest([upper(left(s, 1)) || lower(substr(s, 2)), n, n || ', ' || s]) AS label FROM c),
      t AS (SELECT id, s || ' ' || n AS q, list_filter(string_split(s || ' ' || n, ' '), lambda x: length(x) > 2) AS w FROM c),
      a AS (SELECT id, unnest(l) AS term, generate_subscripts(l, 1) AS p FROM (SELECT id, list_concat([q], list_transform(range(1, len(w)),
        lambda i: w[i] || ' ' || w[i + 1]), list_filter(w, lambda x: lower(x) NOT IN ({_STOP}))) AS l FROM t)),
      d AS (SELECT id, lower(term) AS t, min(p) AS p FROM a GROUP BY ALL), u AS (SELECT DISTINCT t FROM d),
      k AS (SELECT t, label, row_number() OVER (PARTITION BY t ORDER BY label) AS k FROM u JOIN v ON contains(lower(label), t) QUALIFY k <= 5),
      f AS (SELECT id, arg_min(label, (p, k)) AS label, min((p, k)) AS o FROM d JOIN k USING (t) GROUP BY id, lower(label))
      SELECT id, string_agg(label, '|' ORDER BY o) AS terms, 0.8::DOUBLE AS confidence FROM f GROUP BY id""",
    "routed_quality": f"""WITH c AS (SELECT c_custkey AS u, CASE c_custkey % 10 WHEN 0 THEN 'basic_research' WHEN 1 THEN 'unknown' END AS asked,
          (c_custkey % 7) / 7.0::DOUBLE AS a, (c_custkey % 5) / 5.0::DOUBLE AS b FROM customer),
      s AS (SELECT u, CASE WHEN asked = 'basic_research' THEN asked WHEN a >= greatest(b, 0.3) THEN 'clinician' WHEN b >= 0.3 THEN 'basic_research'
        ELSE 'translational' END AS specialty FROM c)
      SELECT u AS uuid, specialty, round(exp(CASE specialty WHEN 'clinician' THEN {_weighted("clinician")}
        WHEN 'basic_research' THEN {_weighted("basic_research")} END), 8) AS raw_score FROM s""",
    "score_collapse": """WITH b AS (SELECT l_orderkey AS q, max(l_discount) AS m FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1),
          s AS (SELECT o_orderkey AS query, coalesce(m < 0.05, true) AS collapsed, [o_orderpriority, o_orderstatus] AS t FROM orders LEFT
            JOIN b ON q = o_orderkey)
      SELECT query, collapsed, array_to_string(CASE WHEN collapsed THEN list_sort(list_distinct(list_concat(t, CASE WHEN t[1] IN ('1-URGENT',
        '2-HIGH') THEN ['HIGH'] ELSE [] END, CASE WHEN t[2] = 'O' THEN ['STATUS'] ELSE [] END))) ELSE t END, '|') AS terms,
        CASE WHEN collapsed THEN 'low_confidence_ranking' ELSE 'normal' END AS flag FROM s""",
    "specialty_reassigned": """WITH s AS (SELECT c_custkey AS u, (c_custkey * 3 % 11) / 10.0::DOUBLE AS a, (c_custkey * 3 % 7) / 10.0::DOUBLE AS b,
          (c_custkey * 5 % 11) / 10.0::DOUBLE AS x, (c_custkey * 5 % 7) / 10.0::DOUBLE AS y FROM customer),
      k AS (SELECT *, greatest(abs(greatest(x, y) - greatest(a, b)), abs(x - a), b, y) AS shift FROM s WHERE (a >= b) <> (x >= y))
      SELECT u AS uuid, CASE WHEN a >= b THEN 'clinician' ELSE 'other' END AS previous, CASE WHEN x >= y THEN 'clinician' ELSE 'other' END AS new,
        round(greatest(a, b), 4) AS previous_confidence, round(greatest(x, y), 4) AS new_confidence, round(shift, 4) AS shift, shift >= 0.3 AS major
          FROM k""",
    "reassignment_rates": """WITH r AS (SELECT ts::DATE AS run_date, count(*) AS total, count(*) FILTER (event_type = 'error') AS reassigned,
          count(*) FILTER (event_type = 'error' AND value > 50) AS major FROM events GROUP BY 1), k AS (SELECT *, reassigned / total::DOUBLE AS x
            FROM r)
      SELECT run_date, total, reassigned, major, round(x, 4) AS rate, x > 0.2 AS alert, max(round(x, 4))
        OVER (ORDER BY run_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) <= 0.2 AS stable FROM k""",
    "clinician_coverage": """WITH c AS (SELECT c_custkey AS u, left(n_name, 2) AS s FROM customer JOIN nation ON n_nationkey = c_nationkey),
          k AS (SELECT *, s IN ('CA', 'NY', 'TX', 'FL', 'IL', 'PA', 'OH', 'NC', 'GA', 'MI') AS c FROM c),
      r AS (SELECT count(*) AS total_clinicians, round(100.0 * count(*) FILTER (u % 3 <> 0) / count(*), 2)::DOUBLE AS npi_crosslinked_pct,
        round(100.0 * count(*) FILTER (u % 5 = 0) / count(*), 2)::DOUBLE AS abms_coverage_pct, round(100.0 * count(*) FILTER (u % 2 = 0) / count(*),
          2)::DOUBLE AS state_board_coverage_pct,
        round(100.0 * count(*) FILTER (u % 7 = 0) / count(*), 2)::DOUBLE AS hospital_tier_pct, round(100.0 * count(*) FILTER (u % 4 = 0) / count(*),
          2)::DOUBLE AS publication_pct, coalesce(string_agg(DISTINCT s, ',' ORDER BY s) FILTER (c), '') AS covered_states,
                coalesce(string_agg(DISTINCT s, ',' ORDER BY s) FILTER (NOT c), '') AS gap_states FROM k)
      SELECT *, array_to_string(list_filter([CASE WHEN publication_pct < 30 THEN 'few publications' END, CASE
        WHEN abms_coverage_pct < 50 THEN 'few certifications' END], lambda x: x IS NOT NULL), ',') AS caveats FROM r""",
    "dispute_feedback": """WITH l AS (SELECT l_orderkey AS d, arg_max(l_quantity > 25, l_linenumber * 100 + l_quantity) AS c FROM lineitem
          GROUP BY 1), k AS (SELECT o_orderkey AS dispute, o_custkey AS uuid, ['low_quality_output', 'incorrect_ranking', 'missing_expertise',
            'integrity_concern', 'other'][o_orderkey % 5 + 1] AS category FROM orders JOIN l ON d = o_orderkey WHERE c)
      SELECT dispute, uuid, category, CASE category WHEN 'integrity_concern' THEN 'flag' WHEN 'other' THEN 'review'
        ELSE 'downweight' END AS direction, 1.0::DOUBLE AS weight FROM k""",
    "review_training": """SELECT o_orderkey AS item, o_custkey AS uuid, o_totalprice AS features, l_linestatus AS decision,
          l_linenumber AS decided_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'""",
    "patents_without_conflicts": """SELECT p_partkey AS patent FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49
          AND l_returnflag IN ('R', 'A'))""",
    "session_rule": """WITH l AS (SELECT user_id AS u, max(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY 1)
      SELECT event_id, event_id % 30 < 20 AND (t IS NULL OR ts >= t + INTERVAL 60 MINUTES) AS allowed FROM events LEFT JOIN l ON u = user_id
        WHERE event_type = 'view'""",
    "term_cohort": f"WITH {PAPERS_SQL} SELECT DISTINCT uuid FROM papers WHERE lower(term) = 'promo'",
    "merged_people": """WITH p AS (SELECT ['Ann', 'Bo'][o_orderkey % 2 + 1] || ' ' || CASE WHEN o_orderkey % 3 = 0 THEN 'Smith'
          ELSE 'SMITH' END || o_custkey AS n, 'smith' || o_custkey AS l, o_orderkey AS k, unnest([o_orderstatus, left(o_orderpriority, 1)]) AS g
            FROM orders)
      SELECT l AS last_name, arg_min(n, k) AS full_name, string_agg(DISTINCT g, ',' ORDER BY g) AS grant_ids FROM p GROUP BY l""",
    "merged_terms": """WITH s AS (SELECT *, ['Lung', 'Heart', 'Skin', 'Liver'][l_suppkey % 4 + 1] AS n FROM lineitem),
          t AS (SELECT l_orderkey AS uuid, l_linenumber::BIGINT * 1000000000 + l_suppkey AS p, CASE WHEN l_linenumber % 2 = 0 THEN lower(n)
            ELSE n END AS w, l_returnflag = 'R' AS m FROM s),
      g AS (SELECT uuid, arg_min(w, (NOT m, p)) AS descriptor, bool_or(m) AS major, min(p) AS p FROM t GROUP BY uuid, lower(w))
      SELECT uuid, descriptor, major, row_number() OVER (PARTITION BY uuid ORDER BY p)::INT AS place FROM g QUALIFY place <= 3""",
    "median_ratio": """WITH r AS (SELECT o_custkey AS uuid, l_orderkey, l_linenumber, max(CASE
          WHEN l_returnflag <> 'R' THEN l_extendedprice / (l_quantity * p_retailprice) END) AS rcr FROM lineitem
            JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)
      SELECT uuid, round(coalesce(median(rcr), 0), 6) AS median FROM r GROUP BY uuid""",
    "landed_citations": """SELECT o_orderkey::VARCHAR AS pmid, year(o_orderdate)::INT AS year, o_totalprice AS rcr, CASE
          WHEN o_orderkey % 3 > 0 THEN o_custkey ELSE 0 END AS citation_count,
      o_orderkey % 5 > 0 AND o_orderkey % 2 = 0 AS is_research_article FROM orders""",
    "landed_works_people": """SELECT 'Person ' || o_custkey AS name, CASE WHEN o_custkey % 2 = 0 THEN o_custkey::VARCHAR END AS orcid,
          count(*)::INT AS n_papers, count(*) FILTER (o_orderkey % 3 = 0)::INT AS n_grants, count(DISTINCT o_orderpriority)::INT AS n_terms,
      CASE WHEN o_custkey % 2 = 0 THEN 0.85 ELSE 0.65 END::DOUBLE AS linkage_confidence, max(o_orderdate)::DATE AS updated FROM orders
        GROUP BY o_custkey""",
    "landed_retractions": """SELECT '10.1/' || o_orderkey AS doi, 'Notice ' || o_orderkey AS title, 'Ann P' || o_custkey AS authors,
      CASE WHEN o_orderkey % 7 <> 0 THEN try_strptime(strftime(o_orderdate, '%Y-%m-') || CASE WHEN o_orderkey % 5 = 0 THEN '31'
        ELSE strftime(o_orderdate, '%d') END, '%Y-%m-%d')::DATE END AS retraction_date FROM orders""",
    "evidence_facets": """SELECT category, count(*) AS n, count(DISTINCT uuid) AS people FROM (SELECT o_custkey AS uuid, 'publication' AS category
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
      UNION ALL SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'trial' ELSE 'grant' END FROM orders) GROUP BY category""",
    "get_or_create": """WITH k AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderkey % 3 > 0 AS o, o_orderkey % 2 = 0 AS n FROM orders),
          m AS (SELECT *, CASE WHEN o AND c % 5 = 0 THEN 'v' || c WHEN n AND c % 2 = 0 THEN 'u' || c END AS u FROM k JOIN customer ON c_custkey = c)
      SELECT id, coalesce(u, left(sha256(CASE WHEN o THEN 'orcid:o' || c WHEN n THEN 'npi:n' || c ELSE 'id:' || id END), 32)) AS uuid,
        u IS NULL AS is_new FROM m""",
    "coverage_delta": "WITH cohort AS (SELECT c_custkey AS uuid, (c_custkey * 37 % 101) / 100.0::DOUBLE AS conf, c_custkey % 4 AS p, c_custkey % 3 AS g, c_custkey % 2 AS t FROM customer) "
    + " UNION ALL ".join(_delta(n) for n in _METRICS)
    + " UNION ALL SELECT 'p50', round(round((SELECT median(conf) FROM cohort), 4) - round((SELECT median(conf) FROM cohort WHERE uuid % 7 <> 0), 4), 4)",
}
