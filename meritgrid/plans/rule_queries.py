"""Queries over gates, privacy, classification and identity, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgrid.operators import classify, identity, integrity, privacy
from meritgrid.plans.standins import PAPERS_SQL, candidates, papers, table

QUERY_TERMS = ["PROMO", "ECONOMY", "SMALL"]
AS_OF = "2024-06-30"


def _people(spark: SparkSession, d: str) -> DataFrame:
    terms = papers(spark, d).groupBy("uuid").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    c = candidates(spark, d).select("uuid", "name", F.when(F.col("uuid") % 4 == 0, F.concat(F.lit("NPI"), "uuid")).alias("npi"))
    return c.join(terms, "uuid", "left")


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    c = candidates(spark, d)
    u = F.col("uuid")
    leie = c.where("uuid % 20 = 0").select(
        F.lit("none").alias("first_name"), F.lit("none").alias("last_name"), F.concat(F.lit("NPI"), "uuid").alias("npi"), F.when(
            u % 100 == 0,
            F.lit("2020-01-01").cast("date"),
        ).alias("reinstate_date")
    )
    ofac = c.where("uuid % 61 = 0").select(F.lit("nobody").alias("primary_name"), F.array(F.upper("name")).alias("aliases"))
    ori = c.where("uuid % 37 = 0").select("name", F.make_date(F.lit(2010) + (u % 12).cast("int"), F.lit(6), F.lit(30)).alias("finding_date"))
    text = F.when(u % 3 == 0, "Data were FABRICATED by the author").when(u % 3 == 1, "An honest error was found").otherwise("")
    notices = c.where("uuid % 5 = 0").select("uuid", F.concat(F.lit("p"), "uuid").alias("pmid"), text.alias("notice"))
    return leie, ofac, ori, notices


def hard_gate_ladder(spark: SparkSession, d: str) -> DataFrame:
    leie, ofac, ori, notices = _lists(spark, d)
    rows = integrity.excluded(_people(spark, d), leie)
    rows = integrity.recent_finding(integrity.listed(rows, ofac), ori, F.lit(AS_OF).cast("date"))
    return integrity.hard_gate(rows, notices, QUERY_TERMS).select(
        "uuid",
        "leie_excluded",
        "sanctioned",
        "recent_finding",
        "is_zero",
        "reason",
        "rules_evaluated",
    )


def soft_discount_product(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    load = integrity.predatory_load(p.select("uuid", (F.col("work") % 7 == 0).alias("is_predatory"), "position"))
    u = F.col("uuid")
    factor = integrity.soft_discount(F.col("predatory_load"), u % 9, u % 6 == 0)
    return load.select("uuid", F.round("predatory_load", 6).alias("predatory_load"), F.round(factor, 6).alias("factor"))


def predatory_case(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    flags = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (k % 4).cast("int"))
    test = integrity.predatory(k % 2 == 0, k % 3 == 0, k % 11 == 0, flags)
    return p.select("p_partkey", test.alias("is_predatory"))


def triage_case(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    text = F.when(n % 5 == 0, F.concat("text", F.lit(" Figures MANIPULATED."))).when(n % 5 == 1, F.concat("text",
        F.lit(" an inadvertent slip"))).when(
        n % 5 == 2,
        F.concat(F.lit("Overlapping publication: "), "text"),
    ).when(n % 5 == 3, "  ").otherwise(F.col("text"))
    severity = integrity.triage_severity(text)
    return table(spark, d, "documents").select(
        "doc_id",
        severity.alias("severity"),
        integrity.triage_confidence(severity).alias("confidence"),
        integrity.triage_discount(severity).alias("discount"),
    )


def phrase_scan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    title = F.when(k % 3 == 0, "Profound learning with an arbitrary FOREST").when(k % 3 == 1, "Enormous information").otherwise("A plain title")
    docs = table(spark, d, "documents").select(
        "doc_id",
        title.alias("title"),
        F.col("text").alias("abstract"),
        ((k % 10) / 10.0).alias("coordinated_authorship_score"),
    )
    return integrity.papermill(docs).select("doc_id", "phrase_count", F.array_join("phrases", "|").alias("phrases"), "suspected")


def phi_scan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    extra = F.when(
        k % 6 == 0,
        " MRN: 1234567 seen",
    ).when(k % 6 == 1, " SSN 123456789").when(k % 6 == 2, " number 123456789").when(k % 6 == 3, " 12 Main Street").otherwise("")
    docs = table(spark, d, "documents").select(
        "doc_id",
        F.concat("text", extra).alias("text"),
        F.when(k % 7 == 0, "born 1980-02-03").otherwise("x").alias("patient_note"),
    )
    return privacy.phi_scan(docs, "doc_id", ["text", "patient_note"]).select("doc_id", "field", "pattern", F.size("matches").cast("long").alias("n"))


def phi_redacted(spark: SparkSession, d: str) -> DataFrame:
    found = privacy.phi_scan(table(spark, d, "documents").select("doc_id", "text"), "doc_id", ["text"]).where("pattern = 'email'")
    return found.select("doc_id", F.array_join(F.array_sort(F.transform("matches", privacy.redacted)), ",").alias("shown"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("uuid"),
        F.when(F.col("event_type").isin("click", "error"), "opt_out").otherwise("opt_in").alias("action"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def optout_latest_anti(spark: SparkSession, d: str) -> DataFrame:
    return privacy.allowed(candidates(spark, d), _log(spark, d)).select("uuid", "name")


def optout_stats(spark: SparkSession, d: str) -> DataFrame:
    return privacy.opt_out_stats(_log(spark, d))


def privacy_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).select(
        "uuid",
        "name",
        F.when(F.col("uuid") % 13 == 0, "mail a.b@example.org").otherwise("none").alias("note"),
        F.lit(40).alias("age_years"),
    )
    return privacy.privacy_gate(rows, _log(spark, d), ["name", "note"]).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def override_latest(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).withColumn("action", F.when(F.col("action") == "opt_out", "override").otherwise("revoke"))
    return integrity.override_active(log)


def keyword_argmax(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    text = F.concat(
        "text",
        F.when(k % 4 == 0, " drug target BINDING").when(
            k % 4 == 1,
            " randomized placebo endpoint policy",
        ).when(k % 4 == 2, " outbreak surveillance").otherwise(""),
    )
    kind, confidence = classify.query_class(text)
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"), confidence.alias("confidence"))


def organisation_types(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    name = F.concat("s_name", F.when(k % 4 == 0, " Pharma University").when(k % 4 == 1, " Cancer Centre").when(k % 4 == 2, " GmbH").otherwise(""))
    return s.select("s_suppkey", identity.organisation_type(name).alias("kind"))


def specialty_rules(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("c_custkey")
    name, confidence = classify.rule_based_specialty(u % 5 == 0, u % 7 == 0, u % 11, u % 6)
    return table(spark, d, "customer").select("c_custkey", name.alias("specialty"), confidence.alias("confidence"))


def strong_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    registry = c.where("uuid % 2 = 0").select(F.lit("orcid").alias("key_type"), F.concat(F.lit("o"), "uuid").alias("key_value"),
        F.col("uuid").cast("string").alias("uuid")).unionByName(
        c.where("uuid % 3 = 0").select(
            F.lit("era_commons").alias("key_type"),
            F.concat(F.lit("e"), "uuid").alias("key_value"),
            F.concat(F.lit("x"), "uuid").alias("uuid"),
        )
    )
    records = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("o"), "o_custkey")).alias("orcid"),
        F.concat(F.lit("e"), "o_custkey").alias("era"),
    )
    return identity.resolve_strong_keys(records, registry).select("id", "uuid", "matched_by")


def longest_prefix_join(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "part").select(F.upper("p_brand").alias("code")).distinct()
    crosswalk = spark.createDataFrame(
        [("BRAND#", "any"), ("BRAND#1", "ones"), ("BRAND#12", "twelve"), ("BRAND#2", "twos")],
        "prefix string, term string",
    )
    return identity.longest_prefix(codes, crosswalk).select("code", "prefix", "term")


def npi_match(spark: SparkSession, d: str) -> DataFrame:
    c, n = candidates(spark, d), F.col("uuid")
    pairs = c.select(
        "uuid",
        F.concat(F.lit("Ann "), "segment").alias("npi_name"),
        F.when(n % 2 == 0, "cardiology").alias("npi_specialty"),
        F.when(n % 3 == 0, "ia").otherwise("zz").alias("npi_state"),
        F.concat(F.when(n % 5 == 0, "ann ").otherwise("Bo "), F.when(n % 7 == 0, "other").otherwise(F.col("segment"))).alias("author"),
        F.array(F.lit("t")).alias("mesh"),
        F.col("country").alias("affiliation"),
    )
    return identity.npi_match(pairs).select("uuid", "confidence", "action", F.array_join("signals", ",").alias("signals"))


def shared_key_pairs(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("uuid")
    keys = F.create_map(
        F.lit("orcid"),
        (u.cast("long") / 3).cast("long").cast("string"),
        F.lit("npi"),
        F.when(u % 2 == 0, (u / 6).cast("long").cast("string")),
    )
    c = candidates(spark, d).select(
        "uuid",
        keys.alias("strong_keys"),
        F.array(
            F.concat(F.lit("Name"), (u / 5).cast("long").cast("string")),
            F.concat(F.lit("ALSO"), (u / 4).cast("long").cast("string")),
        ).alias("names"),
    )
    return identity.merge_candidates(c)


def coauthor_two_hop(spark: SparkSession, d: str) -> DataFrame:
    works = papers(spark, d).select("uuid", (F.col("work") * 1000 + F.month("published")).alias("work"))
    seeds = table(spark, d, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("uuid"))
    return identity.cohort(seeds, works, 2, table(spark, d, "lineitem").count())


def contradictions(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), F.col("s_suppkey")
    named = F.concat("s_name", F.when(n % 3 == 0, " University").when(n % 3 == 1, " Inc").otherwise(""))
    pairs = s.select(
        F.col("s_suppkey").alias("uuid"), named.alias("name_a"), (n % 4).cast("string").alias("ror_a"), (n % 2).cast("string").alias("country_a"),
            F.when(n % 5 == 0, "Acme Corp").otherwise("State College").alias("name_b"), (n % 6).cast("string").alias("ror_b"), F.when(
            n % 7 > 0,
            (n % 2).cast("string"),
        ).otherwise("9").alias("country_b")
    )
    return identity.contradictions(pairs).select("uuid", "severity", "flagged")


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the parts that two customers bought, for pairs of at least 0.05."""
    sets = papers(spark, d).select("uuid", "work")
    return identity.similar_sets(sets, 0.05, table(spark, d, "lineitem").count()).select("a", "b", F.round("jaccard", 6).alias("jaccard")).where("jaccard >= 0.05")


def fuzzy_link(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' records linked to customers by name, organisation and years."""
    s, c = table(spark, d, "supplier"), candidates(spark, d)
    artifacts = s.select(
        F.col("s_suppkey").alias("artifact_id"), F.array(F.concat_ws(" ", F.lit("Customer"), F.format_string("%d", "s_suppkey"),
            F.lit("Smith"))).alias("names"), F.col("s_nationkey").cast("string").alias("ror_id"), F.lit(None).cast("string").alias("parent_ror_id"),
                F.array().cast("array<string>").alias("coauthors"), F.array().cast("array<string>").alias("terms"), F.lit(2000).alias("year")
    )
    people = c.select(
        F.col("uuid").cast("string").alias("uuid"),
        F.array(F.concat_ws(" ", F.lit("Customer"), F.format_string("%d", "uuid"), F.lit("Smythe"))).alias("names"),
        F.array((F.col("uuid") % 25).cast("string")).alias("rors"),
        F.array().cast("array<string>").alias("terms"),
        F.lit(1990).alias("first_year"),
        F.lit(2010).alias("last_year"),
    )
    return identity.link(artifacts, people).select("artifact_id", "uuid", F.round("confidence", 6).alias("confidence"), "action")


QUERIES = {
    f.__name__: f
    for f in (
        hard_gate_ladder, soft_discount_product, predatory_case, triage_case, phrase_scan, phi_scan, phi_redacted, optout_latest_anti, optout_stats,
            privacy_gate,
        override_latest, keyword_argmax, organisation_types, specialty_rules, strong_key_lookup, longest_prefix_join, npi_match, shared_key_pairs,
            coauthor_two_hop,
        contradictions, jaccard_pairs, fuzzy_link,
    )
}

_LATEST = "SELECT user_id AS uuid, arg_max(event_type IN ('click', 'error'), (ts, event_id)) AS o FROM events GROUP BY 1"
_HITS = {k: " + ".join(f"contains(t, '{w}')::INT" for w in v) for k, v in classify.QUERY_WORDS.items()}
_PHI = "SELECT doc_id, field, '{n}' AS pattern, len(regexp_extract_all(value, '(?i){p}')) AS n FROM fields WHERE {w}"
_CONTEXT = "regexp_matches(value, '(?is)(" + "|".join(f"{t}.{{0,{20 - len(t)}}}\\b\\d{{9}}\\b|\\b\\d{{9}}\\b.{{0,{20 - len(t)}}}{t}" for t in privacy.SSN_TERMS) + ")')"
_WHEN = {n: "true" for n in privacy.PHI_PATTERNS} | {
    "dob_mmddyyyy": "field = 'patient_note'",
    "dob_iso": "field = 'patient_note'",
    "ssn_nodash": _CONTEXT,
}

ORACLE_SQL = {
    "hard_gate_ladder": f"""WITH {PAPERS_SQL}, t AS (SELECT uuid, list_sort(list_distinct(list(term))) AS terms FROM papers GROUP BY uuid),
      r AS (SELECT c_custkey AS uuid, CASE WHEN c_custkey % 100 = 0 THEN NULL ELSE c_custkey % 20 = 0 END AS l, c_custkey % 61 = 0 AS o,
        c_custkey % 37 = 0 AND make_date(2010 + (c_custkey % 12)::INT, 6, 30) >= DATE '{AS_OF}' - INTERVAL 10 YEAR AS f,
        c_custkey % 5 = 0 AND c_custkey % 3 = 0 AND coalesce(len(list_intersect(terms, ['PROMO', 'ECONOMY',
          'SMALL'])) / len(list_distinct(list_concat(terms, ['PROMO', 'ECONOMY', 'SMALL'])))::DOUBLE, 0) >= 0.6 AS n FROM customer LEFT
                JOIN t ON t.uuid = c_custkey)
      SELECT uuid, l AS leie_excluded, o AS sanctioned, f AS recent_finding, coalesce(l, false) OR o OR f OR n AS is_zero,
        CASE WHEN l THEN 'LEIE federal exclusion' WHEN o THEN 'OFAC/SAM listing' WHEN f THEN 'ORI misconduct finding (10yr)'
          WHEN n THEN 'retraction (fabrication) in subdomain' END AS reason, CASE WHEN l THEN 1 WHEN o THEN 2 WHEN f THEN 3 WHEN n THEN 4
            ELSE 5 END AS rules_evaluated FROM r""",
    "soft_discount_product": f"""WITH {PAPERS_SQL}, w AS (SELECT uuid, work % 7 = 0 AS p, CASE position WHEN 'last' THEN 1.0 WHEN 'first' THEN 0.8
          ELSE 0.5 END::DOUBLE AS w FROM papers), l AS (SELECT uuid, coalesce(sum(w) FILTER (p), 0) / sum(w) AS load FROM w GROUP BY uuid)
      SELECT uuid, round(load, 6) AS predatory_load, round(CASE WHEN load > 0 THEN greatest(1 - load * 0.5, 0.5) ELSE 1.0 END * CASE
        WHEN uuid % 9 > 0 THEN greatest(1 - 0.1::DOUBLE * (uuid % 9), 0.4) ELSE 1.0 END * CASE WHEN uuid % 6 = 0 THEN 0.7 ELSE 1.0 END, 6) AS factor
          FROM l""",
    "predatory_case": """SELECT p_partkey, p_partkey % 2 <> 0 AND (p_partkey % 11 = 0 OR (p_partkey % 3 <> 0 AND p_partkey % 4 >= 2)) AS is_predatory
          FROM part""",
    "triage_case": """WITH t AS (SELECT doc_id, lower(CASE n_chars % 5 WHEN 0 THEN text || ' Figures MANIPULATED.'
          WHEN 1 THEN text || ' an inadvertent slip' WHEN 2 THEN 'Overlapping publication: ' || text WHEN 3 THEN '  ' ELSE text END) AS x
            FROM documents),
      s AS (SELECT doc_id, CASE WHEN contains(x, 'fabricat') OR contains(x, 'made up') THEN 'fabrication' WHEN contains(x, 'falsif') OR contains(x,
        'manipulat') THEN 'falsification' WHEN contains(x, 'honest error') OR contains(x, 'inadvertent') THEN 'honest_error' WHEN contains(x,
              'overlapping publication') THEN 'duplicate_publication' WHEN trim(coalesce(x, '')) = '' THEN 'no_statement'
                    ELSE 'unclassifiable' END AS severity FROM t)
      SELECT doc_id, severity, CASE severity WHEN 'no_statement' THEN 0.9 WHEN 'unclassifiable' THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence,
        CASE severity WHEN 'fabrication' THEN 0 WHEN 'falsification' THEN 0 WHEN 'honest_error' THEN 0.85 WHEN 'no_statement' THEN 0.6
          ELSE 0.7 END::DOUBLE AS discount FROM s""",
    "phrase_scan": f"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Profound learning with an arbitrary FOREST'
          WHEN 1 THEN 'Enormous information' ELSE 'A plain title' END || ' ' || coalesce(text, '') AS x FROM documents), p AS (SELECT doc_id,
            regexp_extract_all(x, '(?i)({"|".join(integrity.TORTURED_PHRASES)})') AS f FROM t)
      SELECT doc_id, len(f)::INT AS phrase_count, array_to_string(f, '|') AS phrases, len(f) >= 2 OR (doc_id % 10) / 10.0 > 0.7 AS suspected
        FROM p""",
    "phi_scan": "WITH fields AS (SELECT doc_id, 'text' AS field, coalesce(text || CASE doc_id % 6 WHEN 0 THEN ' MRN: 1234567 seen' WHEN 1 THEN ' SSN 123456789' WHEN 2 THEN ' number 123456789' WHEN 3 THEN ' 12 Main Street' ELSE '' END, '') AS value FROM documents UNION ALL SELECT doc_id, 'patient_note', CASE WHEN doc_id % 7 = 0 THEN 'born 1980-02-03' ELSE 'x' END FROM documents), a AS ("
    + " UNION ALL ".join(_PHI.format(n=n, p=p, w=_WHEN[n]) for n, p in privacy.PHI_PATTERNS.items())
    + ") SELECT * FROM a WHERE n > 0",
    "phi_redacted": f"""WITH f AS (SELECT doc_id, list_sort(list_transform(regexp_extract_all(text, '(?i){privacy.PHI_PATTERNS['email']}'), lambda x:
          CASE WHEN length(x) < 3 THEN '***' ELSE left(x, 3) || '***' END)) AS m FROM documents) SELECT doc_id, array_to_string(m, ',') AS shown
            FROM f WHERE len(m) > 0""",
    "optout_latest_anti": f"""WITH l AS ({_LATEST}) SELECT c_custkey AS uuid, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT uuid FROM l
          WHERE o)""",
    "optout_stats": f"WITH l AS ({_LATEST}) SELECT count(*) AS total, count(*) FILTER (o) AS opted_out, count(*) FILTER (NOT o) AS opted_in FROM l",
    "privacy_gate": f"""WITH l AS ({_LATEST}) SELECT CASE WHEN c_custkey % 13 = 0 THEN 'rejected_phi' WHEN c_custkey IN (SELECT uuid FROM l
          WHERE o) THEN 'excluded_opt_out' ELSE 'stripped' END AS decision, count(*) AS n FROM customer GROUP BY 1""",
    "override_latest": f"WITH l AS ({_LATEST}) SELECT uuid, o AS overridden FROM l",
    "keyword_argmax": f"""WITH x AS (SELECT doc_id, coalesce(lower(text || CASE doc_id % 4 WHEN 0 THEN ' drug target BINDING'
          WHEN 1 THEN ' randomized placebo endpoint policy' WHEN 2 THEN ' outbreak surveillance' ELSE '' END), '') AS t FROM documents),
      h AS (SELECT doc_id, {_HITS["drug_discovery"]} AS a, {_HITS["clinical_trial_pi"]} AS b, {_HITS["policy_epi"]} AS c FROM x)
      SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'basic_research' WHEN a = greatest(a, b, c) THEN 'drug_discovery' WHEN b = greatest(a, b,
        c) THEN 'clinical_trial_pi' ELSE 'policy_epi' END AS kind, round(CASE WHEN greatest(a, b, c) = 0 THEN 0.5 ELSE least(0.5 + greatest(a, b,
          c) * 0.1, 0.95) END, 3)::DOUBLE AS confidence FROM h""",
    "organisation_types": """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'industry' WHEN 1 THEN 'academic' WHEN 2 THEN 'industry'
          ELSE 'unknown' END AS kind FROM supplier""",
    "specialty_rules": """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'clinician'
          WHEN c_custkey % 11 > c_custkey % 6 THEN 'drug_discovery' ELSE 'translational' END AS specialty, CASE WHEN c_custkey % 5 = 0
            OR c_custkey % 7 = 0 OR c_custkey % 11 > c_custkey % 6 THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence FROM customer""",
    "strong_key_lookup": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 AND c_custkey % 2 = 0 THEN c_custkey::VARCHAR
          WHEN c_custkey % 3 = 0 THEN 'x' || c_custkey END AS uuid, CASE WHEN o_orderkey % 4 > 0 AND c_custkey % 2 = 0 THEN 'orcid'
            WHEN c_custkey % 3 = 0 THEN 'era_commons' END AS matched_by FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "longest_prefix_join": """WITH x AS (SELECT * FROM (VALUES ('BRAND#', 'any'), ('BRAND#1', 'ones'), ('BRAND#12', 'twelve'), ('BRAND#2',
          'twos')) v(prefix, term)), c AS (SELECT DISTINCT upper(p_brand) AS code FROM part) SELECT code, prefix, term FROM c LEFT
                JOIN x ON starts_with(code, prefix) QUALIFY row_number() OVER (PARTITION BY code ORDER BY length(prefix) DESC) = 1""",
    "npi_match": """WITH p AS (SELECT c_custkey AS u, n_name, c_custkey % 5 = 0 AND c_custkey % 7 <> 0 AS whole, c_custkey % 7 <> 0 AS last,
          c_custkey % 2 = 0 AS sp, contains(upper(n_name), CASE WHEN c_custkey % 3 = 0 THEN 'IA' ELSE 'ZZ' END) AS ad FROM customer
            JOIN nation ON n_nationkey = c_nationkey),
      c AS (SELECT *, round(least((CASE WHEN whole THEN 1.0 WHEN last THEN 0.7 ELSE 0.3 END)::DOUBLE + 0.1::DOUBLE * sp::INT + 0.1::DOUBLE * ad::INT,
        1.0), 6) AS k FROM p)
      SELECT u AS uuid, k AS confidence, CASE WHEN k >= 0.95 THEN 'auto-link' WHEN k >= 0.5 THEN 'review' ELSE 'reject' END AS action,
        array_to_string(list_filter([CASE WHEN NOT last THEN 'name_mismatch' END, CASE WHEN NOT sp THEN 'specialty_mismatch' END, CASE
          WHEN NOT ad THEN 'address_mismatch' END], lambda x: x IS NOT NULL), ',') AS signals FROM c""",
    "shared_key_pairs": """WITH p AS (SELECT x.c_custkey AS a, y.c_custkey AS b, (x.c_custkey // 3 = y.c_custkey // 3)::INT + (x.c_custkey % 2 = 0
          AND y.c_custkey % 2 = 0 AND x.c_custkey // 6 = y.c_custkey // 6)::INT AS k,
            (x.c_custkey // 5 = y.c_custkey // 5)::INT + (x.c_custkey // 4 = y.c_custkey // 4)::INT AS m FROM customer x
                  JOIN customer y ON y.c_custkey > x.c_custkey AND y.c_custkey < x.c_custkey + 6)
      SELECT a, b, k::BIGINT AS n_keys, m::BIGINT AS n_names, round(CASE WHEN k > 0 THEN least(0.95 + 0.02 * k, 1.0) ELSE least(0.5 + 0.15 * m,
        0.9) END, 6)::DOUBLE AS confidence, CASE WHEN k > 0 THEN 'strong_key' ELSE 'review_needed' END AS kind FROM p WHERE k + m > 0""",
    "coauthor_two_hop": f"""WITH {PAPERS_SQL}, w AS (SELECT DISTINCT uuid, work * 1000 + month(published) AS work FROM papers), e AS (SELECT DISTINCT
          x.uuid AS a, y.uuid AS b FROM w x JOIN w y USING (work) WHERE x.uuid <> y.uuid),
      h0 AS (SELECT c_custkey AS uuid, 0 AS hop, c_custkey AS seed FROM customer WHERE c_custkey % 100 = 0), h1 AS (SELECT b AS uuid, 1 AS hop,
        min(seed) AS seed FROM h0 JOIN e ON a = uuid WHERE b NOT IN (SELECT uuid FROM h0) GROUP BY b),
      h2 AS (SELECT b AS uuid, 2 AS hop, min(seed) AS seed FROM h1 JOIN e ON a = uuid WHERE b NOT IN (SELECT uuid FROM h0) AND b NOT IN (SELECT uuid
        FROM h1) GROUP BY b) SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2""",
    "contradictions": """WITH p AS (SELECT s_suppkey AS u, CASE s_suppkey % 3 WHEN 0 THEN 'academic' WHEN 1 THEN 'industry' ELSE 'unknown' END AS a,
          CASE WHEN s_suppkey % 5 = 0 THEN 'industry' ELSE 'academic' END AS b, s_suppkey % 7 = 0 AS f FROM supplier
            WHERE s_suppkey % 4 <> s_suppkey % 6)
      SELECT u AS uuid, CASE WHEN f OR (a <> b AND a <> 'unknown') THEN 'major' ELSE 'minor' END AS severity, f OR (a <> b
        AND a <> 'unknown') AS flagged FROM p""",
    "jaccard_pairs": f"""WITH {PAPERS_SQL}, s AS (SELECT DISTINCT uuid, work FROM papers), n AS (SELECT uuid, count(*) AS n FROM s GROUP BY uuid),
          p AS (SELECT x.uuid AS a, y.uuid AS b, count(*) AS k FROM s x JOIN s y USING (work) WHERE x.uuid < y.uuid GROUP BY ALL)
      SELECT a, b, round(k / (x.n + y.n - k)::DOUBLE, 6) AS jaccard FROM p JOIN n x ON x.uuid = a JOIN n y ON y.uuid = b
        WHERE round(k / (x.n + y.n - k)::DOUBLE, 6) >= 0.05""",
}
