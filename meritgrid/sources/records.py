"""Landed raw records as DataFrames: publication XML, grant and trial JSON, works, exclusion lists, JSONL logs, YAML.

Readers state their schema, so nothing is inferred; what a source cannot parse becomes null.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE_XML = """MedlineCitation STRUCT<_Status STRING, PMID STRING, Article STRUCT<ArticleTitle STRING, Abstract STRUCT<AbstractText ARRAY<STRING>>,
  Journal STRUCT<JournalIssue STRUCT<PubDate STRUCT<Year STRING, Month STRING, Day STRING>>>, ArticleDate ARRAY<STRUCT<Year STRING, Month STRING,
    Day STRING>>,
  AuthorList STRUCT<Author ARRAY<STRUCT<LastName STRING, ForeName STRING, Initials STRING, Identifier ARRAY<STRING>,
    AffiliationInfo ARRAY<STRUCT<Affiliation STRING>>>>>,
  PublicationTypeList STRUCT<PublicationType ARRAY<STRING>>>,
  MedlineJournalInfo STRUCT<NlmUniqueID STRING>,
  MeshHeadingList STRUCT<MeshHeading ARRAY<STRUCT<DescriptorName STRUCT<_VALUE STRING, _MajorTopicYN STRING>,
    QualifierName ARRAY<STRUCT<_VALUE STRING, _MajorTopicYN STRING>>>>>>"""

GRANT_JSON = """project_num STRING, activity_code STRING, project_title STRING, abstract_text STRING, fiscal_year INT, award_amount BIGINT,
  award_notice_date STRING,
  is_active BOOLEAN, terms STRING, organization STRUCT<org_name STRING>, principal_investigators ARRAY<STRUCT<full_name STRING, profile_id STRING,
    is_contact_pi BOOLEAN>>"""

TRIAL_JSON = """protocolSection STRUCT<identificationModule STRUCT<nctId STRING, briefTitle STRING>, statusModule STRUCT<overallStatus STRING,
  lastUpdatePostDateStruct STRUCT<date STRING>>,
  conditionsModule STRUCT<conditions ARRAY<STRING>>, designModule STRUCT<phases ARRAY<STRING>, studyType STRING>,
  contactsLocationsModule STRUCT<overallOfficials ARRAY<STRUCT<name STRING, role STRING, affiliation STRING>>,
    locations ARRAY<STRUCT<facility STRING, contacts ARRAY<STRUCT<name STRING, role STRING>>>>>>"""

WORK_JSON = """id STRING, doi STRING, title STRING, publication_date STRING, type STRING, cited_by_count BIGINT, ids STRUCT<pmid STRING>,
  concepts ARRAY<STRUCT<id STRING, display_name STRING, score DOUBLE>>, authorships ARRAY<STRUCT<author STRUCT<id STRING, display_name STRING,
    orcid STRING>, author_position STRING, raw_affiliation_strings ARRAY<STRING>>>,
  grants ARRAY<STRUCT<award_id STRING, funder_display_name STRING>>"""

RATIO_JSON = """pmid BIGINT, year INT, relative_citation_ratio DOUBLE, citation_count BIGINT, expected_citations_per_year DOUBLE,
  field_citation_rate DOUBLE,
  is_research_article BOOLEAN, doi STRING"""

AUTHOR_JSON = """id STRING, display_name STRING, orcid STRING, works_count BIGINT, cited_by_count BIGINT,
  last_known_institutions ARRAY<STRUCT<id STRING, display_name STRING, country_code STRING>>, affiliations ARRAY<STRUCT<id STRING,
    display_name STRING, country_code STRING>>,
  x_concepts ARRAY<STRUCT<id STRING, display_name STRING, score DOUBLE>>, concepts ARRAY<STRUCT<id STRING, display_name STRING, score DOUBLE>>"""

FUNDER_JSON = "id STRING, display_name STRING, country_code STRING, grants_count BIGINT, works_count BIGINT"

NOTICE_JSON = """title ARRAY<STRING>, author ARRAY<STRUCT<given STRING, family STRING>>, DOI STRING, `container-title` ARRAY<STRING>,
  issued STRUCT<`date-parts` ARRAY<ARRAY<INT>>>"""

# Roles of investigators, confidence of a record's person by source and key, and caps of lists.
OFFICIAL_ROLES = {"PRINCIPAL_INVESTIGATOR": "PI", "STUDY_CHAIR": "Chair", "STUDY_DIRECTOR": "Director", "SUB_INVESTIGATOR": "Sub-I"}
CONFIDENCE = {"pubmed": (0.85, 0.70), "reporter": (0.93, 0.78), "ctgov": (0.72, 0.72), "openalex": (0.85, 0.65)}
MOST_TERMS, MOST_CATEGORIES = 30, 10


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date from text parts: a month in letters is January, a missing day the first, a day that does not exist
    falls back to 1 January."""
    y = F.when(year.rlike("^[0-9]+$"), year.cast("int"))
    m = F.when(month.rlike("^[0-9]+$"), month.cast("int")).otherwise(1)
    d = F.when(day.rlike("^[0-9]+$"), day.cast("int")).otherwise(1)
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when(y.isNotNull(), F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"), F.make_date(y, F.lit(1), F.lit(1))))


def publications(spark: SparkSession, path: str) -> DataFrame:
    """Articles out of XML files: pmid, title, first paragraph of the abstract, date, type, authors, terms."""
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(ARTICLE_XML).load(path)
    c, a = "MedlineCitation", "MedlineCitation.Article"
    issue, own = F.col(f"{a}.Journal.JournalIssue.PubDate"), F.get(F.col(f"{a}.ArticleDate"), F.lit(0))
    has = issue["Year"].isNotNull()
    part = lambda k: F.when(has, issue[k]).otherwise(own[k])
    people = F.col(f"{a}.AuthorList.Author")
    authors = F.transform(
        people,
        lambda p, i: F.struct(
            F.concat_ws(" ", p["ForeName"], p["LastName"]).alias("full_name"),
            p["LastName"].alias("last_name"),
            p["Initials"].alias("initials"),
            F.substring_index(F.get(p["Identifier"], F.lit(0)), "/", -1).alias("orcid"),
            F.transform(
                F.coalesce(p["AffiliationInfo"], F.array().cast("array<struct<Affiliation:string>>")),
                lambda x: x["Affiliation"],
            ).alias("affiliations"),
            (i == F.size(people) - 1).alias("is_last_author"),
        ),
    )
    return raw.select(
        F.col(f"{c}.PMID").alias("pmid"),
        F.col(f"{a}.ArticleTitle").alias("title"),
        F.get(F.col(f"{a}.Abstract.AbstractText"), F.lit(0)).alias("abstract"),
        F.col(f"{c}.MedlineJournalInfo.NlmUniqueID").alias("journal_nlm_id"),
        (F.lower(F.col(f"{c}._Status")) == "medline").alias("medline_indexed"),
        _date(part("Year"), part("Month"), part("Day")).alias("publication_date"),
        F.get(F.col(f"{a}.PublicationTypeList.PublicationType"), F.lit(0)).alias("article_type"),
        authors.alias("authors"),
        headings(F.col(f"{c}.MeshHeadingList.MeshHeading")).alias("mesh_descriptors"),
    )


def headings(raw: Column) -> Column:
    """Descriptor and qualifier, one entry a pair and one without a qualifier where there is none; a topic is major
    if either says so."""
    none = F.array(F.struct(F.lit(None).cast("string").alias("_VALUE"), F.lit("N").alias("_MajorTopicYN")))
    def pairs(h: Column) -> Column:
        q = F.when(F.size(h["QualifierName"]) > 0, h["QualifierName"]).otherwise(none)
        d = h["DescriptorName"]
        return F.transform(
            q,
            lambda x: F.struct(
                d["_VALUE"].alias("descriptor"),
                x["_VALUE"].alias("qualifier"),
                ((d["_MajorTopicYN"] == "Y") | (x["_MajorTopicYN"] == "Y")).alias("major_topic"),
            ),
        )

    return F.flatten(
        F.transform(
            F.coalesce(
                raw,
                F.array().cast(
                    T.ArrayType(
                        T.StructType.fromDDL(
                            "DescriptorName STRUCT<_VALUE STRING, _MajorTopicYN STRING>, QualifierName ARRAY<STRUCT<_VALUE STRING, _MajorTopicYN STRING>>"
                        )
                    )
                ),
            ),
            pairs,
        )
    )


def grants(spark: SparkSession, path: str) -> DataFrame:
    """Grants out of landed pages {results: [...]}; the activity code falls back to the letters of the number."""
    pages = spark.read.schema(f"results ARRAY<STRUCT<{_struct(GRANT_JSON)}>>").json(path, multiLine=True)
    g = pages.select(F.inline("results"))
    code = F.coalesce(F.nullif(F.col("activity_code"), F.lit("")), F.substring(F.regexp_replace("project_num", "^[0-9]+", ""), 1, 3))
    return g.select(
        F.col("project_num").alias("project_number"), code.alias("activity_code"), "project_title", F.substring(
            "abstract_text",
            1,
            500,
        ).alias("abstract_text"), F.col("award_amount").alias("total_cost"), "fiscal_year",
        F.transform(
            F.split("terms", ";"),
            F.trim,
        ).alias("project_terms"), F.col("organization.org_name").alias("organization_name"), F.to_date(F.substring("award_notice_date", 1,
            10)).alias("award_notice_date"), "is_active",
        F.transform(
            "principal_investigators",
            lambda p: F.struct(
                p["full_name"].alias("full_name"),
                p["profile_id"].alias("era_id"),
                F.when(p["is_contact_pi"], "Contact PI").otherwise("Co-PI").alias("role"),
            ),
        ).alias("pis"),
    )


def _struct(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl)) if not ddl.startswith("STRUCT") else ddl


def trial_page() -> str:
    """The schema of a page of trials."""
    return f"studies ARRAY<STRUCT<{_struct(TRIAL_JSON)}>>"


def trials(spark: SparkSession, path: str) -> DataFrame:
    """`trials_of` landed pages {studies: [...]}."""
    return trials_of(spark.read.schema(trial_page()).json(path, multiLine=True))


def trials_of(pages: DataFrame) -> DataFrame:
    """Trials out of pages with `studies`, each trial once. Investigators are officials, of unknown role as principal,
    and site contacts of known roles."""
    s = pages.select(F.explode("studies").alias("s")).select("s.protocolSection.*")
    roles = F.create_map(*(F.lit(x) for kv in OFFICIAL_ROLES.items() for x in kv))
    person = "array<struct<full_name:string,role:string,affiliation:string,site:string>>"
    none = F.array().cast(person)
    officials = F.transform(
        "contactsLocationsModule.overallOfficials",
        lambda o: F.struct(
            o["name"].alias("full_name"),
            F.coalesce(roles[o["role"]], F.lit("PI")).alias("role"),
            o["affiliation"].alias("affiliation"),
            F.lit(None).cast("string").alias("site"),
        ),
    )
    sites = F.flatten(
        F.transform(
            "contactsLocationsModule.locations",
            lambda x: F.transform(
                F.filter(F.coalesce(x["contacts"], F.array().cast("array<struct<name:string,role:string>>")), lambda k: roles[k["role"]].isNotNull()),
                lambda k: F.struct(
                    k["name"].alias("full_name"),
                    roles[k["role"]].alias("role"),
                    x["facility"].alias("affiliation"),
                    x["facility"].alias("site"),
                ),
            ),
        )
    )
    rows = s.select(
        F.col("identificationModule.nctId").alias("nct_id"), F.col("identificationModule.briefTitle").alias("title"),
            F.col("conditionsModule.conditions").alias("conditions"), F.array_join(
            "designModule.phases",
            "/",
        ).alias("phase"),
        F.col("designModule.studyType").alias("study_type"), F.col("statusModule.overallStatus").alias("status"),
            F.to_date("statusModule.lastUpdatePostDateStruct.date").alias("last_update"), F.concat(
            F.coalesce(officials, none),
            F.coalesce(sites, none),
        ).alias("investigators"),
    )
    return _one_of_each(rows, "nct_id", F.desc("last_update"))


def works(spark: SparkSession, path: str) -> DataFrame:
    """Works out of landed pages {results: [...]}; the pmid is the last part of its address."""
    w = spark.read.schema(f"results ARRAY<STRUCT<{_struct(WORK_JSON)}>>").json(path, multiLine=True).select(F.inline("results"))
    last = lambda c: F.substring_index(F.rtrim(c, F.lit("/")), "/", -1)
    return w.select(
        last(F.col("id")).alias("openalex_id"), "doi", last(F.col("ids.pmid")).alias("pmid"), "title",
            F.to_date("publication_date").alias("publication_date"), "type", "cited_by_count", "concepts", "grants",
        F.transform(
            "authorships",
            lambda a: F.struct(
                last(a["author"]["id"]).alias("author_id"),
                a["author"]["display_name"].alias("author_name"),
                last(a["author"]["orcid"]).alias("orcid"),
                a["author_position"].alias("position"),
            ),
        ).alias("authorships"),
    )


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """The federal exclusion list: CSV with a header; empty text and impossible dates are null."""
    raw = spark.read.csv(
        path,
        header=True,
        schema="LASTNAME STRING, FIRSTNAME STRING, NPI STRING, EXCLTYPE STRING, EXCLDATE STRING, REINDATE STRING, STATE STRING, SPECIALTY STRING",
        enforceSchema=False,
    )
    date = lambda c: F.expr(f"try_to_date({c}, 'yyyyMMdd')")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return raw.select(
        text("LASTNAME").alias("last_name"), text("FIRSTNAME").alias("first_name"), F.nullif(
            text("NPI"),
            F.lit("0000000000"),
        ).alias("npi"), text("EXCLTYPE").alias("exclusion_type"), date("EXCLDATE").alias("exclusion_date"), date("REINDATE").alias("reinstate_date"),
            text("STATE").alias("state"), text("SPECIALTY").alias("specialty"),
    )


def sanctions(spark: SparkSession, path: str) -> DataFrame:
    """The sanctions list: CSV without a header, columns by place; rows without a name go."""
    raw = spark.read.csv(path, header=False, schema="id STRING, name STRING, kind STRING, program STRING", mode="PERMISSIVE")
    name = F.trim("name")
    return raw.where(F.col("kind").isNotNull() & name.isNotNull() & ~name.isin("", "-0-")).select(
        name.alias("primary_name"),
        F.array().cast("array<string>").alias("aliases"),
        F.trim("kind").alias("record_type"),
        F.trim("program").alias("program"),
    )


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log of JSON lines; blank lines are skipped, a missing file is an empty log."""
    try:
        return spark.read.schema(schema).json(path).na.drop("all")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def yaml_members(spark: SparkSession, folder: str) -> DataFrame:
    """(roster_type, name, institution, year) out of YAML files with a `members` list, in the order of their names.
    These are small hand-kept lists on the driver's side; files without members are skipped."""
    import yaml

    rows = []
    for path in sorted(Path(folder).glob("*.yaml")):
        content = yaml.safe_load(path.read_text()) or {}
        rows += [(content.get("roster_type", path.stem), m.get("name"), m.get("institution"), m.get("year")) for m in content.get("members") or []]
    return spark.createDataFrame(rows, "roster_type string, name string, institution string, year int")


def archetypes(spark: SparkSession, folder: str, in_scope_only: bool = False) -> DataFrame:
    """(archetype_id, name, pmids, nct_ids, grant_ids, in_scope) out of YAML files of known people whose artifacts have to
    be found, one a file; without `in_scope` one is in scope. These are small hand-kept files on the driver's side;
    `logs.archetype_coverage` compares them with what is stored."""
    import yaml

    rows = []
    for path in sorted(Path(folder).glob("*.yaml")):
        own = yaml.safe_load(path.read_text()) or {}
        if own.get("archetype_id") is not None:
            expected = own.get("expected") or {}
            ids = ([str(v) for v in expected.get(k) or []] for k in ("pmids", "nct_ids", "grant_ids"))
            rows.append((str(own["archetype_id"]), own.get("name"), *ids, bool(own.get("in_scope", True))))
    schema = "archetype_id string, name string, pmids array<string>, nct_ids array<string>, grant_ids array<string>, in_scope boolean"
    found = spark.createDataFrame(rows, schema)
    return found.where("in_scope") if in_scope_only else found


def publication_people(articles: DataFrame) -> DataFrame:
    """One person an article: the last author, or the first author where none is marked last."""
    last = F.get(F.filter("authors", lambda a: a["is_last_author"]), F.lit(0))
    person = F.coalesce(last, F.get("authors", F.lit(0)))
    with_orcid, without = CONFIDENCE["pubmed"]
    rows = articles.where(F.size("authors") > 0).withColumn("p", person)
    orcid = F.nullif(F.col("p.orcid"), F.lit(""))
    return rows.select(
        F.col("p.full_name").alias("name"), orcid.alias("orcid"), F.lit(None).cast("string").alias("era"), F.substring(
            F.get("p.affiliations", F.lit(0)),
            1,
            200,
        ).alias("affiliation"), F.array("pmid").alias("pmids"), F.array().cast("array<string>").alias("grant_ids"),
            F.array().cast("array<string>").alias("nct_ids"),
        F.slice(
            F.transform("mesh_descriptors", lambda m: m["descriptor"]),
            1,
            MOST_TERMS,
        ).alias("terms"), F.when(
            orcid.isNotNull(),
            with_orcid,
        ).otherwise(without).alias("confidence"), F.col("publication_date").alias("updated"), F.lit("pubmed").alias("source"),
    )


def grant_people(rows: DataFrame) -> DataFrame:
    """One person for each investigator of a grant."""
    known, unknown = CONFIDENCE["reporter"]
    g = rows.withColumn("p", F.explode("pis"))
    return g.select(
        F.col("p.full_name").alias("name"), F.lit(None).cast("string").alias("orcid"), F.col("p.era_id").alias("era"),
            F.col("organization_name").alias("affiliation"), F.array().cast("array<string>").alias("pmids"),
                F.array("project_number").alias("grant_ids"), F.array().cast("array<string>").alias("nct_ids"),
        F.slice("project_terms", 1, MOST_CATEGORIES).alias("terms"), F.when(F.col("p.era_id").isNotNull(),
            known).otherwise(unknown).alias("confidence"), F.coalesce(
            "award_notice_date",
            F.make_date("fiscal_year", F.lit(7), F.lit(1)),
        ).alias("updated"), F.lit("reporter").alias("source"),
    )


def trial_people(rows: DataFrame) -> DataFrame:
    """One person for each principal investigator of a trial."""
    t = rows.withColumn("p", F.explode(F.filter("investigators", lambda i: i["role"] == "PI")))
    return t.select(
        F.col("p.full_name").alias("name"), F.lit(None).cast("string").alias("orcid"), F.lit(None).cast("string").alias("era"),
            F.col("p.affiliation").alias("affiliation"), F.array().cast("array<string>").alias("pmids"),
                F.array().cast("array<string>").alias("grant_ids"), F.array("nct_id").alias("nct_ids"),
        F.slice(
            "conditions",
            1,
            MOST_CATEGORIES,
        ).alias("terms"), F.lit(CONFIDENCE["ctgov"][0]).alias("confidence"), F.col("last_update").alias("updated"), F.lit("ctgov").alias("source"),
    )


def citation_ratios(spark: SparkSession, path: str) -> DataFrame:
    """Citation ratios out of landed pages {data: [...]}, one row a pmid, the latest year of repeats: pmid, year, rcr,
    citation_count, expected_citations, field_rate, is_research_article, doi."""
    pages = spark.read.schema(f"data ARRAY<STRUCT<{_struct(RATIO_JSON)}>>").json(path, multiLine=True).select(F.inline("data"))
    rows = pages.select(
        F.col("pmid").cast("string").alias("pmid"),
        "year",
        F.col("relative_citation_ratio").alias("rcr"),
        F.coalesce("citation_count", F.lit(0)).alias("citation_count"),
        F.col("expected_citations_per_year").alias("expected_citations"),
        F.col("field_citation_rate").alias("field_rate"),
        F.coalesce("is_research_article", F.lit(False)).alias("is_research_article"),
        "doi",
    )
    return _one_of_each(rows.where("pmid is not null"), "pmid", F.desc("year"))


def _one_of_each(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by the order, then by all columns as text, so that the choice is always the same."""
    text = F.to_json(F.struct(*rows.columns))
    placed = rows.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*order, text)))
    return placed.where("_k = 1").drop("_k")


def work_people(rows: DataFrame) -> DataFrame:
    """One person a work: the author in the last place, else the last one listed; nobody without a name."""
    last = F.get(F.filter("authorships", lambda a: a["position"] == "last"), F.lit(0))
    person = F.coalesce(last, F.get("authorships", F.size("authorships") - 1))
    known, unknown = CONFIDENCE["openalex"]
    none = F.array().cast("array<string>")
    named = rows.where(F.size("authorships") > 0).withColumn("p", person).where(F.trim("p.author_name") != "")
    orcid = F.nullif(F.col("p.orcid"), F.lit(""))
    award = lambda g: F.concat_ws("-", F.nullif(g["funder_display_name"], F.lit("")), g["award_id"])
    awards = F.transform(F.filter(F.col("grants"), lambda g: F.coalesce(g["award_id"], F.lit("")) != ""), award)
    return named.select(
        F.trim("p.author_name").alias("name"),
        orcid.alias("orcid"),
        F.lit(None).cast("string").alias("era"),
        F.lit(None).cast("string").alias("affiliation"),
        F.when(F.coalesce("pmid", F.lit("")) != "", F.array("pmid")).otherwise(none).alias("pmids"),
        F.coalesce(awards, none).alias("grant_ids"),
        none.alias("nct_ids"),
        F.coalesce(F.slice(F.transform("concepts", lambda c: c["display_name"]), 1, MOST_CATEGORIES), none).alias("terms"),
        F.when(orcid.isNotNull(), known).otherwise(unknown).alias("confidence"),
        F.col("publication_date").alias("updated"),
        F.lit("openalex").alias("source"),
    )


def work_authors(spark: SparkSession, path: str) -> DataFrame:
    """Authors out of landed pages {results: [...]}: id, name, ORCID, counts, institutions, concepts."""
    raw = spark.read.schema(f"results ARRAY<STRUCT<{_struct(AUTHOR_JSON)}>>").json(path, multiLine=True).select(F.inline("results"))
    places = F.when(F.size("last_known_institutions") > 0, F.col("last_known_institutions")).otherwise(F.col("affiliations"))
    return raw.select(
        F.col("id").alias("openalex_id"),
        "display_name",
        F.substring_index("orcid", "/", -1).alias("orcid"),
        F.coalesce("works_count", F.lit(0)).alias("works_count"),
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"),
        places.alias("institutions"),
        F.coalesce("x_concepts", "concepts").alias("concepts"),
    )


def funders(spark: SparkSession, path: str) -> DataFrame:
    """Funders out of landed pages {results: [...]}."""
    raw = spark.read.schema(f"results ARRAY<STRUCT<{_struct(FUNDER_JSON)}>>").json(path, multiLine=True).select(F.inline("results"))
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return raw.select(F.col("id").alias("openalex_id"), "display_name", "country_code", count("grants_count"), count("works_count"))


def retractions(spark: SparkSession, path: str) -> DataFrame:
    """Retraction notices out of landed pages {message: {items: [...]}}: title, authors, doi, journal, day. A day needs
    year, month and day, and one that does not exist is null."""
    items = T.StructType([T.StructField("items", T.ArrayType(T.StructType.fromDDL(NOTICE_JSON)))])
    pages = spark.read.schema(T.StructType([T.StructField("message", items)])).json(path, multiLine=True)
    raw = pages.select(F.inline("message.items"))
    parts = F.get(F.col("issued")["date-parts"], F.lit(0))
    text = F.format_string("%04d-%02d-%02d", *(F.get(parts, F.lit(i)) for i in range(3)))
    return raw.select(
        F.coalesce(F.get("title", F.lit(0)), F.lit("")).alias("title"),
        F.transform("author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))).alias("authors"),
        F.col("DOI").alias("doi"),
        F.get(F.col("`container-title`"), F.lit(0)).alias("journal"),
        F.when(F.size(parts) >= 3, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")).alias("retraction_date"),
    )


def misconduct_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of misconduct that are kept by hand, as no public file has them: CSV (name, institution, finding_date,
    finding) with a header; a missing file is an empty list."""
    schema = "name STRING, institution STRING, finding_date DATE, finding STRING"
    try:
        return spark.read.csv(path, header=True, schema=schema, enforceSchema=False).where(F.trim("name") != "")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def ingest(people: DataFrame) -> DataFrame:
    """Records of all sources as candidates: those of one id are merged in one aggregation. Lists are distinct unions,
    the best confidence and the latest date a source stay, the first affiliation of the first source by name."""
    from meritgrid.operators.identity import candidate_id

    keyed = people.withColumn("uuid", candidate_id(F.col("orcid"), F.col("era"), F.col("name"), F.col("affiliation")))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    lists = keyed.groupBy("uuid").agg(
        F.array_sort(F.collect_set("name")).alias("name_variants"), F.max("orcid").alias("orcid"), F.max("era").alias("era"), F.min_by(
            "affiliation",
            F.struct("source", "affiliation"),
        ).alias("affiliation"),
        *(union(c).alias(c) for c in ("pmids", "grant_ids", "nct_ids", "terms")), F.max("confidence").alias("linkage_confidence"),
    )
    dates = keyed.groupBy(
        "uuid",
        "source",
    ).agg(F.max("updated").alias("updated")).groupBy("uuid").agg(
        F.map_from_entries(F.collect_list(F.struct("source", "updated"))).alias("last_updated_per_source")
    )
    return lists.join(dates, "uuid")
