from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from meritgrid.sources import records
from meritgrid.streaming import events

ARTICLE = """<?xml version="1.0"?><PubmedArticleSet><PubmedArticle><MedlineCitation Status="MEDLINE"><PMID>123</PMID><Article>
<Journal><JournalIssue><PubDate><Year>2024</Year><Month>03</Month><Day>15</Day></PubDate></JournalIssue></Journal><ArticleTitle>A title</ArticleTitle>
<Abstract><AbstractText>First part.</AbstractText><AbstractText>Second part.</AbstractText></Abstract><AuthorList>
<Author><LastName>Roe</LastName><ForeName>Jane</ForeName><Initials>J</Initials><Identifier>https://orcid.org/0000-1</Identifier><AffiliationInfo><Affiliation>Uni A, a@b.org</Affiliation></AffiliationInfo></Author>
<Author><LastName>Poe</LastName><ForeName>Al</ForeName><Initials>A</Initials></Author></AuthorList><PublicationTypeList><PublicationType>Journal Article</PublicationType></PublicationTypeList></Article>
<MedlineJournalInfo><NlmUniqueID>99</NlmUniqueID></MedlineJournalInfo><MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN="N">Lung</DescriptorName><QualifierName MajorTopicYN="Y">genetics</QualifierName></MeshHeading>
<MeshHeading><DescriptorName MajorTopicYN="N">Humans</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_publications(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ARTICLE)
    df = records.publications(spark, str(tmp_path))
    r = df.collect()[0]
    assert r["pmid"] == "123" and r["abstract"] == "First part." and r["publication_date"] == dt.date(2024, 3, 15) and r["medline_indexed"]
    assert [a["is_last_author"] for a in r["authors"]] == [False, True] and r["authors"][0]["orcid"] == "0000-1"
    assert [(m["descriptor"], m["qualifier"], m["major_topic"]) for m in r["mesh_descriptors"]] == [
        ("Lung", "genetics", True),
        ("Humans", None, False),
    ]
    p = records.publication_people(df).collect()[0]
    assert p["name"] == "Al Poe" and p["confidence"] == 0.70 and p["terms"] == ["Lung", "Humans"]


def test_grants_and_trials(spark, tmp_path):
    grant = {
        "project_num": "5R01CA1",
        "activity_code": "",
        "abstract_text": "x" * 900,
        "fiscal_year": 2020,
        "award_amount": 5,
        "is_active": True,
        "terms": "a;b",
        "organization": {"org_name": "Uni"},
        "principal_investigators": [
            {"full_name": "Jane Roe", "profile_id": "7", "is_contact_pi": True},
            {"full_name": "Al Poe", "profile_id": None, "is_contact_pi": False},
        ],
    }
    (tmp_path / "g.json").write_text(json.dumps({"results": [grant]}))
    g = records.grants(spark, str(tmp_path / "g.json"))
    r = g.collect()[0]
    assert r["activity_code"] == "R01" and len(r["abstract_text"]) == 500 and [p["role"] for p in r["pis"]] == ["Contact PI", "Co-PI"]
    people = {p["name"]: p for p in records.grant_people(g).collect()}
    assert people["Jane Roe"]["confidence"] == 0.93 and people["Al Poe"]["confidence"] == 0.78 and people["Al Poe"]["updated"] == dt.date(2020, 7, 1)
    study = {"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": "t"}, "statusModule": {"overallStatus": "DONE", "lastUpdatePostDateStruct": {"date": "2021-05-06"}}, "conditionsModule": {"conditions": ["c"]}, "designModule": {"phases": ["PHASE2", "PHASE3"]}, "contactsLocationsModule": {"overallOfficials": [{"name": "P", "role": "PRINCIPAL_INVESTIGATOR"}, {"name": "C", "role": "STUDY_CHAIR"}], "locations": [{"facility": "F", "contacts": [{"name": "S", "role": "SUB_INVESTIGATOR"}, {"name": "X", "role": "CONTACT"}]}]}}}
    (tmp_path / "t.json").write_text(json.dumps({"studies": [study, study]}))
    t = records.trials(spark, str(tmp_path / "t.json"))
    r = t.collect()
    assert len(r) == 1 and [(i["full_name"], i["role"]) for i in r[0]["investigators"]] == [("P", "PI"), ("C", "Chair"), ("S", "Sub-I")]
    merged = records.ingest(records.grant_people(g).unionByName(records.trial_people(t)))
    assert merged.count() == 3


def test_lists(spark, tmp_path):
    (tmp_path / "leie.csv").write_text(
        "LASTNAME,FIRSTNAME,NPI,EXCLTYPE,EXCLDATE,REINDATE,STATE,SPECIALTY\nRoe,Jane,0000000000,1128a1,20200102,00000000,CA,\n"
    )
    r = records.exclusions(spark, str(tmp_path / "leie.csv")).collect()[0]
    assert r["npi"] is None and r["exclusion_date"] == dt.date(2020, 1, 2) and r["reinstate_date"] is None and r["specialty"] is None
    (tmp_path / "sdn.csv").write_text('1,"DOE, John ",individual,X\n2,-0-,individual,X\n3\n')
    assert [r["primary_name"] for r in records.sanctions(spark, str(tmp_path / "sdn.csv")).collect()] == ["DOE, John"]
    assert records.json_log(spark, str(tmp_path / "missing.jsonl"), "a string").count() == 0


def feed(tmp_path, name, rows):
    (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_feed_is_deduplicated(spark, tmp_path):
    source = tmp_path / "feed"
    source.mkdir()
    item = lambda i, t: {"id": i, "title": t, "link": "l", "summary": "", "published": "2024-01-01T00:00:00Z"}
    feed(source, "1.json", [item("1", "a finding; Jane Roe."), item("2", "b")])
    schema = "id string, title string, link string, summary string, published timestamp"
    seen: list = []
    stream = events.new_entries(events.feed(spark, str(source), schema))
    for _ in range(2):
        q = events.dispatch(stream, [lambda df, n: seen.extend(r["id"] for r in df.collect())], str(tmp_path / "checkpoint"), availableNow=True)
        q.awaitTermination()
        feed(source, "2.json", [item("2", "b"), item("3", "c")])
    assert sorted(seen) == ["1", "2", "3"]


def test_feed_events(spark):
    df = spark.createDataFrame(
        [
            ("1", "Case of misconduct finding; Jane Roe.", "", "l", dt.datetime(2024, 1, 1)),
            ("2", "Retraction by Al Poe and by Cy Dee PMID: 77", "data fabricated", "l", dt.datetime(2024, 1, 1)),
            ("3", "Delisted: X", "", "l", dt.datetime(2024, 1, 1)),
        ],
        "id string, title string, summary string, link string, published timestamp",
    )
    assert [(r["id"], r["subject"]) for r in events.misconduct_events(df).collect()] == [("1", "Jane Roe")]
    r = {x["id"]: x for x in events.retraction_events(df).collect()}["2"]
    assert r["pmid"] == "77" and r["subject"] == "Al Poe" and r["others"] == ["Cy Dee"] and r["severity"] == "critical"
    assert {x["id"]: x["action"] for x in events.sanction_events(df).collect()}["3"] == "removed"


def test_token_bucket_stream_agrees_with_replay(spark, tmp_path):
    rows = [(1, i, f"2024-01-01T00:00:{i:02d}Z") for i in range(20)] + [(2, 100 + i, "2024-01-01T00:00:00Z") for i in range(5)]
    source = tmp_path / "requests"
    source.mkdir()
    feed(source, "1.json", [{"customer": c, "id": i, "ts": t} for c, i, t in rows])
    stream = events.feed(spark, str(source), "customer long, id long, ts timestamp")
    q = events.token_buckets(stream, 0.5, 2.0).writeStream.format("memory").queryName("buckets").outputMode("append").option(
        "checkpointLocation",
        str(tmp_path / "c"),
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["id"]: r["allowed"] for r in spark.table("buckets").collect()}
    batch = spark.read.schema("customer long, id long, ts timestamp").json(str(source))
    assert got == {r["id"]: r["allowed"] for r in events.replay_buckets(batch, 0.5, 2.0).collect()}
    assert sum(got[100 + i] for i in range(5)) == 2 and 9 <= sum(got[i] for i in range(20)) <= 12


def test_windows_on_a_stream(spark, tmp_path):
    source = tmp_path / "e"
    source.mkdir()
    feed(source, "1.json", [{"ts": f"2024-01-01T0{h}:10:00Z", "k": "a"} for h in range(6)])
    stream = spark.readStream.schema("ts timestamp, k string").json(str(source))
    counted = events.windowed_counts(stream, "ts", "1 hour", None, "30 minutes", "k")
    q = counted.writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).option(
        "checkpointLocation",
        str(tmp_path / "cw"),
    ).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 6
