from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from meritgrid.sources import paged
from meritgrid.sources.records import trial_page, trials_of
from meritgrid.streaming.events import new_entries


def study(k: int) -> dict:
    return {
        "protocolSection": {
            "identificationModule": {"nctId": f"NCT{k:03d}", "briefTitle": f"Trial {k}"},
            "statusModule": {"overallStatus": "RECRUITING", "lastUpdatePostDateStruct": {"date": "2024-01-02"}},
        }
    }


def put(folder, name: str, body: object) -> None:
    at = folder / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps(body))


@pytest.fixture
def tokens(tmp_path):
    """Three months; the second has three pages, a record twice and an empty last page; the third none."""
    months = [("m1", "2024-01-01", "2024-01-31"), ("m2", "2024-02-01", "2024-02-29"), ("m3", "2024-03-01", "2024-03-31")]
    put(tmp_path, "slices.json", {"paging": "token", "slices": [{"slice": s, "from": a, "to": b} for s, a, b in months]})
    put(tmp_path, "m1/first.json", {"studies": [study(1), study(2)]})
    put(tmp_path, "m2/first.json", {"studies": [study(3), study(4)], "nextPageToken": "t1"})
    put(tmp_path, "m2/t1.json", {"studies": [study(4), study(5)], "nextPageToken": "t2"})
    put(tmp_path, "m2/t2.json", {"studies": [], "nextPageToken": "t3"})
    put(tmp_path, "m3/first.json", {"studies": []})
    return str(tmp_path)


def test_chains_of_tokens_are_walked(spark, tokens):
    got = paged.pages(spark, tokens, records="studies")
    assert got.rdd.getNumPartitions() == 3
    assert sorted((r["slice"], r["page"], r["token"], r["n_records"]) for r in got.collect()) == [("m1", 0, "first", 2), ("m2", 0, "first", 2), ("m2", 1, "t1", 2)]
    bodies = got.select(F.from_json("body", trial_page()).alias("b")).select("b.*")
    assert sorted(r["nct_id"] for r in trials_of(bodies).collect()) == [f"NCT{k:03d}" for k in range(1, 6)]


def test_dates_are_pushed_and_slices_outside_are_not_opened(spark, tokens, tmp_path):
    (tmp_path / "m1" / "first.json").unlink()  # opening it would fail
    some = paged.pages(spark, tokens, records="studies").where(F.col("last_day") >= F.lit(dt.date(2024, 2, 10)))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert ">=" not in plan  # of the condition only a test for null is left above the source
    assert some.rdd.getNumPartitions() == 2
    assert {r["slice"] for r in some.collect()} == {"m2"}
    both = some.where((F.col("first_day") < F.lit(dt.date(2024, 3, 1))) & (F.col("page") > 0))
    assert [(r["slice"], r["page"]) for r in both.collect()] == [("m2", 1)]
    with pytest.raises(Exception, match="first.json"):
        paged.pages(spark, tokens, records="studies").collect()


def test_offsets_are_partitions(spark, tmp_path, monkeypatch):
    put(tmp_path, "slices.json", {"paging": "offset", "page_size": 2, "slices": [{"slice": "a", "total": 5}, {"slice": "b", "total": 0}]})
    for at, own in ((0, [1, 2]), (2, [3, 4]), (4, [5])):
        put(tmp_path, f"a/{at}.json", {"result": {"ids": own}})
    got = paged.pages(spark, str(tmp_path), records="result.ids")
    assert got.rdd.getNumPartitions() == 3
    assert sorted((r["page"], r["n_records"]) for r in got.collect()) == [(0, 2), (2, 2), (4, 1)]
    monkeypatch.setattr(paged, "MOST_PARTITIONS", 2)
    reader = paged.PagedReader({"path": str(tmp_path), "records": "result.ids"})
    assert [p.offsets for p in reader.partitions()] == [[0, 2], [4]]


def test_a_service_without_slices(spark, tmp_path):
    put(tmp_path, "slices.json", {"paging": "token", "slices": []})
    assert paged.pages(spark, str(tmp_path), records="studies").count() == 0


def entry(k: int) -> dict:
    return {"id": f"e{k}", "title": f"T{k}", "link": "l", "published": f"2024-01-01T00:{k:02d}:00+00:00"}


def test_a_feed_started_again_repeats_nothing(spark, tmp_path):
    source, out, check = tmp_path / "feed", str(tmp_path / "out"), str(tmp_path / "check")

    def run() -> list[str]:
        stream = new_entries(paged.polled(spark, str(source), 2))
        stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    put(source, "0001.json", [entry(1), entry(2)])
    put(source, "0002.json", [entry(2), entry(3)])
    assert run() == ["e1", "e2", "e3"]
    assert run() == ["e1", "e2", "e3"]
    for k in range(3, 8):
        put(source, f"{k:04d}.json", [entry(k), entry(k + 1)])
    assert run() == [f"e{k}" for k in range(1, 9)]


def test_polls_are_dealt_to_tasks(tmp_path):
    for k in range(5):
        put(tmp_path, f"{k}.json", [entry(k), {"id": None}])
    reader = paged.FeedReader({"path": str(tmp_path), "polls_per_task": "2"})
    parts = reader.partitions({"polls": 1}, reader.latestOffset())
    assert [(p.start, p.end) for p in parts] == [(1, 3), (3, 5)]
    assert [r[:2] for r in reader.read(parts[0])] == [(1, "e1"), (1, None), (2, "e2"), (2, None)]
