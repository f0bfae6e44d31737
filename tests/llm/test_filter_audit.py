from __future__ import annotations

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from meritgrid.llm.components import cut
from meritgrid.llm.filter_audit import audit, op12_filter_audit, text_facts, with_copies, with_marks
from tests.llm.cases import empty, prose, table


def plain(rows: list[tuple[str, str, bool, bool]], filters: str) -> dict[tuple[str, str, int], tuple[int, ...]]:
    """Every order by itself; rows are (part, letters that it fails, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total: dict[str, int] = dict.fromkeys(filters, 0)
        for order in permutations(filters):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                total[x] += len(gone)
                fails = [r for r in own if x in r[1]]
                alone = [r for r in own if r[1] == x]
                out[part, "".join(order), step] = (
                    len(left), len(gone), len(fails) - len(gone), len(alone), sum(r[2] for r in gone), sum(r[3] for r in gone), x,
                )
        for key in [k for k in out if k[0] == part]:
            out[key] = (*out[key][:-1], total[out[key][-1]])
    return out


def found(df) -> dict[tuple[str, str, int], tuple[int, ...]]:
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    out = {(r["part"], "".join(r["filter_order"]), r["step"]): tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("filters", ["A", "ABC", "ABCD"])
def test_audit_equals_every_order_by_itself(spark, filters):
    rng = random.Random(len(filters))
    rows = [
        (rng.choice(["hot", "hot", "hot", "p", "q"]), "".join(x for x in filters if rng.random() < 0.3), rng.random() < 0.5, rng.random() < 0.2)
        for _ in range(200)
    ] + [("clean", "", True, True), ("lost", filters, True, False)]
    df = spark.createDataFrame(rows, "part string, fails string, good boolean, toxic boolean")
    df = df.select("*", *(F.contains("fails", F.lit(x)).alias(x) for x in filters))
    assert found(audit(df, list(filters), ["good", "toxic"])) == plain(rows, filters)


def test_nulls_pass_and_tables_may_be_empty(spark):
    df = spark.createDataFrame([("p", None, None), ("p", True, None)], "part string, x boolean, good boolean")
    row = audit(df, ["x"], ["good"]).collect()
    assert [(r["kept"], r["removed"], r["good_lost"], r["shapley"]) for r in row] == [(1, 1, 0, 1)]
    assert audit(df.limit(0), ["x"], ["good"]).count() == 0
    with pytest.raises(ValueError):
        audit(df, ["x", "x"], [])


def test_facts_and_copies(spark):
    docs = table(spark)
    facts = cut(text_facts(docs), "facts")
    got = {}
    for r in with_copies(facts).collect():
        got.setdefault(r["id"], []).append(r)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    for i, own in got.items():
        want = sorted((len(re.findall(r"[^\x20\x09-\x0D]+", t)), len(set(re.findall(r"[^\x20\x09-\x0D]+", t))), len(t)) for t in texts[i])
        assert sorted((r["n_words"], r["n_distinct"], r["n_points"]) for r in own) == want
    # 7 copies 1; 3 copies 2, as null is empty; repeated rows of id 1 copy nothing, nor does a row without id
    assert {i for i, own in got.items() if any(r["is_copy"] for r in own)} == {3, 7}
    assert with_copies(cut(text_facts(empty(spark)), "facts")).count() == 0


def test_query_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(5)
    texts = [prose(i, rng.choice([5, 190, 210, 400])) for i in range(60)]
    texts += ["again and again " * 100, "SHOUT " * 250 + prose(3, 300), prose(4, 250) + " #", None, "", "Ü" * 10, texts[7], texts[8], texts[8]]
    rows = [(i, t, rng.choice(["a", "a", "b", None, ""])) for i, t in enumerate(texts)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, len(rows), 2)] + [(2, None, None), (None, 1, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    facts = []
    for i, t, s in rows:
        t = t or ""
        w = t.split()
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w))
        fails += "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        fails += "E" * any((u or "") == t for _, u, _ in rows[:i])
        facts.append((s or "", fails, any(k == i and q == 1 for k, q, _ in labels), any(k == i and x == 1 for k, _, x in labels)))
    got = op12_filter_audit(spark, str(tmp_path)).withColumn("filter_order", F.split("filter_order", ""))
    assert found(got) == plain(facts, "ABCDE")


def test_marks_of_rows_without_an_id(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = with_marks(cut(text_facts(table(spark)), "facts"), labels).collect()
    assert {r["id"] for r in rows if r["good"]} == {1} == {r["id"] for r in rows if r["toxic"]}
