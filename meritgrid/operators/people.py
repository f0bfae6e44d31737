"""People across keys: records, stored people and fuzzy links as one graph, its components as persons.

Records that share a value of a strong key (ORCID, account, NPI, ...) are one person, and so are a record and the stored
person to whom a fuzzy link is certain, over any number of steps and in whatever order they arrive. A key joins its
holders by a star around the smallest of them, not pair by pair, so a key may have any share of all rows.

A person keeps the stored uuid; where a component holds several, the smallest survives and the others are absorbed.
A component without one gets a uuid made of its smallest key, so a repeated run makes the same; a record without keys
or links, one of its own id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.functions.graph import named_components
from meritgrid.functions.positions import settled

#: Kinds of nodes: stored people sort before records.
_STORED, _RECORD = "s:", "r:"


def made_uuid(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def _keys(rows: DataFrame, id_: Column) -> DataFrame:
    """(node, key) for each strong key of (strong_keys map) that has a value."""
    long = rows.select(id_.alias("node"), F.explode("strong_keys").alias("t", "v")).where("v is not null and trim(v) <> ''")
    return long.select("node", F.concat_ws(":", "t", F.trim("v")).alias("key"))


def person_graph(records: DataFrame, stored: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with their keys, edges): `records` (id, strong_keys), `stored` (uuid, strong_keys), `links` (id, uuid)."""
    record, person = F.concat(F.lit(_RECORD), F.col("id").cast("string")), F.concat(F.lit(_STORED), F.col("uuid").cast("string"))
    keys = settled(_keys(records, record).unionByName(_keys(stored, person)).distinct(), "keys of people")
    centres = keys.groupBy("key").agg(F.min("node").alias("b"))
    stars = keys.join(centres, "key").select(F.col("node").alias("a"), "b")
    certain = links.where("id is not null and uuid is not null").select(record.alias("a"), person.alias("b"))
    # a link to a person that is not stored leads nowhere
    certain = certain.join(stored.select(person.alias("b")).distinct(), "b", "left_semi").select("a", "b")
    alone = records.select(record.alias("a"), record.alias("b")).unionByName(stored.select(person.alias("a"), person.alias("b")))
    return keys, stars.unionByName(certain).unionByName(alone)


def resolve_people(records: DataFrame, stored: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id, uuid, is_new): of each record the person it belongs to, and of each stored uuid the one that survives.

    Rows with a null id are no records. The result does not depend on the order of rows."""
    records, stored = records.where("id is not null"), stored.where("uuid is not null")
    keys, edges = person_graph(records, stored, links)
    groups = settled(named_components(edges.distinct()), "people")
    first = groups.join(keys, groups["id"] == keys["node"], "left").groupBy("component").agg(
        F.min(F.when(F.col("id").startswith(_STORED), F.substring("id", 3, 1 << 30))).alias("known"), F.min("key").alias("key")
    )
    uuid = F.coalesce("known", made_uuid(F.coalesce("key", F.concat(F.lit("id:"), F.substring("component", 3, 1 << 30)))))
    named = first.select("component", uuid.alias("uuid"), F.col("known").isNull().alias("is_new"))
    kind = F.when(F.col("id").startswith(_STORED), "stored").otherwise("record")
    return groups.join(named, "component").select(kind.alias("kind"), F.substring("id", 3, 1 << 30).alias("id"), "uuid", "is_new")


def merged_people(rows: DataFrame, people: DataFrame) -> DataFrame:
    """One row a person out of (kind, id, strong_keys, names, refs, populations, specialties, confidence) and what
    `resolve_people` says: all names, references and populations once and in order, of each kind of key the smallest
    value and how many others there are, of each specialty the largest probability, the largest confidence, and the
    number of records and stored people."""
    joined = settled(rows.withColumn("id", F.col("id").cast("string")).join(people.select("kind", "id", "uuid"), ["kind", "id"]), "rows of people")

    def united(column: str) -> DataFrame:
        return joined.select("uuid", F.explode(column).alias("v")).where("v is not null").groupBy("uuid").agg(F.array_sort(F.collect_set("v")).alias(column))

    pairs = joined.select("uuid", F.explode("strong_keys").alias("t", "v")).where("v is not null")
    kinds = pairs.groupBy("uuid", "t").agg(F.min("v").alias("v"), (F.count_distinct("v") - 1).alias("more"))
    keys = kinds.groupBy("uuid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "v")))).alias("strong_keys"),
        F.sum("more").alias("conflicts"))
    shares = joined.select("uuid", F.explode("specialties").alias("t", "p")).groupBy("uuid", "t").agg(F.max("p").alias("p"))
    specialties = shares.groupBy("uuid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "p")))).alias("specialties"))
    out = joined.groupBy("uuid").agg(
        F.count_if(F.col("kind") == "record").alias("n_records"), F.count_if(F.col("kind") == "stored").alias("n_stored"),
            F.max("confidence").alias("confidence")
    )
    for part in (united("names"), united("refs"), united("populations"), keys, specialties):
        out = out.join(part, "uuid", "left")
    return out.withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))
