"""Lookups by name: rosters, retractions and contests, for one question or a table of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of the pieces by which texts that contain others are found.
PIECE = 3


def roster_members(questions: DataFrame, memberships: DataFrame) -> DataFrame:
    """(id, name, institution, roster_type) of the memberships (name, institution, roster_type) that questions (id,
    asked_name, asked_institution) name, whatever the case. Of several, those whose institution holds the asked one, if
    there are any."""
    members = memberships.withColumn("_k", F.lower("name"))
    met = questions.join(members, F.lower("asked_name") == F.col("_k"))
    asked = F.coalesce(F.col("asked_institution"), F.lit(""))
    own = W.partitionBy("id")
    here = (asked != "") & F.coalesce(F.contains(F.lower("institution"), F.lower(asked)), F.lit(False))
    marked = met.withColumn("_here", here)
    narrowed = marked.withColumns({"_n": F.count(F.lit(1)).over(own), "_any": F.max("_here").over(own)})
    return narrowed.where((F.col("_n") == 1) | ~F.col("_any") | F.col("_here")).select("id", "name", "institution", "roster_type")


def _pieces(text: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size))


def containing(questions: DataFrame, texts: DataFrame, asked: str, text: str) -> DataFrame:
    """Rows of both where `text` holds `asked`, whatever the case: texts are indexed by all their pieces of one to three
    characters, a question asks by its rarest. The empty question is held by every text and is not asked."""
    distinct = texts.select(F.lower(text).alias("_text")).where("length(_text) > 0").distinct()
    sizes = F.sequence(F.lit(1), F.least(F.lit(PIECE), F.length("_text")))
    index = distinct.select("_text", F.explode(F.array_distinct(F.flatten(F.transform(sizes, lambda s: _pieces(F.col("_text"), s))))).alias("_piece"))
    wanted = questions.select(F.lower(asked).alias("_asked")).where("length(_asked) > 0").distinct()
    size = F.least(F.lit(PIECE), F.length("_asked"))
    pieces = wanted.select("_asked", F.explode(F.array_distinct(_pieces(F.col("_asked"), size))).alias("_piece"))
    counts = index.join(pieces.select("_piece").distinct(), "_piece", "left_semi").groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    rarest = pieces.join(counts, "_piece", "left").groupBy("_asked").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)),
        "_piece")).alias("r")).select("_asked", "r._piece")
    held = rarest.join(index, "_piece").where(F.contains("_text", "_asked")).select("_asked", "_text")
    left, right = questions.withColumn("_asked", F.lower(asked)), texts.withColumn("_text", F.lower(text))
    return left.join(held, "_asked").join(right, "_text").drop("_asked", "_text")


def retractions_of_authors(questions: DataFrame, notices: DataFrame) -> DataFrame:
    """(id, pmid, reason) of the notices (pmid, authors, reason) one of whose authors holds the asked name (id, author)."""
    authors = notices.select("pmid", "reason", F.explode("authors").alias("_author"))
    return containing(questions, authors, "author", "_author").select("id", "pmid", "reason").distinct()


def retractions_of_papers(questions: DataFrame, notices: DataFrame) -> DataFrame:
    """(id, pmid, reason) of the notices of asked papers (id, pmid)."""
    return questions.join(notices.select("pmid", "reason"), "pmid").select("id", "pmid", "reason")


def contests_of(contests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Contests of the candidates (uuid), with their place in each one's history, the latest first."""
    order = W.partitionBy("uuid").orderBy(F.desc("submitted_at"), "contest_id")
    return contests.join(candidates.select("uuid").distinct(), "uuid", "left_semi").withColumn("place", F.row_number().over(order))
