"""Batches that change tables: ingestion with rejects, legacy saves, keyword extraction, venue updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.operators import extract, structuring, upsert


def ingest(current: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw, rejects): current with the records that have an id and a title in place of those of the same source and id; the rest are rejects.

    records have `seq`, their order of arrival: of equal keys the last wins.
    """
    bad = X.blank(F.col("source_paper_id")) | X.blank(F.trim("title"))
    good = records.where(~bad)
    return upsert.upsert(current, good, ["source", "source_paper_id"], [F.col("seq")]), records.where(bad)


def put_keywords(current: DataFrame, new: DataFrame) -> DataFrame:
    """current with the new (paper_id, keyword, method, score), keywords in lower case and trimmed; blank ones are left out. Of equal keys the largest score counts."""
    rows = new.withColumn("keyword", F.trim(F.lower("keyword"))).where(~X.blank(F.col("keyword")))
    return upsert.upsert(current, rows, ["paper_id", "keyword", "method"], [F.col("score")])


def needs_keywords(papers: DataFrame, pk: DataFrame, method: str, limit: int | None = None) -> DataFrame:
    """Papers without a keyword of the method, by id, at most `limit`."""
    todo = structuring.without_keywords(papers, pk, method)
    return todo if limit is None else todo.orderBy("paper_id").limit(limit)


def keyword_batch(papers: DataFrame, pk: DataFrame, method: str = "yake", top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(paper_keywords, found): the table with the keywords of the papers that had none of the method; a second run finds only papers that yield none."""
    found = extract.extract(needs_keywords(papers, pk, method), method, top)
    return put_keywords(pk, found), found


def save_legacy(papers: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, keywords) of papers (seq, title, year, venue, author array, extracted array): those whose title and year are not known, the first of each, and
    every row's keywords as (title_key, year, keyword, method)."""
    rows = papers.withColumn("title_key", X.title_key(F.col("title"))).where("title_key <> ''")
    had = known.select(X.title_key(F.col("canonical_title")).alias("title_key"), F.col("year").alias("known_year")).distinct()
    first = upsert.last_wins(rows, ["title_key", "year"], [-F.col("seq")])
    new = first.join(had, (first["title_key"] == had["title_key"]) & first["year"].eqNullSafe(had["known_year"]), "left_anti")
    lists = F.array(F.struct(F.lit("author").alias("method"), F.col("author").alias("words")), F.struct(F.lit("extracted").alias("method"), F.col("extracted").alias("words")))
    flat = rows.select("title_key", "year", F.explode(lists).alias("l")).select("title_key", "year", "l.method", F.explode("l.words").alias("word"))
    words = flat.select("title_key", "year", X.legacy_keyword(F.col("word")).alias("keyword"), "method").where("keyword is not null").distinct()
    return new, words


def redetected(papers: DataFrame, sources: DataFrame) -> DataFrame:
    """papers with venue and year of the surest of their sources' comments and journal references, where one says them; `changed` tells which.

    sources: (paper_id, comments, journal_ref); of equal confidence the alphabetically first venue counts.
    """
    found = sources.withColumn("v", X.redetect_venue(F.col("comments"), F.col("journal_ref"))).where("v is not null")
    best = found.groupBy("paper_id").agg(F.min_by("v", F.struct(-F.col("v.confidence"), F.col("v.venue"), F.coalesce("v.year", F.lit(9999)))).alias("v"))
    joined = papers.join(best, "paper_id", "left")
    venue, year = F.coalesce("v.venue", "venue"), F.coalesce("v.year", "year")
    return joined.withColumn("changed", ~(venue.eqNullSafe(F.col("venue")) & year.eqNullSafe(F.col("year")))).withColumn("venue", venue).withColumn("year", year).drop("v")


def migrated(old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(venues, papers) of a legacy table (id, title, venue, year): a venue for each distinct name, and papers that refer to it; a missing venue is NULL."""
    venues = old.where(~X.blank(F.col("venue"))).select(F.col("venue").alias("canonical_name")).distinct().withColumn("venue_id", F.xxhash64("canonical_name"))
    papers = old.join(venues, old["venue"] == venues["canonical_name"], "left").select(F.col("id").alias("paper_id"), F.col("title").alias("canonical_title"), "year", "venue_id", F.col("canonical_name").alias("venue"))
    return venues, papers


def precise(venue: Column, source: Column, venue_raw: Column, comments: Column) -> Column:
    """Whether a venue is confirmed: by an open-review source, by its name in the source's venue or comments, or by an S2 source that states a venue."""
    named = lambda c: F.coalesce(F.upper(c).contains(F.upper(venue)), F.lit(False))
    return (source == "openreview") | named(venue_raw) | named(comments) | ((source == "s2") & ~X.blank(venue_raw))
