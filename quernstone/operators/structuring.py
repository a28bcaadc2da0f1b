"""From raw records to papers, venues and source links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone import lexicon
from quernstone.functions import text as X


def deduplicate(raw: DataFrame, key: str = "title_key", year: str = "year", order: list[str] | None = None) -> DataFrame:
    """raw with keep_id: the row that stands for it, by arrival order.

    Rows of one key and year share the first of them. A row without a year joins the earliest row of its key if one came
    before it, else it opens a paper without a year, which only later rows without a year join.
    """
    order = order or ["raw_id"]
    order = order if "raw_id" in order else [*order, "raw_id"]
    # The first row of a key, and of a key and year, by aggregates that are joined back: no key's rows meet in one task.
    firsts = raw.groupBy(key, year).agg(F.min(F.struct(*order)).alias("f"))
    firsts = firsts.select(F.col(key).alias("__key"), F.col(year).alias("__year"), "f", F.min("f").over(Window.partitionBy(key)).alias("g"))  # a row a year
    keep = F.when(F.col("__year").isNull() | (F.col("__year") == 0), F.col("g")["raw_id"]).otherwise(F.col("f")["raw_id"])
    firsts = firsts.select("__key", "__year", keep.alias("keep_id"))
    return raw.join(firsts, raw[key].eqNullSafe(firsts["__key"]) & raw[year].eqNullSafe(firsts["__year"]), "left").drop("__key", "__year")


@dataclass
class Structured:
    papers: DataFrame
    links: DataFrame
    rejects: DataFrame
    counters: DataFrame


def structure(raw: DataFrame, known_links: DataFrame | None = None) -> Structured:
    """Papers, links and rejects of the raw records that no link has yet; sources in their fixed order, then by raw_id."""
    todo = raw if known_links is None else raw.join(known_links.select("raw_id").distinct(), "raw_id", "left_anti")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in lexicon.SOURCE_ORDER]), F.col("source")), F.lit(0))
    rows = todo.withColumn("canonical_title", X.normal_title(F.col("title"))).withColumn("title_key", F.lower("canonical_title"))
    rows = rows.withColumn("priority", F.when(rank == 0, 99).otherwise(rank))
    rejects = rows.where("canonical_title = ''").select("raw_id", "source")
    good = deduplicate(rows.where("canonical_title <> ''"), order=["priority", "raw_id"])
    c = F.col
    good = good.withColumn("v", X.detect_venue(c("source"), c("venue_raw"), c("comments"), c("journal_ref")))
    good = good.withColumn("paper_id", F.xxhash64("title_key", "keep_id"))
    papers = good.where("raw_id = keep_id").select(
        "paper_id", "keep_id", "canonical_title", "abstract", "year", c("v.venue").alias("venue"),
        X.venue_kind(c("v.venue"), c("source"), c("journal_ref"), c("categories")).alias("venue_type"),
        X.classify_domain(c("categories"), c("canonical_title"), c("abstract")).alias("domain"),
        X.quality_flag(c("v.venue"), c("source"), c("comments")).alias("quality_flag"),
    )
    links = good.select("paper_id", "keep_id", "raw_id", "source", c("v.confidence").alias("confidence"))
    counters = rows.agg(F.count("*").alias("processed"), F.count_if(F.col("canonical_title") == "").alias("failed")).join(F.broadcast(good.agg(F.count_if(F.col("raw_id") == F.col("keep_id")).alias("success"), F.count_if(F.col("raw_id") != F.col("keep_id")).alias("merged"))))
    return Structured(papers, links, rejects, counters)


def unprocessed(raw: DataFrame, links: DataFrame) -> DataFrame:
    return raw.join(links.select("raw_id").distinct(), "raw_id", "left_anti")


def without_keywords(papers: DataFrame, pk: DataFrame, method: str) -> DataFrame:
    """Papers without a keyword of the method."""
    return papers.join(pk.where(F.col("method") == method).select("paper_id").distinct(), "paper_id", "left_anti")
