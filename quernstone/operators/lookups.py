"""Point reads, listings and bundles over the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.operators.filters import where


def count_of(df: DataFrame, name: str = "n", **equal) -> DataFrame:
    """(name): rows that equal every given value; None, 0 and '' are no filter."""
    return where(df, **equal).agg(F.count("*").alias(name))


def by_tier(venues: DataFrame, **equal) -> DataFrame:
    """Venues in the listing's order: tier, then name."""
    return where(venues, **equal).orderBy("tier", "name")


def with_venue_names(papers: DataFrame, venues: DataFrame) -> DataFrame:
    """papers with venue_name; a venue that is not known gives NULL."""
    return papers.join(venues.select("venue_id", F.col("name").alias("venue_name")), "venue_id", "left")


def by_title(papers: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked..., paper_id, found): the paper of the smallest id with the asked title in any case, and year if one is asked; found is false where none is.

    Papers are first brought to a row for each title and year, and one for each title, so that a title of very many papers meets those who ask for it as one row.
    """
    of_year = papers.groupBy(X.title_key(F.col("canonical_title")).alias("title_key"), F.col("year").alias("paper_year")).agg(F.min("paper_id").alias("paper_id"))
    of_any = of_year.groupBy("title_key").agg(F.min("paper_id").alias("paper_id"))
    right = of_year.where("paper_year is not null").unionByName(of_any.withColumn("paper_year", F.lit(None).cast(papers.schema["year"].dataType)))
    left = asked.select("ask", X.title_key(F.col("title")).alias("title_key"), F.col("year").alias("paper_year")).distinct()
    hit = left.join(right, (left["title_key"] == right["title_key"]) & left["paper_year"].eqNullSafe(right["paper_year"])).groupBy("ask").agg(F.min("paper_id").alias("paper_id"))
    return asked.join(hit, "ask", "left").withColumn("found", F.col("paper_id").isNotNull())


def split_keywords(papers: DataFrame, pk: DataFrame) -> DataFrame:
    """(paper_id, author, extracted): a paper's keywords by the author and by other methods, each once, sorted; empty arrays where there are none."""
    joined = papers.select("paper_id").join(pk, "paper_id", "left")
    is_author = F.col("method") == "author"
    return joined.groupBy("paper_id").agg(F.array_sort(F.collect_set(F.when(is_author, F.col("keyword")))).alias("author"), F.array_sort(F.collect_set(F.when(~is_author, F.col("keyword")))).alias("extracted"))


def all_keywords(author: str = "author", extracted: str = "extracted"):
    """Both lists as one, each keyword once."""
    return F.array_distinct(F.concat(author, extracted))


def statistics(venues: DataFrame) -> DataFrame:
    """(kind, value, n): the venues in all, by domain and by tier, in one pass; NULL domains are General."""
    flat = venues.select(F.explode(F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("value")), F.struct(F.lit("domain").alias("kind"), F.coalesce("domain", F.lit("General")).alias("value")), F.struct(F.lit("tier").alias("kind"), F.coalesce("tier", F.lit("C")).alias("value")))).alias("x"))
    return flat.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def explorer(venues: DataFrame, counts: DataFrame) -> DataFrame:
    """(kind, value, venues): names and paper counts of the venues of each domain (NULL: General) and tier (NULL: C), by name; counts: (name, papers)."""
    rows = venues.join(counts, "name", "left").withColumn("papers", F.coalesce("papers", F.lit(0)))
    item = F.struct("name", "papers")
    groups = F.array(F.struct(F.lit("domain").alias("kind"), F.coalesce("domain", F.lit("General")).alias("value")), F.struct(F.lit("tier").alias("kind"), F.coalesce("tier", F.lit("C")).alias("value")))
    return rows.select(F.explode(groups).alias("g"), item.alias("item")).groupBy("g.kind", "g.value").agg(F.array_sort(F.collect_list("item")).alias("venues"))


def summaries(summary: DataFrame) -> DataFrame:
    """Cached venue summaries by venue and year; year 0, which stands for all years, is NULL."""
    return summary.withColumn("year", F.nullif("year", F.lit(0))).orderBy("venue", "year")


def meta(entries: DataFrame, prefix: str) -> DataFrame:
    """Entries whose key begins with the prefix, in any case."""
    return entries.where(F.lower("key").startswith(prefix.lower()))


def status(papers: DataFrame, venues: DataFrame) -> DataFrame:
    """(papers, venues, year_range): what the status page says of the data."""
    p = papers.agg(F.count("*").alias("papers"), F.min("year").alias("a"), F.max("year").alias("b"))
    v = venues.agg(F.count_distinct("name").alias("venues"))
    return p.join(F.broadcast(v)).select("papers", "venues", X.year_range(F.col("a"), F.col("b")).alias("year_range"))
