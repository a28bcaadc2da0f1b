"""Keyword counts, ranks, trends and emergence over papers and paper_keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.filters import where
from quernstone.scratch import written


def of_papers(pk: DataFrame, papers: DataFrame, venue: str | None = None, year: int | None = None, method: str | None = None) -> DataFrame:
    """(keyword, method, venue, year) of each paper's keywords, filtered before the join.

    With a venue or year, keywords are first cut down to these papers': the semi-join goes below the aggregate that pk may be.
    """
    left = where(pk, method=method).select("paper_id", "keyword", "method")
    right = where(papers, venue=venue, year=year).select("paper_id", "venue", "year")
    if venue or year:
        left = left.join(right.select("paper_id"), "paper_id", "left_semi")
    return left.join(right, "paper_id")


def counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, "keyword").agg(F.count("*").alias("count"))


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k most frequent keywords; equal counts in alphabetical order."""
    return counts(rows).orderBy(F.desc("count"), "keyword").limit(k)


def ranked(counted: DataFrame, by: list[str], k: int | None = None) -> DataFrame:
    """Ranks from 1 within `by`, up to k."""
    w = Window.partitionBy(*by).orderBy(F.desc("count"), "keyword")
    out = counted.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def listed(ranks: DataFrame, by: list[str], name: str = "top_keywords") -> DataFrame:
    """One row for each group, its keywords by rank as "keyword:count", joined by "|"."""
    items = F.array_sort(F.collect_list(F.struct("rank", "keyword", "count")))
    return ranks.groupBy(*by).agg(F.array_join(F.transform(items, lambda x: F.concat(x["keyword"], F.lit(":"), x["count"].cast("string"))), "|").alias(name))


#: Levels of the cube: which of venue and year a count is for; the other is NULL.
BY_VENUE_YEAR, BY_VENUE, BY_YEAR, OVERALL = 0, 1, 2, 3


def cube(rows: DataFrame) -> DataFrame:
    """(level, venue, year, keyword, count) for every venue and year, venue, year, and all: rows are counted once, the coarser levels from these counts.

    It is written, so that all that reads it shares one pass over the rows. Its size is that of the distinct (venue, year, keyword).
    """
    finest = counts(rows, "venue", "year")
    sets = finest.groupingSets([["venue", "year", "keyword"], ["venue", "keyword"], ["year", "keyword"], ["keyword"]], "venue", "year", "keyword")
    level = (F.grouping("venue") * 2 + F.grouping("year")).cast("int").alias("level")
    return written(sets.agg(F.sum("count").alias("count"), level).select("level", "venue", "year", "keyword", "count"), "cube")


def of_level(cubed: DataFrame, level: int) -> DataFrame:
    return cubed.where(F.col("level") == level)


def as_structs(ranks: DataFrame, by: list[str], name: str = "top_keywords") -> DataFrame:
    """One row for each group, its keywords by rank as array<struct<keyword, count>>."""
    items = F.array_sort(F.collect_list(F.struct("rank", "keyword", "count")))
    return ranks.groupBy(*by).agg(F.transform(items, lambda x: F.struct(x["keyword"].alias("keyword"), x["count"].alias("count"))).alias(name))


def yearly(rows: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """(keyword, year, count), of the given keywords (any case) or all."""
    kept = rows if keywords is None else rows.where(F.col("keyword").isin([k.lower() for k in keywords]))
    return kept.groupBy("keyword", "year").agg(F.count("*").alias("count"))


def growth(trend: DataFrame) -> DataFrame:
    """(keyword, n_years, growth_rate): (last - first) / first; 0 for under two years or a first of 0."""
    agg = trend.groupBy("keyword").agg(F.count("*").alias("n_years"), F.min_by("count", "year").alias("first"), F.max_by("count", "year").alias("last"))
    rate = F.when((F.col("n_years") < 2) | (F.col("first") == 0), 0.0).otherwise((F.col("last") - F.col("first")) / F.col("first").cast("double"))
    return agg.select("keyword", "n_years", rate.alias("growth_rate"))


def trend_grid(rows: DataFrame, by: list[str], per_year: int = 100, keywords: int = 20) -> DataFrame:
    """(by, keyword, year, count, rank) on every year of a group, 0 and 0 where a keyword is not among the year's first `per_year`.

    The keywords are the first by their sum over the years' lists.
    """
    yearly_ranks = ranked(counts(rows, *by, "year"), [*by, "year"], per_year)
    total = yearly_ranks.groupBy(*by, "keyword").agg(F.sum("count").alias("count"))
    chosen = ranked(total, by, keywords).select(*by, "keyword")
    years = yearly_ranks.select(*by, "year").distinct()  # every year of a group has a first keyword
    grid = chosen.join(years, by)
    filled = grid.join(yearly_ranks, [*by, "keyword", "year"], "left")
    return filled.select(*by, "keyword", "year", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), F.coalesce("rank", F.lit(0)).alias("rank"))


def emerging(rows: DataFrame, papers: DataFrame, min_growth: float = 1.5, k: int = 20, latest_k: int = 300, min_count: int = 5, compared: int = 2) -> DataFrame:
    return emerging_of(counts(rows, "year"), papers, min_growth, k, latest_k, min_count, compared)


def emerging_of(by_year: DataFrame, papers: DataFrame, min_growth: float = 1.5, k: int = 20, latest_k: int = 300, min_count: int = 5, compared: int = 2) -> DataFrame:
    """(keyword, count, is_new, growth_rate) of the latest year's first keywords, from (year, keyword, count): its frequency (per 1000 papers) over the mean of the years before it;
    new ones (mean under 0.1), which have infinite growth, first.

    The years' table, a row a year, joins the counts, and one aggregate puts the years of a keyword side by side.
    """
    years = papers.groupBy("year").agg(F.count("*").alias("papers"))
    last = Window.orderBy(F.desc("year"))  # a row a year
    years = years.withColumns({"nth": F.row_number().over(last), "others": F.least(F.count("*").over(Window.partitionBy()) - 1, F.lit(compared))}).where(F.col("nth") <= compared + 1)
    per = by_year.join(F.broadcast(years), "year")  # a row a year
    freq = F.col("count") / F.greatest("papers", F.lit(1)).cast("double") * 1000
    now = F.col("nth") == 1
    agg = per.groupBy("keyword").agg(F.sum(F.when(now, F.col("count"))).alias("count"), F.sum(F.when(now, freq)).alias("now"), F.sum(F.when(~now, freq)).alias("before"), F.max("others").alias("others"))
    agg = agg.where("count is not null").orderBy(F.desc("count"), "keyword").limit(latest_k).where(F.col("count") >= min_count)
    mean = F.when(F.col("others") > 0, F.coalesce("before", F.lit(0.0)) / F.col("others"))
    out = agg.withColumn("mean", F.coalesce(mean, F.lit(0.0))).withColumn("is_new", F.col("mean") < 0.1)
    out = out.withColumn("growth_rate", F.when(F.col("is_new"), F.lit(float("inf"))).otherwise(F.col("now") / F.col("mean")))
    return out.where(F.col("growth_rate") >= min_growth).orderBy(F.desc("is_new"), F.desc("growth_rate"), F.desc("count"), "keyword").limit(k).select("keyword", "count", "is_new", "growth_rate")


def emerging_detailed(rows: DataFrame, papers: DataFrame, min_growth: float = 1.5, k: int = 20) -> DataFrame:
    """(keyword, growth_rate, trend): NULL growth for new ones; trend is "year=count" of the last four years."""
    found = emerging(rows, papers, min_growth, k)
    years = papers.select("year").distinct().orderBy(F.desc("year")).limit(4)
    trend = yearly(rows.join(F.broadcast(found.select("keyword")), "keyword", "left_semi").join(F.broadcast(years), "year", "left_semi"))
    text = trend.groupBy("keyword").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", "count"))), lambda x: F.concat(x["year"].cast("string"), F.lit("="), x["count"].cast("string"))), ",").alias("trend"))
    rate = F.when(F.col("is_new"), F.lit(None).cast("double")).otherwise(F.col("growth_rate"))
    return found.join(text, "keyword", "left").select("keyword", rate.alias("growth_rate"), "trend").orderBy(F.desc(F.coalesce("growth_rate", F.lit(999.0))), "keyword")


def histogram(counted: DataFrame, n: str = "n") -> DataFrame:
    """(band, papers, pct) of keywords a paper: 0-5, 6-10, 11-15, 16+."""
    c = F.col(n)
    band = F.when(c <= 5, "0-5").when(c <= 10, "6-10").when(c <= 15, "11-15").otherwise("16+")
    bands = counted.groupBy(band.alias("band")).agg(F.count("*").alias("papers"))
    return bands.select("band", "papers", share("papers"))


def share(count: str, digits: int = 1, name: str = "pct") -> Column:
    """Percentage of the column's total; one row a group goes through the window."""
    return F.round(F.col(count) * 100.0 / F.sum(count).over(Window.partitionBy()), digits).cast("double").alias(name)
