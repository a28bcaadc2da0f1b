"""Static JSON files and the Markdown report, from small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON file; the rows are aggregates of bounded size (a row a venue, year or rank)."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_partitioned(rows: DataFrame, path: str, by: list[str]) -> None:
    rows.write.mode("overwrite").partitionBy(*by).json(path)


def top_keywords_json(ranks: DataFrame) -> DataFrame:
    """(venue, json): year -> [{keyword, count, rank}]."""
    items = F.array_sort(F.collect_list(F.struct("rank", "keyword", "count")))
    per_year = ranks.groupBy("venue", "year").agg(F.transform(items, lambda x: F.struct(x["keyword"].alias("keyword"), x["count"].alias("count"), x["rank"].alias("rank"))).alias("items"))
    return per_year.groupBy("venue").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("year").cast("string"), "items"))))).alias("json"))


def trends_json(grid: DataFrame) -> DataFrame:
    """(venue, json): keyword -> [{year, count, rank}], every year."""
    series = F.array_sort(F.collect_list(F.struct("year", "count", "rank")))
    per = grid.groupBy("venue", "keyword").agg(series.alias("series"))
    return per.groupBy("venue").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("keyword", "series"))))).alias("json"))


def keywords_index(total_ranks: DataFrame) -> DataFrame:
    """(venue, json): [keyword], most frequent first."""
    return total_ranks.groupBy("venue").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"])).alias("json"))


def venues_index(registry: DataFrame, summary: DataFrame) -> DataFrame:
    """Registry rows with the summary's paper counts and first ten keywords; a venue without a summary has none. Tier is A, domain ML by default."""
    joined = registry.join(summary, "name", "left")
    return joined.select("name", "full_name", F.coalesce("domain", F.lit("ML")).alias("domain"), F.lit("A").alias("tier"), "years_available", F.coalesce("paper_count", F.lit(0)).alias("paper_count"), F.slice("top_keywords", 1, 10).alias("top_keywords"))


def report(overview: DataFrame, top: DataFrame, emerging: DataFrame) -> str:
    """Markdown of one-row and top-k results."""
    o = overview.first()
    lines = ["# Keyword report", "", f"- papers: {o['papers']}", f"- keywords: {o['keywords']}", f"- venues: {o['venues']}", f"- years: {o['year_range']}", "", "## Top keywords", "", "| rank | keyword | count |", "|-|-|-|"]
    lines += [f"| {i} | {r['keyword']} | {r['count']} |" for i, r in enumerate(top.limit(50).collect(), 1)]
    lines += ["", "## Emerging keywords", ""]
    lines += [f"- {r['keyword']}: {'new' if r['is_new'] else format(r['growth_rate'], '.2f')}" for r in emerging.limit(50).collect()] or ["none"]
    return "\n".join(lines) + "\n"


def series_files(counted: DataFrame, listed: DataFrame) -> DataFrame:
    """(granularity, category, bucket, paper_count, top_keywords): what the static site has of each series; categories without papers have no file."""
    return counted.join(listed, ["category", "granularity", "bucket"], "left").where("paper_count > 0")


def emerging_files(topics: DataFrame, min_growth: float = 1.5, limit: int = 50) -> DataFrame:
    """(category, rank, keyword, growth_rate): each category's topics of at least that growth, first by growth, then by keyword, at most `limit`."""
    nth = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("growth_rate"), "keyword"))
    return topics.where(F.col("growth_rate") >= min_growth).withColumn("rank", nth).where(F.col("rank") <= limit).select("category", "rank", "keyword", "growth_rate")


def manifest(files: DataFrame, ref) -> DataFrame:
    """(generated_at, files, bytes) of written files (name, json): one row."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("json")), F.lit(0)).cast("bigint").alias("bytes")).select(ref.alias("generated_at"), "files", "bytes")


def site(ranks: DataFrame, grid: DataFrame, totals: DataFrame) -> DataFrame:
    """(name, json): the files of each venue; the index of its keywords only where both lists are there."""
    top, trends, index = top_keywords_json(ranks), trends_json(grid), keywords_index(totals)
    both = top.select("venue").join(trends.select("venue"), "venue")
    named = lambda df, what: df.select(F.concat(F.lit("venue_"), F.col("venue"), F.lit(f"_{what}.json")).alias("name"), "json")
    return named(top, "top_keywords").unionByName(named(trends, "keyword_trends")).unionByName(named(index.join(both, "venue", "left_semi"), "keywords_index"))


def checks_json(checks: DataFrame) -> DataFrame:
    """(json): the data-quality checks as one text, by name."""
    return checks.agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "value", "threshold", "passed")))).alias("json"))


def venue_clouds(ranks: DataFrame, k: int = 100) -> DataFrame:
    """(venue, rank, keyword, count): each venue's keywords by the sum of their counts in the yearly lists, at most k."""
    total = ranks.groupBy("venue", "keyword").agg(F.sum("count").alias("count"))
    nth = F.row_number().over(Window.partitionBy("venue").orderBy(F.desc("count"), "keyword"))
    return total.withColumn("rank", nth).where(F.col("rank") <= k).select("venue", "rank", "keyword", "count")
