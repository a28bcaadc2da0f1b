"""What serving and runs read: rows with their defaults, pages with totals, details by title, scrape logs, gates by what has changed, chart sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.operators.lookups import by_title

#: What a NULL reads as, by table. Times stay NULL: a time that isn't known is not now.
DEFAULTS: dict[str, dict[str, str]] = {
    "raw_papers": {"title": "''", "abstract": "''", "authors": "array()"},
    "venues": {"tier": "'C'", "openreview_ids": "array()", "years_available": "array()"},
    "papers": {"abstract": "''", "authors": "array()", "venue_type": "'unknown'", "domain": "''", "quality_flag": "'unknown'"},
    "paper_keywords": {"method": "'unknown'", "score": "0.0"},
}


def decoded(rows: DataFrame, table: str) -> DataFrame:
    """rows of the table with its defaults in place of NULLs; columns that rows lack are left out."""
    kinds = dict(rows.dtypes)
    return rows.withColumns({c: F.coalesce(c, F.expr(d).cast(kinds[c])) for c, d in DEFAULTS[table].items() if c in kinds})


def page_with_total(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """The rows of a page, each with `total`, the number of rows of all pages; a page beyond the last has no rows."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(*order).offset(offset).limit(limit).join(total)


def details(asked: DataFrame, records: DataFrame, papers: DataFrame, pk: DataFrame, keywords: int = 10) -> DataFrame:
    """(source_paper_id, status, title, paper_id, keywords) for every asked id: 404 if there is no record of it, else 200 with the first keywords, by name, of the paper of the same title.

    records: source_paper_id, title, year; papers: paper_id, canonical_title, year; pk: paper_id, keyword.
    """
    found = asked.join(records.select("source_paper_id", "title", "year"), "source_paper_id", "left")
    titles = found.where("title is not null").select(F.col("source_paper_id").alias("ask"), "title", "year")
    paper = by_title(papers, titles).select(F.col("ask").alias("source_paper_id"), "paper_id")
    words = pk.join(paper.select("paper_id").distinct(), "paper_id", "left_semi").groupBy("paper_id").agg(F.slice(F.array_sort(F.collect_set("keyword")), 1, keywords).alias("keywords"))
    out = found.join(paper, "source_paper_id", "left").join(words, "paper_id", "left")
    status = F.when(F.col("title").isNull(), 404).otherwise(200)
    return out.select("source_paper_id", status.alias("status"), "title", "paper_id", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


# ------------------------------------------------------------ scrape logs


def logged(logs: DataFrame, done: DataFrame, at: Column) -> DataFrame:
    """logs with a row for each venue and year of done (venue, year, paper_count); logs are only ever appended to."""
    return logs.unionByName(done.select("venue", "year", F.col("paper_count").cast("bigint").alias("paper_count"), at.alias("scraped_at")))


def last_scrapes(logs: DataFrame) -> DataFrame:
    """(venue, year, scraped_at): the last of each."""
    return logs.groupBy("venue", "year").agg(F.max("scraped_at").alias("scraped_at"))


def due(asked: DataFrame, logs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """asked (venue, year) with scraped_at and `due`: never scraped, or more than `days` ago."""
    rows = asked.join(last_scrapes(logs), ["venue", "year"], "left")
    return rows.withColumn("due", F.col("scraped_at").isNull() | (now - F.col("scraped_at") > F.make_dt_interval(F.lit(days))))


# ------------------------------------------------------------ gates and status


def gates(scopes: DataFrame, meta: DataFrame) -> DataFrame:
    """(scope, run, reason): whether a scope is to be analysed again: the first time, if records came since the last run, or if its number of papers is another.

    scopes: scope, retrieved_at, papers; meta: key, value with last_raw_max_retrieved_at/<scope> and last_paper_count/<scope>.
    """
    said = meta.select(F.split_part("key", F.lit("/"), F.lit(1)).alias("name"), F.split_part("key", F.lit("/"), F.lit(2)).alias("scope"), "value")
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    said = said.groupBy("scope").agg(pick("last_raw_max_retrieved_at").alias("seen"), pick("last_paper_count").alias("counted"))
    rows = scopes.join(said, "scope", "left")
    reason = F.when(F.col("seen").isNull(), "first").when(F.col("retrieved_at") > F.try_to_timestamp("seen"), "records").when(F.col("counted") != F.col("papers").cast("string"), "papers")
    return rows.select("scope", reason.isNotNull().alias("run"), reason.alias("reason"))


def after_run(scopes: DataFrame, at: Column) -> DataFrame:
    """(key, value): what meta has of the scopes once they are analysed."""
    entries = {"last_raw_max_retrieved_at": F.date_format("retrieved_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "last_paper_count": F.col("papers").cast("string"), "last_analysis_run": at.cast("string")}
    each = F.array(*[F.struct(F.concat(F.lit(f"{k}/"), "scope").alias("key"), v.alias("value")) for k, v in entries.items()])
    return scopes.select(F.explode(each).alias("e")).select("e.*").where("value is not null")


def run_status(papers: DataFrame, meta: DataFrame) -> DataFrame:
    """(papers, venues, year_range, meta_entries, last_run): the status of data and runs, in one row."""
    p = papers.agg(F.count("*").alias("papers"), F.count_distinct("venue").alias("venues"), X.year_range(F.min("year"), F.max("year")).alias("year_range"))
    m = meta.agg(F.count("*").alias("meta_entries"), F.max(F.when(F.col("key").startswith("last_analysis_run"), F.col("value"))).alias("last_run"))
    return p.join(m)


def recent_skew(papers: DataFrame, now: Column, days: int = 30, most: float = 0.95) -> DataFrame:
    """(venue, papers, share, warning) of the venue with the most papers of the last days; the warning is raised beyond `most`. No recent papers, no row."""
    recent = papers.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(days))).groupBy("venue").agg(F.count("*").alias("papers"))
    total = recent.agg(F.sum("papers").alias("all"))
    share = F.col("papers") / F.col("all")
    return recent.join(total).select("venue", "papers", share.alias("share"), (share > most).alias("warning")).orderBy(F.desc("papers"), "venue").limit(1)


# ------------------------------------------------------------ chart sets


def bars(counted: DataFrame, k: int = 20) -> DataFrame:
    """(place, keyword, count, width): a horizontal bar chart's rows, the widest 1."""
    top = counted.orderBy(F.desc("count"), "keyword").limit(k)
    all_of = Window.partitionBy()  # k rows
    return top.select(F.row_number().over(Window.orderBy(F.desc("count"), "keyword")).alias("place"), "keyword", "count", (F.col("count") / F.max("count").over(all_of)).alias("width"))


def latest_years(papers: DataFrame, ranks: DataFrame, k: int = 10) -> DataFrame:
    """(venue, year, papers, keyword, count, rank): each venue's latest year with its first keywords; ranks: venue, year, keyword, count, rank."""
    per = papers.groupBy("venue", "year").agg(F.count("*").alias("papers"))
    latest = per.groupBy("venue").agg(F.max("year").alias("year"), F.max_by("papers", "year").alias("papers"))
    return latest.join(ranks.where(F.col("rank") <= k), ["venue", "year"])
