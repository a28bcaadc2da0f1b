"""Data-quality checks as one-row aggregates, and the table of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import blank


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Share of filled values of each column in percent, in one pass: columns rows and <column>_pct."""
    n = F.greatest(F.count("*"), F.lit(1))
    filled = [F.round(F.count_if(~blank(F.col(c).cast("string"))) * 100.0 / n, 2).cast("double").alias(f"{c}_pct") for c in columns]
    return rows.agg(F.count("*").alias("rows"), *filled)


def duplicates(rows: DataFrame, key: list[Column]) -> DataFrame:
    """(rows, groups, extra): rows, keys that more than one has, and rows beyond the first of a key."""
    named = [k.alias(f"k{i}") for i, k in enumerate(key)]
    per = rows.groupBy(*named).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("extra"))


def anomalies(rows: DataFrame, year: Column, title: Column, this_year: int) -> DataFrame:
    """(rows, bad_years, short_titles, long_titles): years outside 1990 to next year, titles under 10 or over 500 characters."""
    n = F.length(title)
    return rows.agg(F.count("*").alias("rows"), F.count_if((year < 1990) | (year > this_year + 1)).alias("bad_years"), F.count_if(n < 10).alias("short_titles"), F.count_if(n > 500).alias("long_titles"))


def check(name: str, value: Column, bound: float, at_least: bool = True) -> Column:
    passed = value >= bound if at_least else value <= bound
    return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(float(bound)).alias("threshold"), F.coalesce(passed, F.lit(False)).alias("passed"))


def report(measures: DataFrame, checks: list[Column]) -> DataFrame:
    """(name, value, threshold, passed) from one row of measures."""
    return measures.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def grade(checks: DataFrame) -> DataFrame:
    """(checks, passed, pass_rate, grade): A from 95 percent, B from 80, else C."""
    agg = checks.agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"))
    rate = F.round(F.col("passed") * 100.0 / F.greatest("checks", F.lit(1)), 1).cast("double")
    return agg.select("checks", "passed", rate.alias("pass_rate"), F.when(rate >= 95, "A").when(rate >= 80, "B").otherwise("C").alias("grade"))


def needs_run(latest: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """(run): whether the latest retrieved_at is after the one that meta has under the key, or meta has none."""
    seen = meta.where(F.col("key") == key).agg(F.max("value").alias("seen"))
    now = latest.agg(F.max("retrieved_at").alias("now"))
    return now.join(F.broadcast(seen)).select((F.col("seen").isNull() | (F.col("now") > F.try_to_timestamp("seen"))).alias("run"))


def needs_series(latest: DataFrame, meta: DataFrame, category: str, granularity: str) -> DataFrame:
    """(run): needs_run for one series, whose key names category and granularity."""
    return needs_run(latest, meta, f"arxiv_{category}_{granularity}")


def cache_presence(series: DataFrame, emerging: DataFrame, meta: DataFrame, prefix: str = "arxiv") -> DataFrame:
    """(name, value, passed): rows of the cached series, of emerging topics and of meta entries with the prefix; only the series must be there."""
    parts = [("timeseries_cached", series, True), ("emerging_topics_cached", emerging, False), ("meta_entries", meta.where(F.lower("key").startswith(prefix.lower())), False)]
    out = None
    for name, rows, must in parts:
        one = rows.agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), "value", (F.col("value") > 0 if must else F.lit(None).cast("boolean")).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out


def keyword_validity(series: DataFrame, sample: int = 10) -> DataFrame:
    """(total, invalid, passed) over the keywords (array<struct<keyword, count>>) of the first `sample` series by key: numbers and those of one or two characters are
    invalid; under 5 percent may be."""
    some = series.where("top_keywords is not null").orderBy("category", "granularity", "bucket").limit(sample)
    k = F.col("k.keyword")
    agg = some.select(F.explode("top_keywords").alias("k")).agg(F.count("*").alias("total"), F.count_if(k.rlike("^[0-9]+$") | (F.length(k) <= 2)).alias("invalid"))
    return agg.withColumn("passed", F.coalesce(F.col("invalid") * 100.0 / F.nullif("total", F.lit(0)) < 5, F.lit(True)))


def fusion(links: DataFrame) -> DataFrame:
    """(sources, papers): how many papers have links from that many sources. links: (paper_id, source)."""
    per = links.groupBy("paper_id").agg(F.count_distinct("source").alias("sources"))
    return per.groupBy("sources").agg(F.count("*").alias("papers"))


def layers(raw: DataFrame, papers: DataFrame, links: DataFrame) -> DataFrame:
    """(name, value, threshold, passed): how much of the raw layer is structured, abstracts that are missing in both layers, papers whose venue is known, and links
    a paper, in percent but for the last."""
    pct = lambda part, all_: F.round(part * 100.0 / F.greatest(all_, F.lit(1)), 2)
    a = raw.agg(F.count("*").alias("raw"), F.count_if(blank(F.col("abstract"))).alias("raw_without"))
    b = papers.agg(F.count("*").alias("papers"), F.count_if(blank(F.col("abstract"))).alias("without"), F.count_if(F.col("venue").isNotNull()).alias("named"))
    c = links.agg(F.count("*").alias("links"), F.count_distinct("raw_id").alias("linked"))
    one = a.join(F.broadcast(b)).join(F.broadcast(c))
    return report(one, [
        check("structuring rate", pct(F.col("linked"), F.col("raw")), 50), check("raw without abstract", pct(F.col("raw_without"), F.col("raw")), 30, False),
        check("papers without abstract", pct(F.col("without"), F.col("papers")), 20, False), check("venue known", pct(F.col("named"), F.col("papers")), 0),
        check("links a paper", F.round(F.col("links") / F.greatest("papers", F.lit(1)), 2), 1),
    ])


def acceptance(cleaned: DataFrame, again: DataFrame, counts: DataFrame, noise: Column, synonyms: list[str]) -> DataFrame:
    """(changed, noisy_top, synonym_hits): keywords that a second cleaning would change, noise among the 50 most frequent, keywords that are a main spelling.

    cleaned, again: (keyword, twice); counts: (keyword, count).
    """
    top = counts.orderBy(F.desc("count"), "keyword").limit(50)
    a = again.agg(F.count_if(~F.col("keyword").eqNullSafe(F.col("twice"))).alias("changed"))
    b = top.agg(F.count_if(noise).alias("noisy_top"))
    c = cleaned.agg(F.count_if(F.col("keyword").isin(synonyms)).alias("synonym_hits"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))
