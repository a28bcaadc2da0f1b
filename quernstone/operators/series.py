"""Time series, emerging topics and category comparison over bucketed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.time import GRANULARITIES, bucket


def bucketed(records: DataFrame, granularities: tuple[str, ...] = GRANULARITIES, every: bool = True) -> DataFrame:
    """records (ts, category, ...) once for each granularity, with bucket; with `every`, once more for category ALL. One scan, no join."""
    kinds = F.array(*[F.struct(F.lit(g).alias("granularity"), bucket(g, F.col("ts")).alias("bucket")) for g in granularities])
    out = records.withColumn("b", F.explode(kinds)).where("b.bucket is not null")
    if every:
        out = out.withColumn("category", F.explode(F.array(F.col("category"), F.lit("ALL"))))
    return out.select("*", "b.granularity", "b.bucket").drop("b")


def paper_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category", "granularity", "bucket").agg(F.count("*").alias("paper_count"))


def keyword_counts(rows: DataFrame) -> DataFrame:
    return rows.where("keyword is not null").groupBy("category", "granularity", "bucket", "keyword").agg(F.count("*").alias("count"))


def emerging_topics(counted: DataFrame, window: int = 4, min_growth: float = 1.5, falling: float = 0.7, baseline: float = 0.1, dense: bool = False) -> DataFrame:
    """(category, keyword, growth_rate, first_seen, recent_count, trend) from (category, bucket, keyword, count).

    The mean of a keyword's last `window` appearances over that of the `window` before, or over the baseline if there are
    none. A category needs 2 window buckets and a keyword `window` appearances. With dense=True buckets without
    the keyword count as 0 from its first appearance on. Only rising keywords are kept.
    """
    enough = counted.select("category", "bucket").distinct().groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * window).select("category")
    rows = counted.join(enough, "category", "left_semi")
    if dense:
        # Places of a category's buckets from the latest on: a keyword's series is as long as the place of its first bucket, so no bucket without it need be made.
        buckets = rows.select("category", "bucket").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("bucket"))))  # a row a bucket
        rows, n = rows.join(buckets, ["category", "bucket"]), F.max("nth")
    else:
        rows, n = rows.withColumn("nth", F.row_number().over(Window.partitionBy("category", "keyword").orderBy(F.desc("bucket")))), F.count("*")
    late = F.col("nth") <= window
    sums = rows.groupBy("category", "keyword").agg(
        n.alias("n"),
        F.coalesce(F.sum(F.when(late, F.col("count"))), F.lit(0)).cast("double").alias("recent"),
        F.coalesce(F.sum(F.when(~late & (F.col("nth") <= 2 * window), F.col("count"))), F.lit(0)).cast("double").alias("past"),
        F.min("bucket").alias("first_seen"),
    )
    past = F.when(F.col("n") > window, F.col("past") / (F.least("n", F.lit(2 * window)) - window))
    agg = sums.withColumns({"recent": F.col("recent") / F.least("n", F.lit(window)), "past": past})
    rate = F.col("recent") / F.when(F.coalesce(F.col("past"), F.lit(0.0)) > 0, F.col("past")).otherwise(F.lit(baseline))
    trend = F.when(F.col("rate") >= min_growth, "rising").when(F.col("rate") <= falling, "declining").otherwise("stable")
    out = agg.where(F.col("n") >= window).withColumn("rate", rate).withColumn("trend", trend).where("trend = 'rising'")
    return out.select("category", "keyword", F.bround("rate", 2).alias("growth_rate"), "first_seen", F.col("recent").cast("bigint").alias("recent_count"), "trend")


def overlap(sets: DataFrame) -> DataFrame:
    """(n_common, n_union, overlap_rate, common) of distinct (category, keyword)."""
    n = sets.select("category").distinct().agg(F.count("*").alias("categories"))
    per = sets.groupBy("keyword").agg(F.count_distinct("category").alias("n"))
    both = per.join(F.broadcast(n))
    common = F.col("n") == F.col("categories")
    agg = both.agg(F.count_if(common).alias("n_common"), F.count("*").alias("n_union"), F.array_join(F.array_sort(F.collect_list(F.when(common, F.col("keyword")))), "|").alias("common"))
    return agg.select("n_common", "n_union", F.bround(F.col("n_common") / F.greatest("n_union", F.lit(1)), 2).cast("double").alias("overlap_rate"), "common")


def only_in(sets: DataFrame, k: int = 10) -> DataFrame:
    """(category, keyword): the first k keywords, alphabetically, that no other category has; of a single category all count."""
    alone = sets.groupBy("keyword").agg(F.count_distinct("category").alias("n"), F.min("category").alias("category")).where("n = 1")
    nth = F.row_number().over(Window.partitionBy("category").orderBy("keyword"))
    return alone.select("category", "keyword").withColumn("nth", nth).where(F.col("nth") <= k)


def category_counts(records: DataFrame, categories: list[str], column: str = "categories") -> DataFrame:
    """(category, papers): records whose category text has each category in it, any case, in one pass."""
    low = F.lower(column)
    hits = F.filter(F.array(*[F.lit(c) for c in categories]), lambda c: low.contains(F.lower(c)))
    return records.select(F.explode(hits).alias("category")).groupBy("category").agg(F.count("*").alias("papers"))
