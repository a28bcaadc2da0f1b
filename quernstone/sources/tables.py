"""Readers: point and filtered scans, registry CSV, landing folders of JSON lines, static JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.operators.filters import where

REGISTRY_CSV = "canonical_name string, full_name string, domain string, tier string, source_preference string, openreview_id_pattern string, s2_venue_key string, openalex_venue_name string, aliases string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_source(raw: DataFrame, source: str | None = None, limit: int | None = None) -> DataFrame:
    rows = where(raw, source=source)
    return rows if limit is None else rows.orderBy("raw_id").limit(limit)


def point(df: DataFrame, **key) -> DataFrame:
    """The row of a key; the comparison reaches the scan."""
    return where(df, **key).limit(1)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The venue registry with aliases as an array of trimmed, non-empty names."""
    rows = spark.read.schema(REGISTRY_CSV).csv(path, header=True, quote='"')
    return rows.withColumn("aliases", F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != ""))


def landing(spark: SparkSession, path: str) -> DataFrame:
    """(payload): lines of JSON that a crawler has dropped; whole files of one JSON value with static_json()."""
    return spark.read.text(path).withColumnRenamed("value", "payload").where("payload <> ''")


def static_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def recent(records: DataFrame, cutoff: Column) -> DataFrame:
    """Records retrieved since the cutoff, or of its year or later."""
    return records.where((F.col("retrieved_at") >= cutoff) | (F.col("year") >= F.year(cutoff)))


def bulk(records: DataFrame, years: list[int], per_year: int) -> DataFrame:
    """Up to per_year // (number of categories) records of each category and year, earliest first."""
    kept = records.where(F.col("year").isin(years))
    most = per_year // max(1, kept.select("category").distinct().count())  # a number, so that ranks beyond it are never sorted
    nth = F.row_number().over(Window.partitionBy("year", "category").orderBy("published_at", "raw_id"))
    return kept.withColumn("nth", nth).where(F.col("nth") <= most)
