"""Summaries that merge: distinct keywords and score quantiles of any group, kept as sketches and refreshed by union.

A stored row has a group's HyperLogLog sketch of keywords, its KLL sketch of scores, and its row count. New papers are sketched by
themselves and united with what is stored, so a refresh reads new rows and sketches only; a coarser group is the union of its finer
ones. Bounds: an estimate of distinct values lies within `within` of the exact number in 99.7 % of cases (and is exact while the sketch still holds
single values), a quantile's rank within RANK of the asked one.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Log of the HyperLogLog sketch's size, and the KLL sketch's k; the rank error of k = 200 is 1.65 % as published.
LOG_K, K = 12, 200
RANK = 0.0165


def within(sigmas: float = 3.0) -> float:
    """Relative error of a distinct count."""
    return sigmas * 1.04 / sqrt(2**LOG_K)


def sketched(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n, keywords, scores) of rows (by, keyword, score)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg("keyword", F.lit(LOG_K)).alias("keywords"), F.kll_sketch_agg_double(F.col("score").cast("double"), F.lit(K)).alias("scores"))


def united(sketches: DataFrame, *by: str) -> DataFrame:
    """The same of coarser groups, or of several rows of one group: no paper is read."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("keywords").alias("keywords"), F.kll_merge_agg_double("scores", F.lit(K)).alias("scores"))


def refreshed(stored: DataFrame, new_rows: DataFrame, *by: str) -> DataFrame:
    """stored with the rows that came since."""
    return united(stored.unionByName(sketched(new_rows, *by)), *by)


def estimates(sketches: DataFrame, *by: str, ranks: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """(by, n, keywords, and a column q<percent> for each rank)."""
    quantiles = [F.kll_sketch_get_quantile_double("scores", F.lit(r)).alias(f"q{round(100 * r)}") for r in ranks]
    return sketches.select(*by, "n", F.hll_sketch_estimate("keywords").alias("keywords"), *quantiles)
