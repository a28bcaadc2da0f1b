"""Numbers of rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.scratch import written


def placed(rows: DataFrame, by: str, order: list[Column | str]) -> DataFrame:
    """rows with `place`, their number from 0 within `by`, in order.

    Rows are sorted over all tasks and numbered within each; what stands before a task's rows comes from a count per
    task and group, so that a group of any size meets in no single task.
    """
    inner = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    rows = written(rows.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "placed")
    runs = rows.groupBy(by, "_p").agg(F.min(inner).alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(by, "_p", "_first", before.alias("_before"))  # a row a task and group
    return rows.join(runs, [by, "_p"]).withColumn("place", F.col("_before") + inner - F.col("_first")).drop("_p", "_m", "_first", "_before")
