"""Connected components of a link table, by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm._common import materialise


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root): every linked node with the smallest node of its component.

    Loops and repeated links change nothing; no links give an empty table. Each round is written to the
    shared folder. The number of rounds grows as the logarithm of the longest chain; an error is raised
    if most_rounds don't suffice, never a partial result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges = materialise(edges, "cc-links")
    before = None
    for _ in range(most_rounds):
        # Large star: each node hangs its larger neighbours on the smallest of its neighbourhood.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node hangs its smaller neighbours and itself on the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc-round")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = tuple(now)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
