"""Emerging topics from a stream: each keyword's latest buckets as keyed state, in RocksDB.

The state of a (category, keyword) is a ring of its last `keep` buckets with their counts, its first bucket and the last one that is closed. Rows may come in any
order within the watermark: a row of a bucket that is older than all of a full ring can't change what is emerging, since later rows only
bring newer buckets. An event-time timer at a bucket's end closes it once the watermark has passed: then no row of it can come any more. Each
batch gives the new state of the keys that it touched, numbered, and a batch that is run again gives the same, so the sink
keeps one file set a batch and readers take each key's last row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

KEEP = 8
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "buckets array<string>, counts array<bigint>, ends array<bigint>, first_seen string, closed string, seq bigint"
RINGS = "category string, keyword string, buckets array<string>, counts array<bigint>, first_seen string, closed string, seq bigint"


def turned(ring: dict[str, tuple[int, int]], new: dict[str, tuple[int, int]], keep: int = KEEP) -> dict[str, tuple[int, int]]:
    """bucket: (count, end) of both, the latest `keep` buckets of them."""
    both = dict(ring)
    for bucket, (count, end) in new.items():
        had = both.get(bucket, (0, end))
        both[bucket] = (had[0] + count, end)
    return dict(sorted(both.items())[-keep:])


class Ring(StatefulProcessor):
    def __init__(self, keep: int = KEEP):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ring", _STATE)

    def _load(self) -> tuple[dict, str | None, str | None, int]:
        if not self.state.exists():
            return {}, None, None, 0
        buckets, counts, ends, first, closed, seq = self.state.get()
        return dict(zip(buckets, zip(counts, ends))), first, closed, seq

    def _store(self, key, ring: dict, first: str | None, closed: str | None, seq: int):
        import pandas as pd

        buckets, counts, ends = list(ring), [int(c) for c, _ in ring.values()], [int(e) for _, e in ring.values()]
        self.state.update((buckets, counts, ends, first, closed, seq))
        return pd.DataFrame({"category": [key[0]], "keyword": [key[1]], "buckets": [buckets], "counts": [counts], "first_seen": [first], "closed": [closed], "seq": [seq]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        ring, first, closed, seq = self._load()
        for pdf in rows:
            new = pdf.groupby("bucket").agg(n=("count", "sum"), end=("end_ms", "max"))
            found = {b: (int(n), int(e)) for b, n, e in zip(new.index, new["n"], new["end"])}
            for bucket, (_, end) in found.items():
                if bucket not in ring:
                    self.handle.registerTimer(end)
            first = min([*found, *([first] if first is not None else [])])
            ring = turned(ring, found, self.keep)
        yield self._store(key, ring, first, closed, seq + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        ring, first, closed, seq = self._load()
        over = [b for b, (_, end) in ring.items() if end <= expiredTimerInfo.getExpiryTimeInMs()]
        if over and (closed is None or max(over) > closed):
            yield self._store(key, ring, first, max(over), seq + 1)

    def close(self) -> None:
        pass


def rings(records: DataFrame, late: str, keep: int = KEEP) -> DataFrame:
    """RINGS of a stream of records (ts, category, keyword, bucket, count, end_ms): a row for each key and batch that changes it.

    end_ms: when the bucket ends, in milliseconds. Records later than the watermark are dropped; it starts at 1970, so records of before are.
    """
    marked = records.withWatermark("ts", late)
    return marked.groupBy("category", "keyword").transformWithStateInPandas(Ring(keep), RINGS, "Update", "EventTime")


def into_batches(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch to its own folder, over what an earlier run of the same batch has left. State lives in RocksDB."""
    spark = rows.sparkSession

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    had = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        return rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", had)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each key."""
    rows = spark.read.schema(RINGS).parquet(f"{path}/batch=*")
    return rows.groupBy("category", "keyword").agg(F.max_by(F.struct("buckets", "counts", "first_seen", "closed"), "seq").alias("r")).select("category", "keyword", "r.*")


def emerging(latest_rings: DataFrame, window: int = 4, min_growth: float = 1.5, baseline: float = 0.1) -> DataFrame:
    """(category, keyword, growth_rate, first_seen, recent_count, trend): rising keywords, as `operators.series.emerging_topics` finds them from all counts.

    A category has the 2 window buckets that it needs if its keywords' rings have as many between them.
    """
    rows = latest_rings
    spans = rows.select("category", F.explode("buckets").alias("bucket")).distinct().groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * window)
    newest = F.reverse(F.slice("counts", F.greatest(F.size("counts") - 2 * window + 1, F.lit(1)), 2 * window))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    rows = rows.join(spans.select("category"), "category", "left_semi").where(F.size("buckets") >= window).withColumn("newest", newest)
    rows = rows.withColumns({"recent": total(F.slice("newest", 1, window)) / window, "before": F.slice("newest", window + 1, window)})
    past = F.when(F.size("before") > 0, total(F.col("before")) / F.size("before"))
    rate = F.col("recent") / F.when(F.coalesce(past, F.lit(0.0)) > 0, past).otherwise(F.lit(baseline))
    out = rows.withColumn("rate", rate).where(F.col("rate") >= min_growth)
    return out.select("category", "keyword", F.bround("rate", 2).alias("growth_rate"), "first_seen", F.col("recent").cast("bigint").alias("recent_count"), F.lit("rising").alias("trend"))
