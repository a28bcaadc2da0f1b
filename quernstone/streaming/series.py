"""Time series as a stream: counts of tumbling, sliding and session windows under a watermark, and idempotent upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernstone.operators.upsert import Table

LATE = "2 days"


def windowed(records: DataFrame, length: str = "1 day", slide: str | None = None, late: str = LATE) -> DataFrame:
    """(start, end, category, count) of records (ts, category); rows later than the watermark are left out of closed windows."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = records.withWatermark("ts", late).groupBy(w.alias("w"), "category").agg(F.count("*").alias("count"))
    return counted.select("w.start", "w.end", "category", "count")


def sessions(records: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """(start, end, user_id, count) of a user's records that follow each other within the gap."""
    counted = records.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("count"))
    return counted.select("w.start", "w.end", "user_id", "count")


def first_seen(records: DataFrame, key: list[str], late: str = LATE) -> DataFrame:
    """Records without repeats of a key within the watermark."""
    return records.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def into_table(counts: DataFrame, table: Table, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Upserts each batch of updated counts; a batch that is run again changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        table.upsert(batch, key, [F.col("count")])

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
