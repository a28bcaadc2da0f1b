"""A feed's pages as a stream into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def into_files(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to Parquet files; what the checkpoint names as done isn't written again."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(path)


def drain(query: StreamingQuery) -> None:
    """Waits until the feed has nothing more, and stops."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def until_batches(query: StreamingQuery, n: int, seconds: float = 120) -> None:
    """Stops a stream once it has done n batches, as a crawl that breaks off does."""
    import time

    end = time.time() + seconds
    while query.isActive and time.time() < end and (query.lastProgress or {}).get("batchId", -1) < n - 1:
        time.sleep(0.05)
    query.stop()
