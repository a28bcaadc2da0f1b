"""Tables laid out for the joins and lookups that are made on them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def bucketed(rows: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """rows as a table of `buckets` files by a hash of the key, each sorted by it: tables of the same key and number are joined, and grouped by the key, without an exchange."""
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return rows.sparkSession.table(name)


def for_lookups(rows: DataFrame, path: str, key: str, expected: int | None = None) -> DataFrame:
    """rows sorted by the key over all files, with a Parquet Bloom filter of it: a point read opens the files whose range has the value, and reads row groups whose filter may hold it."""
    writer = rows.repartitionByRange(key).sortWithinPartitions(key).write.option(f"parquet.bloom.filter.enabled#{key}", "true")
    if expected:
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{key}", str(expected))
    writer.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
