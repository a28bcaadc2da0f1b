"""Time buckets: Column -> Column, session time zone UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRANULARITIES = ("year", "month", "week", "day")


def event_time(published: Column, retrieved: Column) -> Column:
    return F.coalesce(published, retrieved)


def lenient_timestamp(c: Column) -> Column:
    """NULL for text that is no timestamp."""
    return F.try_to_timestamp(c)


def year_bucket(year: Column) -> Column:
    return F.when(year.isNotNull() & (year != 0), year.cast("string"))


def month_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def week_bucket(ts: Column) -> Column:
    """ISO year and week, as in 2024-W03."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), ts).cast("string"), 2, "0"))


def day_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def bucket(granularity: str, ts: Column, year: Column | None = None) -> Column:
    if granularity == "year":
        return year_bucket(F.year(ts) if year is None else year)
    return {"month": month_bucket, "week": week_bucket, "day": day_bucket}[granularity](ts)


def older_than(latest: Column, days: int, ref: Column) -> Column:
    """Whether the last time is unknown or over `days` days before ref."""
    return latest.isNull() | (ref - latest > F.expr(f"INTERVAL {days} DAYS"))
