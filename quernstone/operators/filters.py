"""Optional conjunctive filters and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(df: DataFrame, **equal) -> DataFrame:
    """Rows that equal every given value; a value that is None, 0 or '' is no filter."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in equal.items() if v), df)


def resolve_venue(df: DataFrame, venues: DataFrame, name: str | None, lenient: bool = False) -> DataFrame:
    """Rows of the named venue; an unknown name gives none, or with lenient=True all. venues: (venue_id, canonical_name)."""
    if not name:
        return df
    one = F.broadcast(venues.where(F.col("canonical_name") == name).select("venue_id").limit(1))
    known = df.join(one, "venue_id", "left_semi")
    return known if not lenient or one.take(1) else df


def in_category(c: Column, category: str, any_case: bool = True) -> Column:
    """Whether a category list has the text of the category in it; ALL is in every list."""
    if category == "ALL":
        return F.lit(True)
    return F.lower(c).contains(category.lower()) if any_case else c.contains(category)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def autocomplete(keywords: DataFrame, typed: str, limit: int = 10) -> DataFrame:
    """(keyword, count) that contain what is typed, most frequent first; under two characters, none."""
    hit = F.lower("keyword").contains(typed.lower()) if len(typed) >= 2 else F.lit(False)
    return keywords.where(hit).orderBy(F.desc("count"), "keyword").limit(limit)
