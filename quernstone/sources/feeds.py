"""What a crawl of an upstream feed returns, over landed records: searches, pages, stop rules and tallies.

Nothing is fetched: a crawler lands records, each with its place in the feed's order where one matters, and these functions select from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import any_of, blank

#: Rows of one request at most, as the feeds state them.
MOST_RESULTS, PAGE = 2_000, 500


def arxiv_expression(categories: list[str], query: str | None = None) -> str:
    """The feed's search text: (cat:a OR cat:b) AND (query)."""
    cats = "(" + " OR ".join(f"cat:{c}" for c in categories) + ")" if categories else ""
    return " AND ".join(x for x in (cats, f"({query})" if query else "") if x)


def search(records: DataFrame, categories: list[str], query: str | None = None, start: int = 0, results: int = 100) -> DataFrame:
    """Records of any of the categories whose title or abstract has the query in any case, latest first, then by id."""
    rows = records
    if categories:
        rows = rows.where(any_of(F.coalesce(F.col("categories").contains(c), F.lit(False)) for c in categories))
    if query:
        rows = rows.where(any_of(F.coalesce(F.lower(c).contains(query.lower()), F.lit(False)) for c in ("title", "abstract")))
    return rows.orderBy(F.desc("published_at"), "source_paper_id").offset(start).limit(min(results, MOST_RESULTS))


def of_ids(records: DataFrame, ids: list[str]) -> DataFrame:
    return records.where(F.col("source_paper_id").isin(ids))


def until_stale(records: DataFrame, cutoff: Column, page: int = PAGE, share: float = 0.5) -> DataFrame:
    """Recent records of the pages up to the first on which under `share` are recent (that page included).

    records have `place`, their row in the feed's order; recent: retrieved since the cutoff, or of its year or later.
    """
    fresh = F.coalesce((F.col("retrieved_at") >= cutoff) | (F.col("year") >= F.year(cutoff)), F.lit(False))
    rows = records.withColumn("page", F.floor(F.col("place") / F.lit(page))).withColumn("fresh", fresh)
    pages = rows.groupBy("page").agg(F.avg(F.col("fresh").cast("double")).alias("share"))
    stop = pages.agg(F.min(F.when(F.col("share") < share, F.col("page"))).alias("stop"))  # one row
    return rows.where("fresh").join(F.broadcast(stop)).where("stop is null or page <= stop").drop("page", "fresh", "stop")


def works_filter(**terms) -> str:
    """The filter text of a works request: name:value, comma-joined, values that are None left out."""
    return ",".join(f"{k}:{v}" for k, v in terms.items() if v is not None)


def works(records: DataFrame, terms: str, after: str | None = None, page: int = 200) -> DataFrame:
    """A page of the records that meet every term of a filter text, by id, beyond the cursor (the last id of the page before)."""
    rows = records
    for term in filter(None, terms.split(",")):
        name, _, value = term.partition(":")
        rows = rows.where(F.col(name).cast("string") == value)
    rows = rows if after is None else rows.where(F.col("source_paper_id") > after)
    return rows.orderBy("source_paper_id").limit(page)


def named_venues(venues: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Venues whose name has the text in any case, by name."""
    return venues.where(F.lower("name").contains(text.lower())).orderBy("name").limit(limit)


def with_fallback(records: DataFrame, invitations: list[str]) -> DataFrame:
    """Each venue's submissions under the first invitation, in the given order, that has any."""
    rank = F.array_position(F.array(*[F.lit(i) for i in invitations]), F.col("invitation"))
    rows = records.withColumn("rank", rank).where("rank > 0")
    first = rows.groupBy("venue").agg(F.min("rank").alias("rank"))
    return rows.join(first, ["venue", "rank"]).drop("rank")


def conferences(ids: DataFrame, known: list[str], year: int | None = None) -> DataFrame:
    """Venue ids that are conferences and no workshops, of the year if given, with the first known name that they hold, or NULL."""
    rows = ids.where(F.col("id").contains("Conference") & ~F.col("id").contains("Workshop"))
    rows = rows if year is None else rows.where(F.col("id").contains(f"/{year}/"))
    hits = F.filter(F.array(*[F.lit(k) for k in known]), lambda k: F.lower("id").contains(F.lower(k)))
    return rows.select("id", F.get(hits, 0).alias("known"))


def tallies(known: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(saved, duplicates, errors) of a batch: rows of keys that are not known, rows of known keys or beyond a key's first, rows without a key or title."""
    bad = any_of(blank(F.col(k).cast("string")) for k in key) | blank(F.trim("title"))
    per = new.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    seen = per.join(known.select(*key).distinct().withColumn("seen", F.lit(1)), key, "left")
    good = F.col("n") - F.col("bad")
    saved = F.when((good > 0) & F.col("seen").isNull(), 1).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return seen.agg(total(saved).alias("saved"), total(good - saved).alias("duplicates"), total("bad").alias("errors"))


def plan_run(sources: list[str], configured: dict[str, list[int]], venues: list[str] | None = None, years: list[int] | None = None, categories: list[str] | None = None) -> list[dict]:
    """The requests of an ingestion run, source by source.

    arxiv takes categories and needs no venue; openalex and s2 are asked only if both venues and years are given; openreview takes the given venues, or all
    that are configured, in the given years, or 2024 and 2023, as far as they are configured for the venue.
    """
    out: list[dict] = []
    for source in sources:
        if source == "arxiv":
            out.append({"source": source, "search": arxiv_expression(categories or [])})
        elif source in ("openalex", "s2"):
            out += [{"source": source, "venue": v, "year": y} for v in venues or [] for y in years or []]
        elif source == "openreview":
            out += [{"source": source, "venue": v, "year": y} for v in venues or configured for y in years or (2024, 2023) if y in configured.get(v, [])]
        else:
            raise ValueError(f"unknown source: {source}")
    return out
