"""Queries over feeds that answer in pages: the driver's tables land as pages of a feed and are read as one."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.plans import adapters as A
from quernstone.plans.adapters import SQL_PAPERS
from quernstone.plans.registry import query
from quernstone.scratch import new_path
from quernstone.sources import feeds, paged
from quernstone.sources.tables import table
from quernstone.streaming.feeds import drain, into_files, until_batches

_SEARCHES = {s: feeds.arxiv_expression([f"cs.{s}"], "order") for s in ("F", "O", "P")}


@query("""WITH r AS (SELECT o_orderstatus AS status, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) - 1 AS place, 'http://arxiv.org/abs/' || o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)
    SELECT status, place, id, year FROM r WHERE place BETWEEN 35 AND 334""")
def paged_search(spark, sf_dir):
    """Three searches over all orders, latest first: 300 results from the 35th on, in pages of 50 that several tasks read."""
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("(cat:cs."), "o_orderstatus", F.lit(") AND (order)"))
    rows = o.select(text.alias("request"), F.concat(F.lit("http://arxiv.org/abs/"), "o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), "o_orderdate", "o_orderkey")
    path = new_path(spark, "search-pages")
    paged.land(rows, path, [F.desc("o_orderdate"), "o_orderkey"], size=50, paging="offset")
    out = None
    for status, text in _SEARCHES.items():
        part = paged.search(spark, text, 35, 300, "place bigint, id string, year int", path=path, page_size="50", pages_each="2").select(F.lit(status).alias("status"), "place", "id", "year")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {SQL_PAPERS} SELECT venue, year, paper_id, row_number() OVER (PARTITION BY venue, year ORDER BY paper_id) - 1 AS place FROM papers WHERE venue IN ('BUILDING', 'MACHINERY') AND year = 1997")
def paged_works(spark, sf_dir):
    """All works by venue and year behind cursors; the wanted values drop the requests of other venues and years before a page of theirs is read."""
    rows = A.papers(spark, sf_dir).select("paper_id", "venue", "year", F.concat(F.lit("venue:"), "venue", F.lit(",year:"), "year").alias("request"))
    path = new_path(spark, "works-pages")
    paged.land(rows, path, ["paper_id"], size=40)
    venues = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    asked = [feeds.works_filter(venue=v, year=y) for v in venues for y in range(1995, 2002)]
    works = paged.read(spark, asked, "token", "paper_id bigint, venue string, year int, place bigint", only={"venue": ["BUILDING", "MACHINERY"], "year": [1997]}, path=path)
    return works.select("venue", "year", "paper_id", "place")


@query("SELECT event_type AS request, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS place, event_id, user_id, CAST(value AS DOUBLE) AS value FROM events")
def paged_stream(spark, sf_dir):
    """All events behind continuation tokens, as a stream that is stopped after two batches and goes on from its checkpoint: each record once."""
    e = table(spark, sf_dir, "events")
    path, out, checkpoint = (new_path(spark, f"token-{n}") for n in ("pages", "rows", "checkpoint"))
    paged.land(e.select(F.col("event_type").alias("request"), "event_id", "user_id", "value"), path, ["event_id"], size=max(50, -(-e.count() // 100)))
    kinds = sorted(r.event_type for r in e.select("event_type").distinct().collect())
    rows = lambda: paged.stream(spark, kinds, "token", "request string, place bigint, event_id bigint, user_id bigint, value double", path=path, pages_each="3")
    until_batches(into_files(rows(), out, checkpoint), 2)
    drain(into_files(rows(), out, checkpoint))
    return spark.read.parquet(out).select("request", "place", "event_id", "user_id", "value")


@query("""WITH r AS (SELECT o_custkey % 40 AS venue, CASE WHEN o_custkey % 3 = 0 THEN 3 WHEN o_orderpriority < '3' THEN 1 ELSE 2 END AS kind, o_orderkey FROM orders),
    k AS (SELECT venue, CASE WHEN venue % 2 = 0 THEN kind ELSE greatest(kind, 2) END AS kind, o_orderkey FROM r), m AS (SELECT venue, min(kind) AS kind FROM k GROUP BY venue),
    n AS (SELECT venue, ['Submission', 'Blind_Submission', 'blind-submission'][kind] AS invitation, o_orderkey, row_number() OVER (PARTITION BY venue ORDER BY o_orderkey) - 1 AS place FROM k JOIN m USING (venue, kind))
    SELECT 'venue' || venue || '.cc/-/' || invitation AS request, place, o_orderkey AS note FROM n WHERE place BETWEEN 5 AND 29""")
def paged_submissions(spark, sf_dir):
    """25 submissions from the fifth on of each venue, under the first invitation that has any; venues of odd numbers have none under the first."""
    venue = F.col("o_custkey") % 40
    kind = F.when(F.col("o_custkey") % 3 == 0, 3).when(F.col("o_orderpriority") < "3", 1).otherwise(2)
    kind = F.when(venue % 2 == 0, kind).otherwise(F.greatest(kind, F.lit(2)))
    name = F.element_at(F.array(F.lit("Submission"), F.lit("Blind_Submission"), F.lit("blind-submission")), kind)
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("venue"), venue, F.lit(".cc/-/"), name).alias("request"), F.col("o_orderkey").alias("note"))
    path = new_path(spark, "submission-pages")
    paged.land(rows, path, ["note"], size=10)
    return paged.submissions(spark, [f"venue{v}.cc" for v in range(40)], 5, 25, "request string, place bigint, note bigint", path=path)
