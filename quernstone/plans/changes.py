"""Queries over what changes: topics from a stream, summaries refreshed by union, payloads of any shape, and batches that replace records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import time as T
from quernstone.operators import sketches, upsert
from quernstone.plans import adapters as A
from quernstone.plans.adapters import SQL_PAPERS, SQL_PK
from quernstone.plans.registry import query
from quernstone.plans.series import _topics_sql
from quernstone.scratch import new_path
from quernstone.sources import variants
from quernstone.sources.tables import table
from quernstone.streaming import topics
from quernstone.streaming.feeds import drain, until_batches

RECORDS = "ts timestamp, category string, keyword string, bucket string, count bigint, end_ms bigint"


@query(_topics_sql(1.05))
def emerging_topics_stream(spark, sf_dir):
    """Emerging topics of all papers' keywords from a stream in no order, which is stopped after its first batch and goes on from its checkpoint."""
    papers = A.papers(spark, sf_dir).select("paper_id", T.week_bucket(F.col("published_at")).alias("bucket"), F.date_trunc("week", "published_at").alias("ts"))
    rows = A.paper_keywords(spark, sf_dir).select("paper_id", "keyword", "method").join(papers, "paper_id").groupBy("keyword", "bucket", "ts", "method").agg(F.count("*").alias("count"))
    end = (F.unix_millis("ts") + 7 * 86_400_000).alias("end_ms")
    landed, out, checkpoint = (new_path(spark, f"topics-{n}") for n in ("rows", "rings", "checkpoint"))
    rows.select("ts", F.lit("ALL").alias("category"), "keyword", "bucket", "count", end).repartition(6, F.xxhash64("keyword", "bucket", "method")).write.parquet(landed)

    def start():
        records = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 2).parquet(landed)
        return topics.into_batches(topics.rings(records, "36500 days"), out, checkpoint)

    until_batches(start(), 1)
    drain(start())
    return topics.emerging(topics.latest(spark, out), min_growth=1.05)


def _scored(spark, sf_dir):
    pk = A.paper_keywords(spark, sf_dir).select("paper_id", "keyword", "score")
    return pk.join(A.papers(spark, sf_dir).select("paper_id", "venue", "year"), "paper_id").select("venue", "year", "keyword", "score")


_SCORED = f"{SQL_PAPERS}, {SQL_PK}, sc AS (SELECT venue, year, keyword, score FROM pk JOIN papers USING (paper_id))"


@query(f"WITH {_SCORED} SELECT venue, count(*) AS n, count(DISTINCT keyword) AS keywords, count(DISTINCT keyword) AS exact, round({sketches.within()!r}, 6)::DOUBLE AS within, true AS median_in_bound FROM sc GROUP BY venue")
def keyword_sketches(spark, sf_dir):
    """Sketches by venue and year, rolled up to venues by union: the estimate of distinct keywords beside the exact number and its bound, and whether the median's rank is within its own."""
    rows = _scored(spark, sf_dir)
    by_venue = sketches.estimates(sketches.united(sketches.sketched(rows, "venue", "year"), "venue"), "venue")
    ranks = rows.join(by_venue.select("venue", "q50"), "venue").groupBy("venue").agg(F.count_distinct("keyword").alias("exact"), F.avg((F.col("score") < F.col("q50")).cast("double")).alias("under"), F.avg((F.col("score") <= F.col("q50")).cast("double")).alias("upto"))
    held = (F.col("under") <= 0.5 + sketches.RANK) & (F.col("upto") >= 0.5 - sketches.RANK)
    return by_venue.join(ranks, "venue").select("venue", "n", "keywords", "exact", F.round(F.lit(sketches.within()), 6).alias("within"), held.alias("median_in_bound"))


@query(f"WITH {_SCORED} SELECT venue, year, count(*) AS n, count(DISTINCT keyword) AS keywords FROM sc GROUP BY venue, year")
def keyword_sketches_refreshed(spark, sf_dir):
    """What is stored has the papers before 1999 and is refreshed by the papers since: as if all were sketched at once."""
    rows = _scored(spark, sf_dir)
    at = new_path(spark, "sketches")
    sketches.sketched(rows.where("year < 1999"), "venue", "year").write.parquet(at)
    return sketches.estimates(sketches.refreshed(spark.read.parquet(at), rows.where("year >= 1999"), "venue", "year"), "venue", "year").select("venue", "year", "n", "keywords")


_PAYLOAD = "SELECT o_orderkey AS k, o_orderkey % 9 AS shape, o_orderpriority AS t FROM orders"


def _payloads(spark, sf_dir):
    """Notes of nine shapes: plain, wrapped, cut off, blank, a list, without an id, with a null title, with a number for a title, with an object for one."""
    k, t = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    note = lambda title: F.concat(F.lit('{"id": "n'), k, F.lit('", "content": {"title": '), title, F.lit("}}"))
    text = F.concat(F.lit('"'), t, F.lit('"'))
    shapes = [note(text), note(F.concat(F.lit('{"value": '), text, F.lit("}"))), F.substring(note(text), 1, 20), F.lit("  "), F.lit("[1, 2]"), F.concat(F.lit('{"content": {"title": '), text, F.lit("}}")), note(F.lit("null")), note(k), note(F.lit('{"other": 1}'))]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.element_at(F.array(*shapes), (F.col("o_orderkey") % 9 + 1).cast("int")).alias("payload"))


@query(f"""WITH p AS ({_PAYLOAD}) SELECT k, CASE WHEN shape IN (0, 1, 6, 7, 8) THEN 'n' || k END AS source_paper_id, CASE WHEN shape IN (0, 1, 5) THEN t WHEN shape = 7 THEN k::VARCHAR END AS title,
    CASE shape WHEN 2 THEN 'malformed' WHEN 3 THEN 'empty' WHEN 4 THEN 'no object' WHEN 5 THEN 'no id' WHEN 6 THEN 'no title' WHEN 8 THEN 'no title' END AS cause FROM p""")
def payload_variants(spark, sf_dir):
    """Every payload with what it says, or why it is a reject."""
    return variants.judged(_payloads(spark, sf_dir), "id", "content.title").select("k", "source_paper_id", "title", "cause")


@query(f"WITH p AS ({_PAYLOAD}) SELECT CASE shape WHEN 2 THEN 'malformed' WHEN 3 THEN 'empty' WHEN 4 THEN 'no object' WHEN 5 THEN 'no id' ELSE 'no title' END AS cause, count(*) AS payloads FROM p WHERE shape NOT IN (0, 1, 7) GROUP BY 1")
def payload_rejects(spark, sf_dir):
    judged = variants.judged(_payloads(spark, sf_dir), "id", "content.title")
    return variants.rejects(judged).groupBy("cause").agg(F.count("*").alias("payloads"))


def _replaced(spark, sf_dir):
    """All orders as records with links to their customer and suppliers; every line comes as a newer record of its order, every customer as a new one."""
    o, lines, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    name = lambda source, k: [F.lit(source).alias("source"), F.col(k).cast("string").alias("source_paper_id")]
    current = o.select(F.col("o_orderkey").alias("raw_id"), *name("o", "o_orderkey"), F.col("o_orderpriority").alias("title"))
    links = o.select(F.col("o_orderkey").alias("raw_id"), F.col("o_custkey").alias("paper_id")).unionByName(lines.select(F.col("l_orderkey").alias("raw_id"), (F.col("l_suppkey") + 10**9).alias("paper_id")).distinct())
    again = lines.select((F.lit(10**12) + F.col("l_orderkey") * 10**6 + F.col("l_partkey")).alias("seq"), *name("o", "l_orderkey"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("title"))
    first = c.select((F.lit(2 * 10**12) + F.col("c_custkey")).alias("seq"), *name("c", "c_custkey"), F.col("c_name").alias("title"))
    return upsert.replaced(current, links, again.unionByName(first), ["source", "source_paper_id"])


_NEW = "n AS (SELECT l_orderkey AS k, max(l_partkey) AS part FROM lineitem GROUP BY l_orderkey)"


@query(f"""WITH {_NEW} SELECT CASE WHEN part IS NULL THEN o_orderkey ELSE 1000000000000 + o_orderkey * 1000000 + part END AS raw_id, 'o' AS source, o_orderkey::VARCHAR AS source_paper_id, coalesce('t' || part, o_orderpriority) AS title FROM orders LEFT JOIN n ON k = o_orderkey
    UNION ALL SELECT 2000000000000 + c_custkey, 'c', c_custkey::VARCHAR, c_name FROM customer""")
def replaced_records(spark, sf_dir):
    return _replaced(spark, sf_dir)[0].select("raw_id", "source", "source_paper_id", "title")


@query("SELECT o_orderkey AS raw_id, o_custkey AS paper_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def replaced_links(spark, sf_dir):
    """Links of records that the batch has not replaced: the others' have gone with their ids."""
    return _replaced(spark, sf_dir)[1].select("raw_id", "paper_id")


@query(f"""WITH {_NEW}, s AS (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) + 1 AS links FROM lineitem GROUP BY l_orderkey)
    SELECT 'o' AS source, k::VARCHAR AS source_paper_id, 'replace' AS kind, 1000000000000 + k * 1000000 + part AS raw_id, k AS old_id, links FROM n JOIN s USING (k) UNION ALL SELECT 'c', c_custkey::VARCHAR, 'insert', 2000000000000 + c_custkey, NULL, 0 FROM customer""")
def replaced_changes(spark, sf_dir):
    return _replaced(spark, sf_dir)[2].select("source", "source_paper_id", "kind", "raw_id", "old_id", "links")
