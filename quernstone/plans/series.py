"""Queries over time buckets and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import time as T
from quernstone.operators import filters as P
from quernstone.operators import keywords as K
from quernstone.operators import series as S
from quernstone.operators import upsert
from quernstone.plans import adapters as A
from quernstone.plans.adapters import SQL_EVENTS, SQL_KP, SQL_PAPERS, SQL_PK
from quernstone.plans.registry import query
from quernstone.sources.tables import bulk, recent, table

_SQL_BUCKET = {"year": "strftime({t}, '%Y')", "month": "strftime({t}, '%Y-%m')", "week": "strftime({t}, '%G-W%V')", "day": "strftime({t}, '%Y-%m-%d')"}


def _buckets(granularity):
    def run(spark, sf_dir):
        rows = A.papers(spark, sf_dir).withColumn("bucket", T.bucket(granularity, F.col("published_at"), F.col("year")))
        return rows.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("papers"))

    run.__name__ = f"bucket_{granularity}"
    return run


for _g, _sql in _SQL_BUCKET.items():
    query(f"WITH {SQL_PAPERS} SELECT {_sql.format(t='published_at')} AS bucket, count(*) AS papers FROM papers GROUP BY ALL")(_buckets(_g))

_EACH = " UNION ALL ".join(f"SELECT '{g}' AS granularity, {s.format(t='ts')} AS bucket, category, keyword FROM ev" for g, s in _SQL_BUCKET.items())
_BUCKETED = f"{SQL_EVENTS}, e1 AS ({_EACH}), b AS (SELECT * FROM e1 UNION ALL SELECT granularity, bucket, 'ALL', keyword FROM e1)"


@query(f"WITH {_BUCKETED} SELECT category, granularity, bucket, count(*) AS paper_count FROM b GROUP BY ALL")
def timeseries_counts(spark, sf_dir):
    return S.paper_counts(S.bucketed(A.events(spark, sf_dir).select("ts", "category")))


@query(f"""WITH {_BUCKETED}, r AS (SELECT category, granularity, bucket, keyword, count(*) AS c, row_number() OVER (PARTITION BY category, granularity, bucket ORDER BY count(*) DESC, keyword) AS rank
    FROM b WHERE keyword IS NOT NULL GROUP BY category, granularity, bucket, keyword) SELECT category, granularity, bucket, string_agg(keyword || ':' || c, '|' ORDER BY rank) AS top_keywords FROM r WHERE rank <= 10 GROUP BY ALL""")
def timeseries_top_keywords(spark, sf_dir):
    by = ["category", "granularity", "bucket"]
    return K.listed(K.ranked(S.keyword_counts(S.bucketed(A.events(spark, sf_dir).select("ts", "category", "keyword"))), by, 10), by)


@query(f"WITH {_BUCKETED} SELECT granularity, bucket, keyword, count(*) AS count FROM b WHERE category = 'ALL' AND granularity = 'week' GROUP BY ALL")
def bucket_keyword_trend(spark, sf_dir):
    rows = S.bucketed(A.events(spark, sf_dir).select("ts", "category", "keyword"), ("week",), every=False)
    return rows.groupBy("granularity", "bucket", "keyword").agg(F.count("*").alias("count"))


def _topics_sql(growth: float) -> str:
    return f"""WITH {SQL_PAPERS}, {SQL_PK}, c AS (SELECT 'ALL' AS category, strftime(published_at, '%G-W%V') AS bucket, keyword, count(*) AS count FROM pk JOIN papers USING (paper_id) GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY bucket DESC) AS nth FROM c),
    a AS (SELECT category, keyword, count(*) AS n, avg(count) FILTER (nth <= 4) AS recent, avg(count) FILTER (nth > 4 AND nth <= 8) AS past, min(bucket) AS first_seen FROM n GROUP BY ALL),
    g AS (SELECT *, recent / CASE WHEN coalesce(past, 0) > 0 THEN past ELSE 0.1 END AS rate FROM a WHERE n >= 4 AND (SELECT count(DISTINCT bucket) FROM c) >= 8)
    SELECT category, keyword, round_even(rate, 2)::DOUBLE AS growth_rate, first_seen, CAST(trunc(recent) AS BIGINT) AS recent_count, 'rising' AS trend FROM g WHERE rate >= {growth}"""


def _weekly(spark, sf_dir):
    papers = A.papers(spark, sf_dir).select("paper_id", T.week_bucket(F.col("published_at")).alias("bucket"))
    rows = A.paper_keywords(spark, sf_dir).select("paper_id", "keyword").join(papers, "paper_id")
    return rows.groupBy(F.lit("ALL").alias("category"), "bucket", "keyword").agg(F.count("*").alias("count"))


@query(_topics_sql(1.05))
def emerging_topics(spark, sf_dir):
    return S.emerging_topics(_weekly(spark, sf_dir), min_growth=1.05)


@query(_topics_sql(1.5))
def emerging_topics_default(spark, sf_dir):
    return S.emerging_topics(_weekly(spark, sf_dir))


_SETS = f"""{SQL_KP}, r AS (SELECT venue AS category, keyword, row_number() OVER (PARTITION BY venue ORDER BY count(*) DESC, keyword) AS n FROM kp GROUP BY venue, keyword), s AS (SELECT category, keyword FROM r WHERE n <= 40),
    u AS (SELECT keyword, count(*) AS n, min(category) AS category FROM s GROUP BY keyword)"""


def _sets(spark, sf_dir):
    rows = K.of_papers(A.paper_keywords(spark, sf_dir), A.papers(spark, sf_dir)).withColumnRenamed("venue", "category")
    return K.ranked(K.counts(rows, "category"), ["category"], 40).select("category", "keyword")


@query(f"""WITH {_SETS} SELECT count(*) FILTER (n = k) AS n_common, count(*) AS n_union, round_even(count(*) FILTER (n = k) / count(*), 2)::DOUBLE AS overlap_rate,
    coalesce(string_agg(keyword, '|' ORDER BY keyword) FILTER (n = k), '') AS common FROM u, (SELECT count(DISTINCT category) AS k FROM s)""")
def category_overlap(spark, sf_dir):
    return S.overlap(_sets(spark, sf_dir))


@query(f"WITH {_SETS}, w AS (SELECT category, keyword, CAST(row_number() OVER (PARTITION BY category ORDER BY keyword) AS INTEGER) AS nth FROM u WHERE n = 1) SELECT * FROM w WHERE nth <= 10")
def category_unique(spark, sf_dir):
    return S.only_in(_sets(spark, sf_dir))


@query("""WITH e AS (SELECT event_type AS categories FROM events) SELECT c AS category, count(*) AS papers FROM e, (SELECT unnest(['CLICK', 'vi', 'purchase', 'a', 'zz']) AS c) WHERE contains(lower(categories), lower(c)) GROUP BY c""")
def category_stats(spark, sf_dir):
    return S.category_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("categories")), ["CLICK", "vi", "purchase", "a", "zz"])


@query("SELECT count(*) AS papers, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events")
def date_range(spark, sf_dir):
    f = "yyyy-MM-dd HH:mm:ss"
    return A.events(spark, sf_dir).agg(F.count("*").alias("papers"), F.date_format(F.min("ts"), f).alias("first_at"), F.date_format(F.max("ts"), f).alias("last_at"))


@query("SELECT event_id AS paper_id, event_type AS category, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE contains(lower(event_type), 'c') ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def paged_listing(spark, sf_dir):
    rows = A.events(spark, sf_dir)
    found = P.page(rows.where(P.in_category(F.col("category"), "C")), [F.desc("ts"), F.asc("paper_id")], 40, 20)
    return found.select("paper_id", "category", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events)
    SELECT user_id, event_type, event_id, round(value, 6) AS value FROM r WHERE n = 1""")
def upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))
    half = rows.agg(F.percentile_approx("event_id", 0.5).alias("m"))
    split = rows.join(F.broadcast(half))
    key, order = ["user_id", "event_type"], [F.col("event_id")]
    return upsert.upsert(split.where("event_id <= m").drop("m"), split.where("event_id > m").drop("m"), key, order)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
    SELECT user_id, event_type, event_id FROM r WHERE n = 1""")
def insert_or_ignore(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    half = rows.agg(F.percentile_approx("event_id", 0.5).alias("m"))
    split = rows.join(F.broadcast(half))
    key = ["user_id", "event_type"]
    old = upsert.first_wins(rows.limit(0), split.where("event_id <= m").drop("m"), key, [F.col("event_id")])
    return upsert.first_wins(old, split.where("event_id > m").drop("m"), key, [F.col("event_id")])


@query("SELECT event_type AS category, count(*) AS total, count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS) AS last_7_days FROM events GROUP BY event_type")
def recent_increment(spark, sf_dir):
    rows = A.events(spark, sf_dir)
    ref = rows.agg(F.max("ts").alias("ref"))
    joined = rows.join(F.broadcast(ref))
    return joined.groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.col("ts") >= F.col("ref") - F.expr("INTERVAL 7 DAYS")).alias("last_7_days"))


@query("""WITH m AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id), r AS (SELECT max(ts) AS ref FROM events)
    SELECT count(*) FILTER (ref - last > INTERVAL 7 DAYS) AS stale, count(*) AS users FROM m, r""")
def stale_sources(spark, sf_dir):
    rows = A.events(spark, sf_dir)
    last = rows.groupBy("user_id").agg(F.max("ts").alias("last"))
    ref = rows.agg(F.max("ts").alias("ref"))
    return last.join(F.broadcast(ref)).agg(F.count_if(T.older_than(F.col("last"), 7, F.col("ref"))).alias("stale"), F.count("*").alias("users"))


@query(f"""WITH {SQL_PAPERS}, n AS (SELECT paper_id, year, venue AS category, row_number() OVER (PARTITION BY year, venue ORDER BY published_at, paper_id) AS n FROM papers WHERE year IN (1996, 1997))
    SELECT paper_id, year, category FROM n WHERE n <= 100 // (SELECT count(DISTINCT category) FROM n)""")
def bulk_collection(spark, sf_dir):
    rows = A.papers(spark, sf_dir).select(F.col("paper_id").alias("raw_id"), "year", F.col("venue").alias("category"), "published_at")
    return bulk(rows, [1996, 1997], 100).select(F.col("raw_id").alias("paper_id"), "year", "category")


@query(f"WITH {SQL_PAPERS} SELECT year, count(*) AS papers FROM papers WHERE published_at >= TIMESTAMP '1999-07-01' OR year >= 1999 GROUP BY year")
def recent_records(spark, sf_dir):
    rows = A.papers(spark, sf_dir).withColumn("retrieved_at", F.col("published_at"))
    return recent(rows, F.lit("1999-07-01").cast("timestamp")).groupBy("year").agg(F.count("*").alias("papers"))
