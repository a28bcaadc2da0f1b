"""Queries that serve and export: lookups, listings, static files, charts' data sets, gates and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.functions import time as T
from quernstone.functions import udfs
from quernstone.operators import export, upsert
from quernstone.operators import filters as P
from quernstone.operators import keywords as K
from quernstone.operators import lookups as L
from quernstone.operators import quality as Q
from quernstone.operators import series as S
from quernstone.plans import adapters as A
from quernstone.plans.adapters import SQL_EVENTS, SQL_KP, SQL_PAPERS, SQL_PK, SQL_SOURCES, SQL_SUB, SQL_VENUES
from quernstone.plans.corpus import _venue_ids_sql, venue_id_parse
from quernstone.plans.keywords import _GRID, _RANKS, _rows
from quernstone.plans.keywords import _emerging_sql
from quernstone.plans.registry import query
from quernstone.plans.series import _BUCKETED, _topics_sql, _weekly
from quernstone.sources import feeds
from quernstone.sources.tables import by_source, point, table

# ------------------------------------------------------------ lookups


@query(f"WITH {SQL_SUB} SELECT raw_id, source FROM sub WHERE source = 's2' ORDER BY raw_id LIMIT 25")
def raw_by_source(spark, sf_dir):
    return by_source(A.submissions(spark, sf_dir), "s2", 25).select("raw_id", "source")


@query(f"WITH {SQL_SUB} SELECT source, count(*) AS n FROM sub WHERE source = 'arxiv' GROUP BY source UNION ALL SELECT 'any', count(*) FROM sub")
def raw_counts(spark, sf_dir):
    raw = A.submissions(spark, sf_dir)
    one = lambda s, name: L.count_of(raw, source=s).select(F.lit(name).alias("source"), "n")
    return one("arxiv", "arxiv").unionByName(one(None, "any"))


@query(f"WITH {SQL_SUB} SELECT 'id' AS by, raw_id, source FROM sub WHERE raw_id = 17 UNION ALL SELECT 'key', raw_id, source FROM sub WHERE source = 's2' AND raw_id = 19")
def raw_points(spark, sf_dir):
    """By id, and by source and id."""
    raw = A.submissions(spark, sf_dir)
    return point(raw, raw_id=17).select(F.lit("id").alias("by"), "raw_id", "source").unionByName(point(raw, source="s2", raw_id=19).select(F.lit("key").alias("by"), "raw_id", "source"))


@query(f"WITH {SQL_VENUES} SELECT name, tier, domain FROM ven ORDER BY tier, name LIMIT 30")
def venue_listing(spark, sf_dir):
    return L.by_tier(A.venues(spark, sf_dir)).select("name", "tier", "domain").limit(30)


@query(f"WITH {SQL_VENUES} SELECT 'domain' AS by, name FROM (FROM ven WHERE domain = 'D1' ORDER BY tier, name LIMIT 10) UNION ALL SELECT 'tier', name FROM (FROM ven WHERE tier = 'B' ORDER BY tier, name LIMIT 10) UNION ALL SELECT 'name', name FROM ven WHERE name = 'Supplier#000000003'")
def venue_lookups(spark, sf_dir):
    v = A.venues(spark, sf_dir)
    parts = [L.by_tier(v, domain="D1").limit(10).select(F.lit("domain").alias("by"), "name"), L.by_tier(v, tier="B").limit(10).select(F.lit("tier").alias("by"), "name"), point(v, name="Supplier#000000003").select(F.lit("name").alias("by"), "name")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {SQL_PAPERS} SELECT venue, year, count(*) AS papers FROM papers WHERE venue = 'BUILDING' AND year = 1995 GROUP BY ALL")
def papers_of_venue_year(spark, sf_dir):
    return P.where(A.papers(spark, sf_dir), venue="BUILDING", year=1995).groupBy("venue", "year").agg(F.count("*").alias("papers"))


@query(f"WITH {SQL_PAPERS} SELECT 'both' AS by, count(*) FILTER (venue = 'BUILDING' AND year = 1995) AS n FROM papers UNION ALL SELECT 'venue', count(*) FILTER (venue = 'BUILDING') FROM papers UNION ALL SELECT 'none', count(*) FROM papers UNION ALL SELECT 'unknown', 0 FROM (SELECT 1)")
def paper_counts_filtered(spark, sf_dir):
    p = A.papers(spark, sf_dir)
    out = None
    for name, equal in (("both", {"venue": "BUILDING", "year": 1995}), ("venue", {"venue": "BUILDING", "year": 0}), ("none", {}), ("unknown", {"venue": "nowhere"})):
        one = L.count_of(p, **equal).select(F.lit(name).alias("by"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {SQL_SOURCES}, o AS (SELECT min(paper_id) AS paper_id FROM ps) SELECT paper_id, raw_id, source FROM ps JOIN o USING (paper_id)")
def sources_of_paper(spark, sf_dir):
    ps = A.paper_sources(spark, sf_dir)
    return ps.join(F.broadcast(ps.agg(F.min("paper_id").alias("paper_id"))), "paper_id", "left_semi").select("paper_id", "raw_id", "source")


@query(f"WITH {SQL_PK} SELECT paper_id, coalesce(string_agg(DISTINCT keyword, '|' ORDER BY keyword) FILTER (method = 'A'), '') AS author, coalesce(string_agg(DISTINCT keyword, '|' ORDER BY keyword) FILTER (method <> 'A'), '') AS extracted, count(DISTINCT keyword) AS keywords FROM pk WHERE paper_id % 100 = 0 GROUP BY paper_id")
def paper_with_keywords(spark, sf_dir):
    """Author's and other keywords of papers, and how many both are together."""
    pk = A.paper_keywords(spark, sf_dir).where("paper_id % 100 = 0").withColumn("method", F.when(F.col("method") == "A", "author").otherwise(F.col("method")))
    rows = L.split_keywords(pk.select("paper_id").distinct(), pk)
    return rows.select("paper_id", F.array_join("author", "|").alias("author"), F.array_join("extracted", "|").alias("extracted"), F.size(L.all_keywords()).cast("bigint").alias("keywords"))


@query(f"WITH {SQL_VENUES}, p AS (SELECT o_orderkey AS paper_id, o_custkey % 200 AS venue_id FROM orders) SELECT coalesce(name, '?') AS venue_name, count(*) AS papers FROM p LEFT JOIN ven USING (venue_id) GROUP BY ALL")
def papers_with_venue_names(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), (F.col("o_custkey") % 200).alias("venue_id"))
    return L.with_venue_names(p, A.venues(spark, sf_dir)).groupBy(F.coalesce("venue_name", F.lit("?")).alias("venue_name")).agg(F.count("*").alias("papers"))


@query(f"""WITH {SQL_VENUES} SELECT 'total' AS kind, '' AS value, count(*) AS n FROM ven UNION ALL SELECT 'domain', coalesce(domain, 'General'), count(*) FROM ven GROUP BY ALL UNION ALL SELECT 'tier', tier, count(*) FROM ven GROUP BY ALL""")
def venue_statistics(spark, sf_dir):
    return L.statistics(A.venues(spark, sf_dir))


@query(f"""WITH {SQL_VENUES}, c AS (SELECT venue_id, count(*) AS papers FROM (SELECT o_custkey % 200 AS venue_id FROM orders) GROUP BY 1), v AS (SELECT name, coalesce(domain, 'General') AS domain, tier, coalesce(papers, 0) AS papers FROM ven LEFT JOIN c USING (venue_id)),
    u AS (SELECT 'domain' AS kind, domain AS value, name, papers FROM v UNION ALL SELECT 'tier', tier, name, papers FROM v) SELECT kind, value, string_agg(name || ':' || papers, '|' ORDER BY name) AS venues FROM u GROUP BY ALL""")
def venue_explorer(spark, sf_dir):
    v = A.venues(spark, sf_dir)
    counts = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 200).alias("venue_id")).agg(F.count("*").alias("papers")).join(v, "venue_id").select("name", "papers")
    return L.explorer(v, counts).select("kind", "value", F.array_join(F.transform("venues", lambda x: F.concat(x["name"], F.lit(":"), x["papers"].cast("string"))), "|").alias("venues"))


@query(f"WITH v AS ({_venue_ids_sql()}) SELECT name, string_agg(DISTINCT id, '|' ORDER BY id) AS ids, string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR DESC) AS years, min(year) AS first_year, max(year) AS last_year FROM v WHERE NOT is_workshop GROUP BY name")
def venue_discovery(spark, sf_dir):
    """Venue ids by name, the earlier half merged with the later."""
    rows = venue_id_parse(spark, sf_dir).where("not is_workshop")
    side = lambda r: r.groupBy("name").agg(F.collect_set("id").alias("ids"), F.collect_set("year").alias("years"))
    merged = upsert.merge_venues(side(rows.where("year < 1995")), side(rows.where("year >= 1995")))
    return merged.select("name", F.array_join("ids", "|").alias("ids"), F.array_join("years", ",").alias("years"), "first_year", "last_year")


@query(f"WITH v AS ({_venue_ids_sql()}) SELECT id, CASE WHEN contains(lower(id), 'iclr') THEN 'ICLR' WHEN contains(lower(id), 'kdd') THEN 'KDD' END AS known FROM v WHERE contains(id, 'Conference') AND NOT contains(id, 'Workshop') AND contains(id, '/1996/')")
def venue_exploration(spark, sf_dir):
    return feeds.conferences(venue_id_parse(spark, sf_dir).select("id"), ["ICLR", "KDD"], 1996)


@query(f"WITH {SQL_PAPERS} SELECT count(*) AS papers, (SELECT count(DISTINCT venue) FROM papers) AS venues, min(year) || '-' || max(year) AS year_range FROM papers")
def data_status(spark, sf_dir):
    p = A.papers(spark, sf_dir)
    return L.status(p, p.select(F.col("venue").alias("name")))


# ------------------------------------------------------------ series, gates and caches


@query(f"WITH {SQL_EVENTS} SELECT category, max(ts) > TIMESTAMP '2024-01-01' AS run FROM ev GROUP BY category")
def series_gates(spark, sf_dir):
    """Whether each category has records after the last run that meta names."""
    rows = A.events(spark, sf_dir).withColumnRenamed("ts", "retrieved_at")
    meta = spark.createDataFrame([("arxiv_all_week", "2024-01-01 00:00:00")], "key string, value string")
    gates = rows.groupBy("category").agg(F.max("retrieved_at").alias("retrieved_at"))
    seen = meta.where("key = 'arxiv_all_week'").select(F.try_to_timestamp("value").alias("seen"))
    return gates.join(F.broadcast(seen)).select("category", (F.col("retrieved_at") > F.col("seen")).alias("run"))


@query("SELECT max(ts) > TIMESTAMP '2024-01-01' AS run, true AS first_run FROM events")
def run_gate(spark, sf_dir):
    rows = A.events(spark, sf_dir).withColumnRenamed("ts", "retrieved_at")
    meta = spark.createDataFrame([("arxiv_click_week", "2024-01-01 00:00:00")], "key string, value string")
    again, first = Q.needs_series(rows, meta, "click", "week"), Q.needs_run(rows, meta, "last_run").withColumnRenamed("run", "first_run")
    return again.join(F.broadcast(first))


@query(f"WITH {_BUCKETED} SELECT 'timeseries_cached' AS name, (SELECT count(*) FROM (SELECT DISTINCT category, granularity, bucket FROM b)) AS value, true AS passed UNION ALL SELECT 'emerging_topics_cached', (SELECT count(DISTINCT keyword) FROM ev WHERE keyword IS NOT NULL), NULL UNION ALL SELECT 'meta_entries', 2, NULL")
def cache_presence(spark, sf_dir):
    rows = A.events(spark, sf_dir)
    meta = spark.createDataFrame([("arxiv_a", "1"), ("ArXiv_b", "2"), ("other", "3")], "key string, value string")
    return Q.cache_presence(S.paper_counts(S.bucketed(rows.select("ts", "category"))), rows.where("keyword is not null").select("keyword").distinct(), meta)


_TOP = f"""{_BUCKETED}, r AS (SELECT category, granularity, bucket, keyword, count(*) AS c, row_number() OVER (PARTITION BY category, granularity, bucket ORDER BY count(*) DESC, keyword) AS rank FROM b WHERE keyword IS NOT NULL GROUP BY category, granularity, bucket, keyword)"""


@query(f"WITH {_TOP}, k AS (SELECT DISTINCT category, granularity, bucket FROM r ORDER BY ALL LIMIT 10), x AS (SELECT keyword FROM r JOIN k USING (category, granularity, bucket) WHERE rank <= 10) SELECT count(*) AS total, count(*) FILTER (regexp_full_match(keyword, '[0-9]+') OR length(keyword) <= 2) AS invalid, count(*) FILTER (regexp_full_match(keyword, '[0-9]+') OR length(keyword) <= 2) * 100.0 / count(*) < 5 AS passed FROM x")
def keyword_validity(spark, sf_dir):
    by = ["category", "granularity", "bucket"]
    rows = S.bucketed(A.events(spark, sf_dir).select("ts", "category", "keyword"))
    return Q.keyword_validity(K.as_structs(K.ranked(S.keyword_counts(rows), by, 10), by))


@query(f"WITH {_TOP}, t AS (SELECT category, granularity, bucket, string_agg(keyword || ':' || c, '|' ORDER BY rank) AS top_keywords FROM r WHERE rank <= 5 GROUP BY ALL) SELECT category, granularity, bucket, n AS paper_count, top_keywords FROM (SELECT category, granularity, bucket, count(*) AS n FROM b GROUP BY ALL) LEFT JOIN t USING (category, granularity, bucket)")
def export_series(spark, sf_dir):
    by = ["category", "granularity", "bucket"]
    rows = S.bucketed(A.events(spark, sf_dir).select("ts", "category", "keyword"))
    return export.series_files(S.paper_counts(rows), K.listed(K.ranked(S.keyword_counts(rows), by, 5), by))


@query(f"WITH t AS ({_topics_sql(1.05)}), r AS (SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY growth_rate DESC, keyword) AS INTEGER) AS rank, keyword, growth_rate FROM t WHERE growth_rate >= 1.1) SELECT * FROM r WHERE rank <= 20")
def export_emerging(spark, sf_dir):
    return export.emerging_files(S.emerging_topics(_weekly(spark, sf_dir), min_growth=1.05), 1.1, 20)


@query(f"WITH t AS ({_topics_sql(1.05)}) SELECT keyword, growth_rate FROM t ORDER BY growth_rate DESC, keyword LIMIT 10")
def emerging_read(spark, sf_dir):
    return S.emerging_topics(_weekly(spark, sf_dir), min_growth=1.05).select("keyword", "growth_rate").orderBy(F.desc("growth_rate"), "keyword").limit(10)


@query(f"""WITH {SQL_PAPERS}, u AS (SELECT venue, 0 AS year, count(*) AS n FROM papers GROUP BY venue UNION ALL SELECT venue, year, count(*) FROM papers GROUP BY ALL) SELECT venue, nullif(year, 0)::INTEGER AS year, n AS paper_count FROM u""")
def cached_summaries(spark, sf_dir):
    """All-years rows, written with year 0, read with NULL; a yearly row that is written twice has its last value."""
    p = A.papers(spark, sf_dir)
    yearly = p.groupBy("venue", "year").agg(F.count("*").alias("paper_count"))
    stale = yearly.withColumn("paper_count", F.lit(-1).cast("bigint"))
    whole = p.groupBy("venue").agg(F.count("*").alias("paper_count")).select("venue", F.lit(0).alias("year"), "paper_count")
    return L.summaries(upsert.upsert(stale, yearly.unionByName(whole), ["venue", "year"], [F.col("paper_count")]))


@query("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS records, count(*) FILTER (event_id % 3 = 0) AS bad FROM events GROUP BY 1")
def lenient_times(spark, sf_dir):
    """Times as text, every third of them no time: those are left out of the counts by month that they are joined to."""
    rows = A.events(spark, sf_dir).select(F.col("ts"), F.when(F.col("paper_id") % 3 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("said"))
    parsed = T.lenient_timestamp(F.col("said"))
    return rows.groupBy(T.month_bucket(T.event_time(parsed, F.col("ts"))).alias("month")).agg(F.count("*").alias("records"), F.count_if(parsed.isNull()).alias("bad"))


# ------------------------------------------------------------ static files and charts


@query(f"WITH {SQL_KP}, r AS (SELECT venue, year, keyword, count(*) AS c, {_RANKS} FROM kp GROUP BY venue, year, keyword), y AS (SELECT venue, year, '\"' || year || '\":[' || string_agg('{{\"keyword\":\"' || keyword || '\",\"count\":' || c || ',\"rank\":' || rank || '}}', ',' ORDER BY rank) || ']' AS j FROM r WHERE rank <= 10 GROUP BY venue, year) SELECT venue, '{{' || string_agg(j, ',' ORDER BY year) || '}}' AS json FROM y GROUP BY venue")
def export_top_keywords(spark, sf_dir):
    return export.top_keywords_json(K.ranked(K.counts(_rows(spark, sf_dir), "venue", "year"), ["venue", "year"], 10))


@query(f"WITH {_GRID}, c AS (SELECT venue, keyword, year, coalesce(count, 0)::BIGINT AS count, coalesce(rank, 0) AS rank FROM g LEFT JOIN y USING (venue, keyword, year)), k AS (SELECT venue, keyword, '\"' || keyword || '\":[' || string_agg('{{\"year\":' || year || ',\"count\":' || count || ',\"rank\":' || rank || '}}', ',' ORDER BY year) || ']' AS j FROM c GROUP BY venue, keyword) SELECT venue, '{{' || string_agg(j, ',' ORDER BY keyword) || '}}' AS json FROM k GROUP BY venue")
def export_trends(spark, sf_dir):
    return export.trends_json(K.trend_grid(_rows(spark, sf_dir), ["venue"]))


@query(f"""WITH {SQL_KP}, r AS (SELECT venue, keyword, count(*) AS c, row_number() OVER (PARTITION BY venue ORDER BY count(*) DESC, keyword) AS rank FROM kp GROUP BY venue, keyword), n AS (SELECT venue, count(*) AS n FROM papers GROUP BY venue), t AS (SELECT venue, string_agg(keyword || ':' || c, '|' ORDER BY rank) AS top FROM r WHERE rank <= 10 GROUP BY venue),
    reg AS (SELECT unnest(['BUILDING', 'MACHINERY', 'NOWHERE']) AS name) SELECT name, CASE name WHEN 'BUILDING' THEN 'CV' ELSE 'ML' END AS domain, 'A' AS tier, coalesce(n, 0) AS paper_count, coalesce(top, '') AS top_keywords FROM reg LEFT JOIN n ON n.venue = name LEFT JOIN t ON t.venue = name""")
def export_venues_index(spark, sf_dir):
    reg = spark.createDataFrame([("BUILDING", "B", "CV", [1995]), ("MACHINERY", "M", None, [1996]), ("NOWHERE", "N", None, [])], "name string, full_name string, domain string, years_available array<int>")
    top = K.as_structs(K.ranked(K.counts(_rows(spark, sf_dir), "venue"), ["venue"], 20), ["venue"])
    summary = A.papers(spark, sf_dir).groupBy("venue").agg(F.count("*").alias("paper_count")).join(top, "venue").withColumnRenamed("venue", "name")
    said = F.array_join(F.transform("top_keywords", lambda x: F.concat(x["keyword"], F.lit(":"), x["count"].cast("string"))), "|")
    return export.venues_index(reg, summary).select("name", "domain", "tier", "paper_count", F.coalesce(said, F.lit("")).alias("top_keywords"))


@query(f"WITH {SQL_PAPERS}, v AS (SELECT count(DISTINCT venue) AS v FROM papers) SELECT v * 3 AS files FROM v")
def export_manifest(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    files = export.site(K.ranked(K.counts(rows, "venue", "year"), ["venue", "year"], 10), K.trend_grid(rows, ["venue"]), K.ranked(K.counts(rows, "venue"), ["venue"], 10))
    return export.manifest(files, F.lit("2024-01-01")).where("bytes > 0").select("files")


@query(f"WITH {SQL_KP}, r AS (SELECT venue, year, keyword, count(*) AS c, {_RANKS} FROM kp GROUP BY venue, year, keyword), t AS (SELECT venue, keyword, sum(c)::BIGINT AS count FROM r WHERE rank <= 20 GROUP BY ALL), n AS (SELECT venue, CAST(row_number() OVER (PARTITION BY venue ORDER BY count DESC, keyword) AS INTEGER) AS rank, keyword, count FROM t) SELECT * FROM n WHERE rank <= 100")
def chart_venue_clouds(spark, sf_dir):
    return export.venue_clouds(K.ranked(K.counts(_rows(spark, sf_dir), "venue", "year"), ["venue", "year"], 20))


@query(f"WITH {SQL_KP}, t AS (SELECT keyword, count(*) AS n FROM kp GROUP BY keyword ORDER BY n DESC, keyword LIMIT 8), y AS (SELECT DISTINCT year FROM kp), c AS (SELECT keyword, year, count(*) AS c FROM kp GROUP BY ALL) SELECT keyword, year, coalesce(c, 0)::BIGINT AS count FROM t CROSS JOIN y LEFT JOIN c USING (keyword, year)")
def chart_trend_lines(spark, sf_dir):
    """The eight most frequent keywords on every year."""
    per = K.yearly(_rows(spark, sf_dir))
    chosen = per.groupBy("keyword").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "keyword").limit(8).select("keyword")
    grid = chosen.join(F.broadcast(per.select("year").distinct()))
    return grid.join(per, ["keyword", "year"], "left").select("keyword", "year", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


@query(f"""WITH {SQL_KP}, v AS (SELECT venue, year, count(*) AS papers FROM papers GROUP BY ALL), r AS (SELECT venue, year, keyword, count(*) AS c, {_RANKS} FROM kp GROUP BY venue, year, keyword), w AS (SELECT keyword, count(*) AS c FROM kp GROUP BY keyword ORDER BY c DESC, keyword LIMIT 20)
    SELECT 'venue' AS part, venue || ' ' || v.year AS name, papers AS n, (SELECT string_agg(keyword, '|' ORDER BY rank) FROM r WHERE r.venue = v.venue AND r.year = v.year AND rank <= 20) AS keywords FROM v UNION ALL SELECT 'overall', keyword, c, NULL FROM w UNION ALL SELECT 'trend', keyword || ' ' || year, count(*), NULL FROM kp WHERE keyword IN (SELECT keyword FROM w) GROUP BY keyword, year UNION ALL SELECT 'emerging', keyword, count, NULL FROM ({_emerging_sql(1.05, "SELECT keyword, count FROM top")})""")
def analysis_result(spark, sf_dir):
    """The full result from one cube: venues by year with their first keywords, the most frequent keywords, these keywords' trends, and emerging keywords."""
    papers = A.papers(spark, sf_dir)
    cubed = K.cube(_rows(spark, sf_dir))
    by_year = K.of_level(cubed, K.BY_YEAR).select("year", "keyword", "count")
    ranks = K.ranked(K.of_level(cubed, K.BY_VENUE_YEAR), ["venue", "year"], 20)
    words = ranks.groupBy("venue", "year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]), "|").alias("keywords"))
    venues = papers.groupBy("venue", "year").agg(F.count("*").alias("n")).join(words, ["venue", "year"], "left")
    top = K.of_level(cubed, K.OVERALL).orderBy(F.desc("count"), "keyword").limit(20).select("keyword", "count")
    trends = by_year.join(top.select("keyword"), "keyword", "left_semi")
    rising = K.emerging_of(by_year, papers, min_growth=1.05)
    none = F.lit(None).cast("string").alias("keywords")
    part = lambda rows, name, label: rows.select(F.lit(name).alias("part"), label.alias("name"), F.col("count").alias("n"), none)
    out = venues.select(F.lit("venue").alias("part"), F.concat_ws(" ", "venue", F.col("year").cast("string")).alias("name"), "n", "keywords")
    for more in (part(top, "overall", F.col("keyword")), part(trends, "trend", F.concat_ws(" ", "keyword", F.col("year").cast("string"))), part(rising, "emerging", F.col("keyword"))):
        out = out.unionByName(more)
    return out


# ------------------------------------------------------------ functions and set operations


@query(f"WITH {SQL_PK}, a AS (SELECT DISTINCT keyword FROM pk WHERE method = 'A'), r AS (SELECT DISTINCT keyword FROM pk WHERE method = 'R') SELECT 'both' AS part, count(*) AS keywords FROM (FROM a INTERSECT FROM r) UNION ALL SELECT 'any', count(*) FROM (FROM a UNION FROM r) UNION ALL SELECT 'only', count(*) FROM (FROM a EXCEPT FROM r)")
def keyword_sets(spark, sf_dir):
    pk = A.paper_keywords(spark, sf_dir)
    a, r = pk.where("method = 'A'").select("keyword"), pk.where("method = 'R'").select("keyword")
    n = lambda df, part: df.agg(F.count("*").alias("keywords")).select(F.lit(part).alias("part"), "keywords")
    return n(a.intersect(r), "both").unionByName(n(a.union(r).distinct(), "any")).unionByName(n(a.subtract(r), "only"))


@query("SELECT p_name AS keyword, CASE WHEN length(lower(trim(p_name))) BETWEEN 2 AND 100 THEN lower(trim(p_name)) END AS legacy, regexp_replace(p_name || 'ss', 's+$', '') AS singular, 'https://site.org/abs/' || p_partkey AS url FROM part")
def keyword_forms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_name").alias("keyword"), X.legacy_keyword(F.col("p_name")).alias("legacy"), X.singular(F.concat("p_name", F.lit("ss"))).alias("singular"), X.paper_url(F.lit("https://site.org/abs/"), F.col("p_partkey")).alias("url"))


@query(f"WITH {SQL_PK}, m AS (SELECT paper_id, max(score) AS m FROM pk GROUP BY paper_id) SELECT paper_id, keyword, method, round(1 - score / (m + 1e-10), 6)::DOUBLE AS relevance FROM pk JOIN m USING (paper_id)")
def inverted_scores(spark, sf_dir):
    from quernstone.operators.extract import invert_scores

    pk = A.paper_keywords(spark, sf_dir).withColumn("score", F.col("score").cast("double"))
    per = pk.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("keyword", "method", "score"))).alias("items"))
    scores = per.withColumn("s", F.transform("items", lambda x: x["score"])).withColumn("inv", invert_scores(F.col("s")))
    each = scores.select("paper_id", F.explode(F.arrays_zip("items", "inv")).alias("x"))
    return each.select("paper_id", "x.items.keyword", "x.items.method", F.round("x.inv", 6).alias("relevance"))


@query(f"WITH {SQL_PK} SELECT paper_id, keyword, score FROM pk WHERE method = 'A' ORDER BY md5(paper_id || keyword), paper_id, keyword LIMIT 25")
def random_sample(spark, sf_dir):
    """A sample that is random and the same each time: the rows of the smallest hashes."""
    pk = A.paper_keywords(spark, sf_dir).where("method = 'A'").select("paper_id", "keyword", "score")
    return pk.orderBy(F.md5(F.concat(F.col("paper_id").cast("string"), "keyword")), "paper_id", "keyword").limit(25)


@query(f"WITH {SQL_KP} SELECT venue, count(*) AS rows, count(DISTINCT keyword) AS keywords FROM kp WHERE year > 1994 GROUP BY venue HAVING count(*) > 10")
def user_sql(spark, sf_dir):
    """A user's SQL over the engine's tables."""
    udfs.register(spark)
    _rows(spark, sf_dir).createOrReplaceTempView("quernstone_rows")
    return spark.sql("SELECT venue, count(*) AS rows, count(DISTINCT keyword) AS keywords FROM quernstone_rows WHERE year > 1994 GROUP BY venue HAVING count(*) > 10")


@query(f"WITH {SQL_PK} SELECT paper_id, count(*) AS keywords FROM (SELECT DISTINCT paper_id, keyword FROM pk WHERE method IN ('A', 'R')) GROUP BY paper_id")
def united_keywords(spark, sf_dir):
    """What either of two methods found, each keyword of a paper once."""
    from quernstone.operators.extract import united

    pk = A.paper_keywords(spark, sf_dir)
    return united(pk.where("method = 'A'"), pk.where("method = 'R'")).groupBy("paper_id").agg(F.count("*").alias("keywords"))


@query(f"WITH {SQL_VENUES}, p AS (SELECT o_orderkey AS paper_id, o_custkey % 200 AS venue_id FROM orders) SELECT 'known' AS asked, count(*) AS papers FROM p WHERE venue_id = (SELECT venue_id FROM ven WHERE name = 'Supplier#000000003') UNION ALL SELECT 'unknown', 0 UNION ALL SELECT 'unknown, lenient', count(*) FROM p")
def venue_resolution(spark, sf_dir):
    """An unknown venue gives no papers, or with lenient=True all."""
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), (F.col("o_custkey") % 200).alias("venue_id"))
    v = A.venues(spark, sf_dir).withColumnRenamed("name", "canonical_name")
    one = lambda asked, name, lenient=False: L.count_of(P.resolve_venue(p, v, name, lenient), "papers").select(F.lit(asked).alias("asked"), "papers")
    return one("known", "Supplier#000000003").unionByName(one("unknown", "nowhere")).unionByName(one("unknown, lenient", "nowhere", True))


@query("""WITH c AS (SELECT c AS category, count(*) AS papers FROM events, (SELECT unnest(['click', 'view', 'zz']) AS c) WHERE contains(lower(event_type), c) GROUP BY c), n AS (SELECT count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS a, strftime(max(ts), '%Y-%m-%d') AS b FROM events)
    SELECT '{"total":' || n || ',"first":"' || a || '","last":"' || b || '","categories":{' || coalesce((SELECT string_agg('"' || category || '":' || papers, ',' ORDER BY category) FROM c), '') || '}}' AS json FROM n""")
def export_stats(spark, sf_dir):
    rows = A.events(spark, sf_dir).withColumnRenamed("category", "categories")
    per = S.category_counts(rows, ["click", "view", "zz"]).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "papers")))).alias("categories"))  # a row a category
    one = rows.agg(F.count("*").alias("total"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last"))
    return one.join(F.broadcast(per)).select(F.to_json(F.struct("total", "first", "last", "categories")).alias("json"))
