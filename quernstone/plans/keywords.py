"""Queries over papers and their keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.operators import export, structuring, upsert
from quernstone.operators import filters as P
from quernstone.operators import keywords as K
from quernstone.plans import adapters as A
from quernstone.plans.adapters import SQL_KP, SQL_PAPERS, SQL_PK, SQL_SOURCES
from quernstone.plans.registry import query


def _rows(spark, sf_dir, **kw):
    return K.of_papers(A.paper_keywords(spark, sf_dir), A.papers(spark, sf_dir), **kw)


@query(f"WITH {SQL_PK} SELECT keyword, count(*) AS count FROM pk JOIN (SELECT o_orderkey AS paper_id FROM orders) USING (paper_id) GROUP BY keyword ORDER BY count DESC, keyword LIMIT 50")
def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.top(_rows(spark, sf_dir), 50)


@query(f"WITH {SQL_KP} SELECT keyword, count(*) AS count FROM kp WHERE venue = 'BUILDING' AND year = 1996 AND method = 'R' GROUP BY keyword ORDER BY count DESC, keyword LIMIT 20")
def top_keywords_filtered(spark, sf_dir):
    return K.top(_rows(spark, sf_dir, venue="BUILDING", year=1996, method="R"), 20)


@query(f"WITH {SQL_KP} SELECT keyword AS name, count(*) AS value FROM kp GROUP BY keyword ORDER BY value DESC, name LIMIT 100")
def word_cloud(spark, sf_dir):
    return K.top(_rows(spark, sf_dir), 100).select(F.col("keyword").alias("name"), F.col("count").alias("value"))


@query(f"WITH {SQL_KP} SELECT venue, count(DISTINCT keyword) AS keywords FROM kp GROUP BY venue")
def distinct_keyword_count(spark, sf_dir):
    return _rows(spark, sf_dir).groupBy("venue").agg(F.count_distinct("keyword").alias("keywords"))


@query(f"WITH {SQL_KP} SELECT keyword, year, count(*) AS count FROM kp WHERE keyword = (SELECT min(keyword) FROM kp) GROUP BY ALL")
def keyword_trend(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    first = A.paper_keywords(spark, sf_dir).agg(F.min("keyword").alias("keyword"))
    return K.yearly(rows.join(F.broadcast(first), "keyword", "left_semi"))


@query(f"WITH {SQL_KP}, t AS (SELECT keyword FROM kp GROUP BY keyword ORDER BY count(*) DESC, keyword LIMIT 5) SELECT keyword, year, count(*) AS count FROM kp JOIN t USING (keyword) GROUP BY ALL")
def keyword_trends_batch(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return K.yearly(rows.join(F.broadcast(K.top(rows, 5).select("keyword")), "keyword", "left_semi"))


@query(f"""WITH {SQL_KP}, y AS (SELECT keyword, year, count(*) AS c FROM kp GROUP BY ALL),
    a AS (SELECT keyword, count(*) AS n_years, arg_min(c, year) AS f, arg_max(c, year) AS l FROM y GROUP BY keyword)
    SELECT keyword, n_years, round(CASE WHEN n_years < 2 OR f = 0 THEN 0.0::DOUBLE ELSE (l - f) / f::DOUBLE END, 6) AS growth_rate FROM a""")
def growth_rate(spark, sf_dir):
    return K.growth(K.yearly(_rows(spark, sf_dir))).withColumn("growth_rate", F.round("growth_rate", 6))


@query(f"""WITH {SQL_KP} SELECT (SELECT count(*) FROM papers) AS papers, (SELECT count(DISTINCT keyword) FROM pk) AS keywords, count(DISTINCT venue) AS venues,
    count(DISTINCT year) AS years, min(year) || '-' || max(year) AS year_range FROM papers""")
def overview(spark, sf_dir):
    papers = A.papers(spark, sf_dir).agg(F.count("*").alias("papers"), F.count_distinct("venue").alias("venues"), F.count_distinct("year").alias("years"), F.min("year").alias("a"), F.max("year").alias("b"))
    n = A.paper_keywords(spark, sf_dir).agg(F.count_distinct("keyword").alias("keywords"))
    return papers.join(F.broadcast(n)).select("papers", "keywords", "venues", "years", X.year_range(F.col("a"), F.col("b")).alias("year_range"))


@query(f"WITH {SQL_PAPERS} SELECT venue, count(*) AS papers, string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR DESC) AS years FROM papers GROUP BY venue")
def venue_list(spark, sf_dir):
    years = F.array_join(F.sort_array(F.collect_set(F.col("year").cast("string")), asc=False), ",")
    return A.papers(spark, sf_dir).groupBy("venue").agg(F.count("*").alias("papers"), years.alias("years"))


_RANKS = "row_number() OVER (PARTITION BY venue, year ORDER BY count(*) DESC, keyword) AS rank"


@query(f"""WITH {SQL_KP}, r AS (SELECT venue, year, keyword, count(*) AS c, {_RANKS} FROM kp GROUP BY venue, year, keyword),
    t AS (SELECT venue, year, string_agg(keyword || ':' || c, '|' ORDER BY rank) AS top_keywords FROM r WHERE rank <= 10 GROUP BY ALL)
    SELECT venue, year, n AS papers, top_keywords FROM (SELECT venue, year, count(*) AS n FROM papers GROUP BY ALL) LEFT JOIN t USING (venue, year)""")
def venue_detail(spark, sf_dir):
    papers = A.papers(spark, sf_dir)
    top = K.listed(K.ranked(K.counts(_rows(spark, sf_dir), "venue", "year"), ["venue", "year"], 10), ["venue", "year"])
    return papers.groupBy("venue", "year").agg(F.count("*").alias("papers")).join(top, ["venue", "year"], "left")


@query(f"""WITH {SQL_KP}, r AS (SELECT venue, keyword, count(*) AS count, CAST(row_number() OVER (PARTITION BY venue ORDER BY count(*) DESC, keyword) AS INTEGER) AS rank
    FROM kp WHERE year = (SELECT max(year) FROM papers) GROUP BY venue, keyword) SELECT * FROM r WHERE rank <= 10""")
def venue_comparison(spark, sf_dir):
    latest = A.papers(spark, sf_dir).agg(F.max("year").alias("year"))
    return K.ranked(K.counts(_rows(spark, sf_dir).join(F.broadcast(latest), "year", "left_semi"), "venue"), ["venue"], 10)


@query(f"WITH {SQL_KP}, r AS (SELECT venue, year, keyword, count(*) AS count, CAST({_RANKS.replace(' AS rank', '')} AS INTEGER) AS rank FROM kp GROUP BY venue, year, keyword) SELECT * FROM r WHERE rank <= 50")
def venue_rank_by_year(spark, sf_dir):
    return K.ranked(K.counts(_rows(spark, sf_dir), "venue", "year"), ["venue", "year"], 50)


_GRID = f"""{SQL_KP}, r AS (SELECT venue, year, keyword, count(*) AS count, {_RANKS} FROM kp GROUP BY venue, year, keyword),
    y AS (SELECT * FROM r WHERE rank <= 100), s AS (SELECT venue, keyword, row_number() OVER (PARTITION BY venue ORDER BY sum(count) DESC, keyword) AS n FROM y GROUP BY venue, keyword),
    g AS (SELECT venue, keyword, year FROM (SELECT venue, keyword FROM s WHERE n <= 20) JOIN (SELECT DISTINCT venue, year FROM kp) USING (venue))"""


@query(f"WITH {_GRID} SELECT venue, keyword, year, coalesce(count, 0)::BIGINT AS count, CAST(coalesce(rank, 0) AS INTEGER) AS rank FROM g LEFT JOIN y USING (venue, keyword, year)")
def keyword_trend_grid(spark, sf_dir):
    return K.trend_grid(_rows(spark, sf_dir), ["venue"])


def _emerging_sql(growth: float, head: str) -> str:
    return f"""WITH {SQL_KP}, sizes AS (SELECT year, count(*) AS n, row_number() OVER (ORDER BY year DESC) AS nth FROM papers GROUP BY year),
    now AS (SELECT keyword FROM kp WHERE year = (SELECT year FROM sizes WHERE nth = 1) GROUP BY keyword HAVING count(*) >= 5 ORDER BY count(*) DESC, keyword LIMIT 300),
    c AS (SELECT keyword, year, count(*) AS c FROM kp GROUP BY ALL),
    f AS (SELECT keyword, nth, coalesce(c, 0) AS c, coalesce(c, 0) / n::DOUBLE * 1000 AS freq FROM now CROSS JOIN (SELECT * FROM sizes WHERE nth <= 3) LEFT JOIN c USING (keyword, year)),
    a AS (SELECT keyword, sum(c) FILTER (nth = 1)::BIGINT AS count, sum(freq) FILTER (nth = 1) AS now, avg(freq) FILTER (nth > 1) AS mean FROM f GROUP BY keyword),
    e AS (SELECT keyword, count, coalesce(mean, 0) < 0.1 AS is_new, CASE WHEN coalesce(mean, 0) < 0.1 THEN 'inf'::DOUBLE ELSE now / mean END AS growth_rate FROM a),
    top AS (SELECT * FROM e WHERE growth_rate >= {growth} ORDER BY is_new DESC, growth_rate DESC, count DESC, keyword LIMIT 20) {head}"""


@query(_emerging_sql(1.05, "SELECT keyword, count, is_new, round(growth_rate, 6) AS growth_rate FROM top"))
def emerging_keywords(spark, sf_dir):
    found = K.emerging(_rows(spark, sf_dir), A.papers(spark, sf_dir), min_growth=1.05)
    return found.withColumn("growth_rate", F.round("growth_rate", 6))


@query(_emerging_sql(1.5, "SELECT keyword, count, is_new, round(growth_rate, 6) AS growth_rate FROM top"))
def emerging_keywords_default(spark, sf_dir):
    return K.emerging(_rows(spark, sf_dir), A.papers(spark, sf_dir)).withColumn("growth_rate", F.round("growth_rate", 6))


@query(_emerging_sql(1.05, """SELECT keyword, round(CASE WHEN is_new THEN NULL ELSE growth_rate END, 6) AS growth_rate,
    (SELECT string_agg(year || '=' || c.c, ',' ORDER BY year) FROM c WHERE c.keyword = top.keyword AND year IN (SELECT year FROM sizes WHERE nth <= 4)) AS trend FROM top"""))
def emerging_detailed(spark, sf_dir):
    return K.emerging_detailed(_rows(spark, sf_dir), A.papers(spark, sf_dir), min_growth=1.05).withColumn("growth_rate", F.round("growth_rate", 6))


@query(f"""WITH {SQL_KP}, v AS (SELECT venue, year, count(*) AS papers FROM papers GROUP BY ROLLUP (venue, year)), k AS (SELECT venue, year, count(*) AS keywords FROM kp GROUP BY ROLLUP (venue, year))
    SELECT coalesce(v.venue, '') AS venue, coalesce(v.year, 0) AS year, papers, keywords FROM v LEFT JOIN k ON v.venue IS NOT DISTINCT FROM k.venue AND v.year IS NOT DISTINCT FROM k.year""")
def venue_rollup(spark, sf_dir):
    """All-years rows have year 0, the all-venues row venue ''."""
    key = [F.coalesce("venue", F.lit("")).alias("venue"), F.coalesce("year", F.lit(0)).alias("year")]
    papers = A.papers(spark, sf_dir).rollup("venue", "year").agg(F.count("*").alias("papers")).select(*key, "papers")
    keywords = _rows(spark, sf_dir).rollup("venue", "year").agg(F.count("*").alias("keywords")).select(*key, "keywords")
    return papers.join(keywords, ["venue", "year"], "left")


@query(f"""WITH {SQL_KP}, r AS (SELECT venue, keyword, count(*) AS c, row_number() OVER (PARTITION BY venue ORDER BY count(*) DESC, keyword) AS rank FROM kp GROUP BY venue, keyword)
    SELECT venue, CAST(0 AS INTEGER) AS year, n AS paper_count, string_agg(keyword || ':' || c, '|' ORDER BY rank) AS top_keywords
    FROM (SELECT venue, count(*) AS n FROM papers GROUP BY venue) JOIN r USING (venue) WHERE rank <= 20 GROUP BY ALL""")
def venue_summary(spark, sf_dir):
    top = K.listed(K.ranked(K.counts(_rows(spark, sf_dir), "venue"), ["venue"], 20), ["venue"])
    papers = A.papers(spark, sf_dir).groupBy("venue").agg(F.count("*").alias("paper_count"))
    return papers.join(top, "venue").select("venue", F.lit(0).alias("year"), "paper_count", "top_keywords")


@query(f"""WITH {SQL_KP}, r AS (SELECT venue, year, keyword, count(*) AS c, {_RANKS} FROM kp GROUP BY venue, year, keyword)
    SELECT venue, sum(c)::BIGINT AS paper_count, string_agg(DISTINCT keyword, '|' ORDER BY keyword) AS keywords FROM r WHERE rank <= 10 GROUP BY venue""")
def client_venue_overview(spark, sf_dir):
    """As the static client has it: a venue's paper count is the sum of its yearly lists' keyword counts."""
    ranks = K.ranked(K.counts(_rows(spark, sf_dir), "venue", "year"), ["venue", "year"], 10)
    return ranks.groupBy("venue").agg(F.sum("count").alias("paper_count"), F.array_join(F.array_sort(F.collect_set("keyword")), "|").alias("keywords"))


@query(f"WITH {SQL_KP}, c AS (SELECT keyword, count(*) AS count FROM kp GROUP BY keyword) SELECT * FROM c WHERE contains(lower(keyword), 'bl') ORDER BY count DESC, keyword LIMIT 10")
def autocomplete(spark, sf_dir):
    return P.autocomplete(K.counts(_rows(spark, sf_dir)), "bl")


@query(f"WITH {SQL_PAPERS}, {SQL_PK} SELECT paper_id, year, venue FROM papers WHERE NOT EXISTS (SELECT 1 FROM pk WHERE pk.paper_id = papers.paper_id AND method = 'A')")
def papers_without_keywords(spark, sf_dir):
    return structuring.without_keywords(A.papers(spark, sf_dir), A.paper_keywords(spark, sf_dir), "A").select("paper_id", "year", "venue")


@query(f"WITH {SQL_SOURCES} SELECT paper_id, count(DISTINCT source) AS sources, count(*) AS links FROM ps GROUP BY paper_id HAVING count(DISTINCT source) > 1")
def multi_source_papers(spark, sf_dir):
    per = A.paper_sources(spark, sf_dir).groupBy("paper_id").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("links"))
    return per.where("sources > 1")


@query(f"WITH {SQL_PAPERS} SELECT venue, count(*) AS papers, round(count(*) * 100.0 / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM papers GROUP BY venue")
def venue_distribution(spark, sf_dir):
    counted = A.papers(spark, sf_dir).groupBy("venue").agg(F.count("*").alias("papers"))
    return counted.select("venue", "papers", K.share("papers"))


@query(f"""WITH {SQL_PK}, n AS (SELECT paper_id, count(*) AS n FROM pk GROUP BY paper_id),
    b AS (SELECT CASE WHEN n <= 5 THEN '0-5' WHEN n <= 10 THEN '6-10' WHEN n <= 15 THEN '11-15' ELSE '16+' END AS band, count(*) AS papers FROM n GROUP BY ALL)
    SELECT band, papers, round(papers * 100.0 / sum(papers) OVER (), 1)::DOUBLE AS pct FROM b""")
def keyword_histogram(spark, sf_dir):
    return K.histogram(A.paper_keywords(spark, sf_dir).groupBy("paper_id").agg(F.count("*").alias("n")))


@query(f"WITH {SQL_PK} SELECT method, count(*) AS n, min(score) AS least, max(score) AS most, round(avg(score), 6) AS mean, count(*) FILTER (score < 0.01 OR score > 0.99) AS extreme FROM pk GROUP BY method")
def score_stats(spark, sf_dir):
    s = F.col("score")
    return A.paper_keywords(spark, sf_dir).groupBy("method").agg(F.count("*").alias("n"), F.min(s).alias("least"), F.max(s).alias("most"), F.round(F.avg(s), 6).alias("mean"), F.count_if((s < 0.01) | (s > 0.99)).alias("extreme"))


@query(f"""WITH {SQL_PAPERS}, h AS (SELECT venue, list(DISTINCT year) AS ys FROM papers WHERE year <= 1998 GROUP BY venue), l AS (SELECT venue, list(DISTINCT year) AS ys FROM papers WHERE year >= 1998 GROUP BY venue),
    m AS (SELECT venue AS name, list_distinct(list_concat(coalesce(h.ys, []), coalesce(l.ys, []))) AS ys FROM h FULL JOIN l USING (venue))
    SELECT name, array_to_string(list_reverse_sort(ys), ',') AS years, list_min(ys) AS first_year, list_max(ys) AS last_year FROM m""")
def venue_merge(spark, sf_dir):
    papers = A.papers(spark, sf_dir)
    side = lambda rows: rows.groupBy(F.col("venue").alias("name")).agg(F.collect_set("venue").alias("ids"), F.collect_set("year").alias("years"))
    merged = upsert.merge_venues(side(papers.where("year <= 1998")), side(papers.where("year >= 1998")))
    return merged.select("name", F.array_join("years", ",").alias("years"), "first_year", "last_year")


@query(f"""WITH {SQL_PAPERS}, {SQL_PK}, f AS (SELECT min(paper_id) AS paper_id FROM pk WHERE method = 'R'), k AS (SELECT DISTINCT paper_id, keyword FROM pk JOIN f USING (paper_id))
    SELECT paper_id, year, venue, (SELECT string_agg(keyword, '|' ORDER BY keyword) FROM (SELECT keyword FROM k ORDER BY keyword LIMIT 10)) AS keywords FROM papers JOIN f USING (paper_id)""")
def paper_detail(spark, sf_dir):
    pk = A.paper_keywords(spark, sf_dir)
    one = F.broadcast(pk.where("method = 'R'").agg(F.min("paper_id").alias("paper_id")))
    words = pk.join(one, "paper_id", "left_semi").groupBy("paper_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("keyword")), 1, 10), "|").alias("keywords"))
    return A.papers(spark, sf_dir).join(one, "paper_id", "left_semi").join(words, "paper_id", "left").select("paper_id", "year", "venue", "keywords")


@query(f"""WITH {SQL_KP}, a AS (SELECT quality_flag, count(*) AS papers, min(published_at) AS first_at, max(published_at) AS last_at FROM papers GROUP BY quality_flag)
    SELECT quality_flag, papers, strftime(first_at, '%Y-%m-%d') AS first_day, strftime(last_at, '%Y-%m-%d') AS last_day FROM a""")
def quality_flags(spark, sf_dir):
    agg = A.papers(spark, sf_dir).groupBy("quality_flag").agg(F.count("*").alias("papers"), F.min("published_at").alias("a"), F.max("published_at").alias("b"))
    return agg.select("quality_flag", "papers", F.date_format("a", "yyyy-MM-dd").alias("first_day"), F.date_format("b", "yyyy-MM-dd").alias("last_day"))


@query(f"""WITH {SQL_PK} SELECT m.method AS gone, p.method AS method, count(*) AS rows_left FROM (SELECT DISTINCT method FROM pk) m JOIN pk p ON p.method <> m.method GROUP BY ALL""")
def delete_by_method(spark, sf_dir):
    """What is left of the table when the rows of one method are deleted, for each of the methods."""
    pk = A.paper_keywords(spark, sf_dir)
    out = None
    for method in ("A", "N", "R"):
        left = upsert.without_method(pk, method).groupBy(F.lit(method).alias("gone"), "method").agg(F.count("*").alias("rows_left"))
        out = left if out is None else out.unionByName(left)
    return out


@query(f"""WITH {SQL_KP}, r AS (SELECT venue, keyword, row_number() OVER (PARTITION BY venue ORDER BY count(*) DESC, keyword) AS rank FROM kp GROUP BY venue, keyword)
    SELECT venue, '[' || string_agg('"' || keyword || '"', ',' ORDER BY rank) || ']' AS json FROM r WHERE rank <= 10 GROUP BY venue""")
def export_keywords_index(spark, sf_dir):
    return export.keywords_index(K.ranked(K.counts(_rows(spark, sf_dir), "venue"), ["venue"], 10))


@query(f"""WITH {SQL_KP}, s AS (SELECT venue, keyword, count(*) AS c FROM kp GROUP BY ALL), t AS (SELECT venue, keyword, c, sum(c) OVER (PARTITION BY keyword) AS total FROM s)
    SELECT venue, keyword, c AS count, round(c * 100.0 / total, 2)::DOUBLE AS pct FROM t""")
def keyword_venue_share(spark, sf_dir):
    counted = K.counts(_rows(spark, sf_dir), "venue")
    pct = F.round(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy("keyword")), 2).cast("double")
    return counted.select("venue", "keyword", "count", pct.alias("pct"))


@query(f"WITH {SQL_KP} SELECT venue, true AS close FROM kp GROUP BY venue")
def approximate_keyword_count(spark, sf_dir):
    """Whether the approximate count of each venue's keywords is within three standard errors (15 percent) of the true one."""
    agg = _rows(spark, sf_dir).groupBy("venue").agg(F.approx_count_distinct("keyword", 0.05).alias("near"), F.count_distinct("keyword").alias("n"))
    return agg.select("venue", (F.abs(F.col("near") - F.col("n")) <= 0.15 * F.col("n")).alias("close"))
