"""Queries over what serving and runs read: defaults, totals, details, logs, gates, chart sets and bucketed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quernstone.operators import keywords as K
from quernstone.operators import layout, reads
from quernstone.operators.filters import in_category
from quernstone.operators.upsert import Table, evolve
from quernstone.plans import adapters as A
from quernstone.plans.adapters import SQL_EVENTS, SQL_KP, SQL_PAPERS, SQL_PK, SQL_SUB
from quernstone.plans.keywords import _RANKS, _rows
from quernstone.plans.registry import query
from quernstone.schemas import schema
from quernstone.scratch import new_path
from quernstone.sources.tables import registry, static_json, table


@query(f"WITH {SQL_SUB} SELECT raw_id, md5(CASE WHEN raw_id % 3 = 0 THEN '' ELSE title END) AS title_md5, 0 AS authors, venue_raw FROM sub")
def decoded_records(spark, sf_dir):
    """Raw records, every third without a title, as they are read: NULL titles are empty and NULL author lists have no one, a NULL venue stays NULL."""
    rows = A.submissions(spark, sf_dir).withColumns({"title": F.when(F.col("raw_id") % 3 != 0, F.col("title")), "authors": F.lit(None).cast("array<string>")})
    return reads.decoded(rows, "raw_papers").select("raw_id", F.md5("title").alias("title_md5"), F.size("authors").alias("authors"), "venue_raw")


@query(f"WITH {SQL_EVENTS}, c AS (SELECT * FROM ev WHERE contains(lower(category), 'c')) SELECT paper_id, category, (SELECT count(*) FROM c) AS total FROM c ORDER BY ts DESC, paper_id LIMIT 25 OFFSET 75")
def paged_listing_total(spark, sf_dir):
    """The fourth page of a category's listing, latest first, with the number of all its rows."""
    rows = A.events(spark, sf_dir)
    return reads.page_with_total(rows.where(in_category(F.col("category"), "C")), [F.desc("ts"), F.asc("paper_id")], 75, 25).select("paper_id", "category", "total")


_KEY = "lower(trim(regexp_replace(title, '\\s+', ' ', 'g')))"


@query(f"""WITH {SQL_SUB}, {SQL_PK}, a AS (SELECT raw_id AS id FROM sub UNION ALL SELECT raw_id + 1000000000 FROM sub), t AS (SELECT {_KEY} AS k, year, min(raw_id) AS paper FROM sub GROUP BY ALL), f AS (SELECT k, min(paper) AS paper FROM t GROUP BY k),
    m AS (SELECT id, title, CASE WHEN sub.year IS NULL THEN f.paper ELSE t.paper END AS paper_id FROM a LEFT JOIN sub ON raw_id = id LEFT JOIN t ON t.k = {_KEY} AND t.year = sub.year LEFT JOIN f ON f.k = {_KEY}),
    w AS (SELECT paper_id, list_sort(list(DISTINCT keyword))[1:10] AS words FROM pk GROUP BY paper_id)
    SELECT id::VARCHAR AS source_paper_id, CASE WHEN title IS NULL THEN 404 ELSE 200 END AS status, m.paper_id, coalesce(array_to_string(words, '|'), '') AS keywords FROM m LEFT JOIN w USING (paper_id)""")
def paper_details(spark, sf_dir):
    """Every record's detail, and as many ids that no record has: the paper of its title and that paper's first ten keywords, or that it isn't found."""
    rows = A.submissions(spark, sf_dir).select(F.col("raw_id").cast("string").alias("source_paper_id"), "raw_id", "title", "year")
    asked = rows.select("source_paper_id").unionByName(rows.select((F.col("raw_id") + 10**9).cast("string").alias("source_paper_id")))
    papers = rows.select(F.col("raw_id").alias("paper_id"), F.col("title").alias("canonical_title"), "year")
    found = reads.details(asked, rows, papers, A.paper_keywords(spark, sf_dir))
    return found.select("source_paper_id", "status", "paper_id", F.array_join("keywords", "|").alias("keywords"))


_LOGS = "lg AS (SELECT venue, year, max(published_at) AS seen FROM papers GROUP BY venue, year), ask AS (SELECT venue, unnest(range(1994, 2004))::INTEGER AS year FROM (SELECT DISTINCT venue FROM papers))"


@query(f"WITH {SQL_PAPERS}, {_LOGS} SELECT ask.venue, ask.year, seen IS NULL OR TIMESTAMP '2000-01-05 12:00:00' - seen > INTERVAL 7 DAYS AS due, seen IS NOT NULL AS known FROM ask LEFT JOIN lg USING (venue, year)")
def scrape_due(spark, sf_dir):
    """Which venues and years are to be scraped again on a day, by a log with an entry for every paper."""
    papers = A.papers(spark, sf_dir)
    logs = papers.select("venue", "year", F.lit(1).cast("bigint").alias("paper_count"), F.col("published_at").alias("scraped_at"))
    asked = papers.select("venue").distinct().select("venue", F.explode(F.sequence(F.lit(1994), F.lit(2003))).alias("year"))
    rows = reads.due(asked, logs, F.lit("2000-01-05 12:00:00").cast("timestamp"))
    return rows.select("venue", "year", "due", F.col("scraped_at").isNotNull().alias("known"))


@query(f"WITH {SQL_PAPERS}, n AS (SELECT venue, year, count(*) AS n FROM papers GROUP BY venue, year) SELECT venue, year, sum(n)::BIGINT AS paper_count, count(*) + 1 AS entries FROM (SELECT venue, year, n FROM n) GROUP BY venue, year")
def scrape_logged(spark, sf_dir):
    """A log of two runs over all venues and years; a run adds rows and changes none."""
    papers = A.papers(spark, sf_dir)
    done = papers.groupBy("venue", "year").agg(F.count("*").alias("paper_count"))
    at = lambda day: F.lit(f"2024-01-{day} 00:00:00").cast("timestamp")
    none = spark.createDataFrame([], "venue string, year int, paper_count bigint, scraped_at timestamp")
    logs = reads.logged(reads.logged(none, done.withColumn("paper_count", F.lit(0)), at("01")), done, at("02"))
    return logs.groupBy("venue", "year").agg(F.sum("paper_count").alias("paper_count"), F.count("*").alias("entries"))


_SCOPES = "sc AS (SELECT event_type || ' ' || user_id % 8 AS scope, user_id % 4 AS kind, max(ts) AS seen, count(*) AS n FROM events GROUP BY ALL)"


@query(f"WITH {_SCOPES} SELECT scope, kind <> 0 AS run, CASE kind WHEN 1 THEN 'first' WHEN 2 THEN 'records' WHEN 3 THEN 'papers' END AS reason FROM sc")
def analysis_gates(spark, sf_dir):
    """Scopes that have been analysed as they are, never, before their last records, and with another number of papers."""
    e = A.events(spark, sf_dir)
    scopes = e.groupBy(F.concat_ws(" ", "category", (F.col("user_id") % 8).cast("string")).alias("scope"), (F.col("user_id") % 4).alias("kind")).agg(F.max("ts").alias("retrieved_at"), F.count("*").alias("papers"))
    before = scopes.where("kind <> 1").withColumns({"retrieved_at": F.when(F.col("kind") == 2, F.col("retrieved_at") - F.make_dt_interval(F.lit(1))).otherwise(F.col("retrieved_at")), "papers": F.when(F.col("kind") == 3, F.col("papers") - 1).otherwise(F.col("papers"))})
    return reads.gates(scopes.select("scope", "retrieved_at", "papers"), reads.after_run(before, F.lit("2024-02-01")))


@query(f"WITH {SQL_PAPERS}, {_SCOPES} SELECT count(*) AS papers, count(DISTINCT venue) AS venues, min(year) || '-' || max(year) AS year_range, (SELECT 3 * count(*) FROM sc) AS meta_entries, '2024-02-01' AS last_run FROM papers")
def status_with_runs(spark, sf_dir):
    e = A.events(spark, sf_dir)
    scopes = e.groupBy(F.concat_ws(" ", "category", (F.col("user_id") % 8).cast("string")).alias("scope")).agg(F.max("ts").alias("retrieved_at"), F.count("*").alias("papers"))
    return reads.run_status(A.papers(spark, sf_dir), reads.after_run(scopes, F.lit("2024-02-01")))


@query(f"""WITH {SQL_PAPERS}, r AS (SELECT venue, count(*) AS papers FROM papers WHERE published_at >= (SELECT max(published_at) FROM papers) - INTERVAL 30 DAYS GROUP BY venue)
    SELECT venue, papers, round(papers / (SELECT sum(papers) FROM r), 6)::DOUBLE AS share, papers / (SELECT sum(papers) FROM r) > 0.95 AS warning FROM r ORDER BY papers DESC, venue LIMIT 1""")
def recent_venue_skew(spark, sf_dir):
    """The venue with the most papers of the last 30 days before the latest one."""
    papers = A.papers(spark, sf_dir).withColumnRenamed("published_at", "created_at")
    now = papers.agg(F.max("created_at").alias("now"))
    return reads.recent_skew(papers.join(now), F.col("now")).withColumn("share", F.round("share", 6))


@query(f"WITH {SQL_KP}, t AS (SELECT keyword, count(*) AS count FROM kp GROUP BY keyword ORDER BY count DESC, keyword LIMIT 20) SELECT CAST(row_number() OVER (ORDER BY count DESC, keyword) AS INTEGER) AS place, keyword, count, round(count / max(count) OVER (), 6)::DOUBLE AS width FROM t")
def chart_bars(spark, sf_dir):
    return reads.bars(K.counts(_rows(spark, sf_dir))).withColumn("width", F.round("width", 6))


@query(f"""WITH {SQL_KP}, r AS (SELECT venue, year, keyword, count(*) AS c, {_RANKS} FROM kp GROUP BY venue, year, keyword), y AS (SELECT venue, max(year) AS year FROM papers GROUP BY venue), n AS (SELECT venue, year, count(*) AS papers FROM papers GROUP BY venue, year)
    SELECT venue, year, papers, keyword, c AS count, rank::INTEGER AS rank FROM y JOIN n USING (venue, year) JOIN r USING (venue, year) WHERE rank <= 10""")
def chart_latest_years(spark, sf_dir):
    ranks = K.ranked(K.counts(_rows(spark, sf_dir), "venue", "year"), ["venue", "year"], 10)
    return reads.latest_years(A.papers(spark, sf_dir), ranks)


def _bucketed(spark, sf_dir, buckets=8):
    """Orders and the keywords of orders as tables by paper."""
    name = uuid.uuid4().hex
    papers = layout.bucketed(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("year")), f"papers_{name}", "paper_id", buckets)
    return papers, layout.bucketed(A.paper_keywords(spark, sf_dir), f"paper_keywords_{name}", "paper_id", buckets)


@query(f"WITH {SQL_PK} SELECT year(o_orderdate)::INTEGER AS year, count(*) AS keywords, count(DISTINCT paper_id) AS papers FROM pk JOIN orders ON o_orderkey = paper_id GROUP BY 1")
def bucketed_keyword_years(spark, sf_dir):
    """Keywords with their papers' years: neither side of the join is moved, and a paper's keywords are counted where they are."""
    papers, pk = _bucketed(spark, sf_dir)
    per = pk.groupBy("paper_id").agg(F.count("*").alias("keywords"))
    return per.join(papers, "paper_id").groupBy("year").agg(F.sum("keywords").alias("keywords"), F.count("*").alias("papers"))


@query(f"WITH {SQL_PK} SELECT o_orderkey AS paper_id, year(o_orderdate)::INTEGER AS year FROM orders WHERE NOT EXISTS (SELECT 1 FROM pk WHERE paper_id = o_orderkey AND method = 'R')")
def bucketed_without_keywords(spark, sf_dir):
    papers, pk = _bucketed(spark, sf_dir)
    return papers.join(pk.where("method = 'R'"), "paper_id", "left_anti")


# ------------------------------------------------------------ files, schemas and versions


@query("SELECT s_name AS canonical_name, CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tier, CASE WHEN s_suppkey % 2 = 0 THEN 's' || s_suppkey || '|x, y' ELSE '' END AS aliases FROM supplier")
def registry_csv(spark, sf_dir):
    """Suppliers as a registry file with quoted alias lists, as it is read back: aliases trimmed, empty ones left out."""
    s = table(spark, sf_dir, "supplier")
    tier = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    alias = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" s"), "s_suppkey", F.lit(" ,, x; y ,"))).otherwise(F.lit(" , "))
    blank = [F.lit("").alias(c) for c in ("source_preference", "openreview_id_pattern", "s2_venue_key", "openalex_venue_name")]
    path = new_path(spark, "registry")
    s.select(F.col("s_name").alias("canonical_name"), F.lit("A, \"full\" name").alias("full_name"), F.lit("ML").alias("domain"), tier.alias("tier"), *blank, alias.alias("aliases")).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return registry(spark, path).select("canonical_name", "tier", F.replace(F.array_join("aliases", "|"), F.lit(";"), F.lit(",")).alias("aliases"))


@query(f"WITH {SQL_KP}, v AS (SELECT venue, count(*) AS papers, min(year) AS first_year FROM papers GROUP BY venue) SELECT venue AS name, papers AS paper_count, first_year FROM v")
def static_json_index(spark, sf_dir):
    """The venues' index as one JSON array over many lines, as a static site's reader gets it."""
    v = A.papers(spark, sf_dir).groupBy("venue").agg(F.count("*").alias("paper_count"), F.min("year").alias("first_year"))
    whole = v.agg(F.array_sort(F.collect_list(F.struct(F.col("venue").alias("name"), "paper_count", "first_year"))).alias("venues"))  # a row a venue
    path = new_path(spark, "index")
    whole.select(F.replace(F.to_json("venues"), F.lit("},{"), F.lit("},\n{"))).coalesce(1).write.text(path)
    return static_json(spark, path).select("name", "paper_count", F.col("first_year").cast("int").alias("first_year"))


@query("SELECT 'exact' AS kind, count(*) FILTER (contains(event_type, 'C')) AS papers FROM events UNION ALL SELECT 'any', count(*) FILTER (contains(lower(event_type), 'c')) FROM events UNION ALL SELECT 'all', count(*) FROM events")
def category_membership(spark, sf_dir):
    """Rows in a category by its exact text, in any case, and in ALL."""
    e = A.events(spark, sf_dir)
    kinds = {"exact": in_category(F.col("category"), "C", any_case=False), "any": in_category(F.col("category"), "C"), "all": in_category(F.col("category"), "ALL")}
    counted = e.agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("papers")) for k in kinds])).alias("x")).select("x.*")


@query("SELECT o_orderkey AS paper_id, md5(o_orderpriority) AS title_md5, CAST(year(o_orderdate) AS INTEGER) AS year, true AS abstract_null FROM orders")
def evolved_records(spark, sf_dir):
    """Orders as rows of an old schema, brought to that of papers: columns renamed and cast, missing ones NULL."""
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").cast("string").alias("year"), F.lit("x").alias("gone"))
    new = evolve(old, {"id": "paper_id", "title": "canonical_title"}, schema("papers"))
    return new.select("paper_id", F.md5("canonical_title").alias("title_md5"), "year", F.col("abstract").isNull().alias("abstract_null"))


@query("SELECT user_id, event_type, max(event_id) AS event_id, 2 AS versions FROM events GROUP BY user_id, event_type")
def versioned_upserts(spark, sf_dir):
    """All events upserted into a versioned table in two batches, the later first: the last event of each user and kind stays whatever the order of arrival."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    half = rows.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    t = Table(spark, new_path(spark, "versions"))
    for part in (rows.where(F.col("event_id") > half), rows.where(F.col("event_id") <= half)):
        last = part.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
        had = t.read() if t.version() else last.limit(0)
        t.upsert(last.unionByName(had.select(*last.columns)), ["user_id", "event_type"], [F.col("event_id")])
    return t.read().select("user_id", "event_type", "event_id", F.lit(t.version()).cast("int").alias("versions"))
