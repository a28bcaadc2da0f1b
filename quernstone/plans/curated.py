"""Queries over structured papers: what ingestion, structuring, extraction and venue updates make of raw records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone import lexicon
from quernstone.functions import text as X
from quernstone.operators import batch as B
from quernstone.operators import extract as E
from quernstone.operators import keywords as K
from quernstone.operators import lookups as L
from quernstone.operators import quality as Q
from quernstone.operators import series as S
from quernstone.operators import structuring, upsert
from quernstone.plans import adapters as A
from quernstone.plans.adapters import SQL_COMMENTED, SQL_EVENTS, SQL_PAPERS, SQL_PK, SQL_SUB, SQL_VENUES
from quernstone.plans.corpus import _redetect_case, sql_domain, sql_venue
from quernstone.plans.registry import query
from quernstone.sources import feeds, payloads
from quernstone.sources.tables import table

_KEEP = """s AS (SELECT *, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS canonical_title, CASE source WHEN 'openreview' THEN 1 WHEN 'arxiv' THEN 2 WHEN 'openalex' THEN 3 ELSE 4 END AS prio FROM sub),
    g AS (SELECT *, lower(canonical_title) AS k FROM s WHERE canonical_title <> ''),
    kept AS (SELECT *, CASE WHEN year IS NULL THEN first_value(raw_id) OVER (PARTITION BY k ORDER BY prio, raw_id) ELSE first_value(raw_id) OVER (PARTITION BY k, year ORDER BY prio, raw_id) END AS keep_id FROM g)"""
_DETECT = f"""det AS (SELECT *, {sql_venue('venue_raw')} AS vr, {sql_venue('comments')} AS vc, {sql_venue('journal_ref')} AS vj FROM kept),
    named AS (SELECT *, CASE WHEN source = 'openreview' AND venue_raw <> '' THEN venue_raw WHEN vr IS NOT NULL THEN vr WHEN vc IS NOT NULL THEN vc ELSE vj END AS venue,
    CASE WHEN source = 'openreview' AND venue_raw <> '' THEN 1.0::DOUBLE WHEN vr IS NOT NULL THEN 0.9 WHEN vc IS NOT NULL THEN 0.7 WHEN vj IS NOT NULL THEN 0.8 ELSE 0.0 END AS confidence FROM det)"""
_STRUCTURED = f"""{SQL_SUB}, {_KEEP}, {_DETECT}, t AS (SELECT *, lower(canonical_title || ' ' || coalesce(abstract, '')) AS t FROM named WHERE raw_id = keep_id),
    sp AS (SELECT keep_id, canonical_title, abstract, year, venue, CASE WHEN venue IS NOT NULL THEN 'conference' WHEN source = 'arxiv' AND journal_ref <> '' THEN 'journal' WHEN source = 'arxiv' THEN 'preprint'
    WHEN contains(lower(categories), 'article') THEN 'journal' ELSE 'unknown' END AS venue_type, {sql_domain()} AS domain,
    CASE WHEN source = 'openreview' OR venue IS NOT NULL AND contains(lower(comments), 'accepted') THEN 'accepted' ELSE 'unknown' END AS quality_flag FROM t)"""


@query(f"WITH {_STRUCTURED} SELECT keep_id, md5(canonical_title) AS title_md5, year, venue, venue_type, domain, quality_flag FROM sp")
def structured_papers(spark, sf_dir):
    done = structuring.structure(A.submissions(spark, sf_dir))
    return done.papers.select("keep_id", F.md5("canonical_title").alias("title_md5"), "year", "venue", "venue_type", "domain", "quality_flag")


@query(f"WITH {SQL_SUB}, {_KEEP}, {_DETECT} SELECT keep_id, raw_id, source, confidence FROM named")
def structured_links(spark, sf_dir):
    return structuring.structure(A.submissions(spark, sf_dir)).links.select("keep_id", "raw_id", "source", "confidence")


@query(f"WITH {SQL_SUB}, {_KEEP} SELECT (SELECT count(*) FROM sub) AS processed, (SELECT count(*) FROM s WHERE canonical_title = '') AS failed, count(*) FILTER (raw_id = keep_id) AS success, count(*) FILTER (raw_id <> keep_id) AS merged FROM kept")
def structured_counters(spark, sf_dir):
    return structuring.structure(A.submissions(spark, sf_dir)).counters


@query(f"""WITH {SQL_SUB}, {_KEEP}, {_DETECT}, p AS (SELECT keep_id, venue FROM named WHERE raw_id = keep_id AND venue IS NOT NULL), j AS (SELECT p.venue, n.* EXCLUDE (venue) FROM p JOIN named n USING (keep_id))
    SELECT venue, count(*) AS links, count(*) FILTER (source = 'openreview' OR contains(upper(coalesce(venue_raw, '')), upper(venue)) OR contains(upper(coalesce(comments, '')), upper(venue)) OR source = 's2' AND venue_raw <> '') AS confirmed FROM j GROUP BY venue""")
def venue_precision(spark, sf_dir):
    """Papers with a venue, their links and the linked raw records: how many of the records confirm the venue."""
    raw = A.submissions(spark, sf_dir)
    done = structuring.structure(raw)
    named = done.papers.where("venue is not null").select("paper_id", "venue")
    joined = named.join(done.links.select("paper_id", "raw_id"), "paper_id").join(raw.select("raw_id", "source", "venue_raw", "comments"), "raw_id")
    ok = B.precise(F.col("venue"), F.col("source"), F.col("venue_raw"), F.col("comments"))
    return joined.groupBy("venue").agg(F.count("*").alias("links"), F.count_if(ok).alias("confirmed"))


@query(f"WITH {SQL_SUB}, {_KEEP}, n AS (SELECT keep_id, count(DISTINCT source) AS sources FROM kept GROUP BY keep_id) SELECT sources, count(*) AS papers FROM n GROUP BY sources")
def fusion_analysis(spark, sf_dir):
    return Q.fusion(structuring.structure(A.submissions(spark, sf_dir)).links)


@query(f"""WITH {_STRUCTURED}, a AS (SELECT count(*) AS n, count(*) FILTER (coalesce(abstract, '') = '') AS e FROM sub), b AS (SELECT count(*) AS n, count(*) FILTER (coalesce(abstract, '') = '') AS e, count(venue) AS v FROM sp), c AS (SELECT count(*) AS n FROM kept)
    SELECT 'structuring rate' AS name, round(c.n * 100.0 / a.n, 2)::DOUBLE AS value, 50.0::DOUBLE AS threshold, round(c.n * 100.0 / a.n, 2) >= 50 AS passed FROM a, c
    UNION ALL SELECT 'raw without abstract', round(e * 100.0 / n, 2), 30, round(e * 100.0 / n, 2) <= 30 FROM a UNION ALL SELECT 'papers without abstract', round(e * 100.0 / n, 2), 20, round(e * 100.0 / n, 2) <= 20 FROM b
    UNION ALL SELECT 'venue known', round(v * 100.0 / n, 2), 0, true FROM b UNION ALL SELECT 'links a paper', round(c.n / b.n, 2), 1, round(c.n / b.n, 2) >= 1 FROM b, c""")
def layer_report(spark, sf_dir):
    raw = A.submissions(spark, sf_dir)
    done = structuring.structure(raw)
    return Q.layers(raw, done.papers, done.links)


@query(f"""WITH {SQL_SUB}, c AS (SELECT raw_id, {_redetect_case('comments', True)} AS c, {_redetect_case('journal_ref', False)} AS j FROM sub),
    b AS (SELECT raw_id, CASE WHEN j IS NULL OR c.confidence >= j.confidence THEN c ELSE j END AS v FROM c)
    SELECT raw_id, v.venue AS venue, v.confidence AS confidence, v.year AS year FROM b WHERE v IS NOT NULL""")
def venue_redetect_sources(spark, sf_dir):
    """The surer of comments and journal reference, both of which are there."""
    rows = A.submissions(spark, sf_dir).withColumn("v", X.redetect_venue(F.col("comments"), F.col("journal_ref"))).where("v is not null")
    return rows.select("raw_id", "v.venue", "v.confidence", "v.year")


@query(f"""WITH {SQL_SUB}, c AS (SELECT raw_id, raw_id // 3 AS paper_id, {_redetect_case('comments', True)} AS c, {_redetect_case('journal_ref', False)} AS j FROM sub),
    b AS (SELECT paper_id, CASE WHEN j IS NULL OR c.confidence >= j.confidence THEN c ELSE j END AS v FROM c),
    o AS (SELECT paper_id, v, row_number() OVER (PARTITION BY paper_id ORDER BY v.confidence DESC, v.venue, coalesce(v.year, 9999)) AS n FROM b WHERE v IS NOT NULL),
    p AS (SELECT raw_id AS paper_id, year, venue_raw AS venue FROM sub WHERE raw_id <= (SELECT max(raw_id) // 3 FROM sub))
    SELECT p.paper_id, coalesce(v.venue, p.venue) AS venue, coalesce(v.year, p.year) AS year, coalesce(v.venue, p.venue) IS DISTINCT FROM p.venue OR coalesce(v.year, p.year) IS DISTINCT FROM p.year AS changed
    FROM p LEFT JOIN (SELECT * FROM o WHERE n = 1) o ON o.paper_id = p.paper_id""")
def venue_update(spark, sf_dir):
    """Papers with several sources each: venue and year are those that the surest source says."""
    rows = A.submissions(spark, sf_dir)
    last = rows.agg(F.floor(F.max("raw_id") / 3).alias("last"))
    papers = rows.join(F.broadcast(last)).where("raw_id <= last").select(F.col("raw_id").alias("paper_id"), "year", F.col("venue_raw").alias("venue"))
    sources = rows.select(F.floor(F.col("raw_id") / 3).cast("bigint").alias("paper_id"), "comments", "journal_ref")
    return B.redetected(papers, sources).select("paper_id", "venue", "year", "changed")


# ------------------------------------------------------------ ingestion


@query(f"""WITH {SQL_SUB}, r AS (SELECT source, raw_id % 50 AS id, raw_id AS seq, title, raw_id % 11 = 0 OR trim(title) = '' AS bad FROM sub),
    w AS (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY seq DESC) AS n FROM r WHERE NOT bad) SELECT source, id::VARCHAR AS source_paper_id, seq, 'saved' AS kind FROM w WHERE n = 1
    UNION ALL SELECT source, CASE WHEN seq % 11 <> 0 THEN id::VARCHAR END, seq, 'reject' FROM r WHERE bad""")
def ingest_batch(spark, sf_dir):
    """Two batches into one table: the last record of a key stays; records without an id or title are rejects."""
    key = F.when(F.col("raw_id") % 11 != 0, (F.col("raw_id") % 50).cast("string"))
    rows = A.submissions(spark, sf_dir).select("source", key.alias("source_paper_id"), F.col("raw_id").alias("seq"), "title")
    raw, bad = B.ingest(rows.limit(0), rows.where("seq % 2 = 0"))
    raw, more = B.ingest(raw, rows.where("seq % 2 = 1 or seq % 2 = 0"))
    rejects = bad.unionByName(more).distinct()
    return raw.select("source", "source_paper_id", "seq", F.lit("saved").alias("kind")).unionByName(rejects.select("source", "source_paper_id", "seq", F.lit("reject").alias("kind")))


@query(f"""WITH {SQL_SUB}, r AS (SELECT source, raw_id, raw_id % 50 AS id, raw_id % 11 = 0 OR trim(title) = '' AS bad FROM sub), n AS (SELECT source, id, bad FROM r WHERE raw_id % 2 = 0), k AS (SELECT DISTINCT source, id FROM r WHERE raw_id % 2 = 1 AND NOT bad AND raw_id < 40),
    p AS (SELECT source, id, count(*) FILTER (NOT bad) AS good, source || id IN (SELECT source || id FROM k) AS seen FROM n GROUP BY ALL)
    SELECT coalesce(sum(CASE WHEN good > 0 AND NOT seen THEN 1 ELSE 0 END), 0)::BIGINT AS saved, (coalesce(sum(good), 0) - coalesce(sum(CASE WHEN good > 0 AND NOT seen THEN 1 ELSE 0 END), 0))::BIGINT AS duplicates, (SELECT count(*) FROM n WHERE bad) AS errors FROM p""")
def collection_tallies(spark, sf_dir):
    key = F.when(F.col("raw_id") % 11 != 0, (F.col("raw_id") % 50).cast("string"))
    rows = A.submissions(spark, sf_dir).select("source", key.alias("source_paper_id"), "raw_id", "title")
    known = rows.where("raw_id % 2 = 1 and raw_id < 40 and source_paper_id is not null and trim(title) <> ''")
    return feeds.tallies(known, rows.where("raw_id % 2 = 0"), ["source", "source_paper_id"])


def _arxiv_payloads(spark, sf_dir):
    d = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    fields = F.struct(
        F.concat(F.lit("http://arxiv.org/abs/24"), k, F.lit("v3")).alias("id"), F.concat(F.lit(" On\nOrder "), k).alias("title"), F.concat(F.lit("All of\n"), "o_orderpriority").alias("summary"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"),
        F.array(F.lit("Ann"), F.lit(""), F.concat(F.lit("Bo "), k)).alias("authors"), F.array(F.lit("cs.LG"), "o_orderstatus").alias("categories"), F.array(F.struct(F.lit("u1").alias("href"), F.lit("text/html").alias("type")), F.struct(F.concat(F.lit("pdf/"), k).alias("href"), F.lit("application/pdf").alias("type"))).alias("links"),
    )
    return d.select(F.to_json(fields).alias("payload"))


@query("""SELECT '24' || o_orderkey AS source_paper_id, 'On Order ' || o_orderkey AS title, 'All of ' || o_orderpriority AS abstract, 'Ann|Bo ' || o_orderkey AS authors, CAST(year(o_orderdate) AS INTEGER) AS year, 'cs.LG,' || o_orderstatus AS categories,
    strftime(o_orderdate, '%Y-%m-%d') AS day, 'pdf/' || o_orderkey AS pdf_url FROM orders""")
def payload_arxiv(spark, sf_dir):
    rows = payloads.arxiv(_arxiv_payloads(spark, sf_dir))
    return rows.select("source_paper_id", "title", "abstract", F.array_join("authors", "|").alias("authors"), "year", "categories", F.date_format("published_at", "yyyy-MM-dd").alias("day"), "pdf_url")


@query("""SELECT 'W' || c_custkey AS source_paper_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'other ' || c_name END AS title, 'the ' || lower(c_mktsegment) || '  the' AS abstract, '10.1/' || c_custkey AS doi, 'article' AS categories, 'a,b,c,d,e' AS comments, CAST(2000 + c_nationkey AS INTEGER) AS year FROM customer""")
def payload_openalex(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    index = F.map_from_arrays(F.array(F.lit("the"), F.lower("c_mktsegment")), F.array(F.array(F.lit(0), F.lit(3)), F.array(F.lit(1))))
    concepts = F.array(*[F.struct(F.lit(x).alias("display_name")) for x in "abcdef"])
    fields = F.struct(F.concat(F.lit("https://openalex.org/W"), k).alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("display_name"), F.concat(F.lit("other "), "c_name").alias("title"), F.concat(F.lit("https://doi.org/10.1/"), k).alias("doi"), (2000 + F.col("c_nationkey")).cast("int").alias("publication_year"), F.lit("article").alias("type"), concepts.alias("concepts"), index.alias("abstract_inverted_index"))
    rows = payloads.openalex(c.select(F.to_json(fields).alias("payload")))
    return rows.select("source_paper_id", "title", "abstract", "doi", "categories", "comments", "year")


@query("SELECT 's' || s_suppkey AS source_paper_id, s_name AS title, 'CVPR' AS venue_raw, 2021 AS year, '10.2/' || s_suppkey AS doi FROM supplier WHERE s_suppkey % 3 <> 0")
def payload_semantic_scholar(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    fields = F.struct(F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("s"), k)).alias("paperId"), F.col("s_name").alias("title"), F.create_map(F.lit("DOI"), F.concat(F.lit("10.2/"), k)).alias("externalIds"))
    return payloads.semantic_scholar(table(spark, sf_dir, "supplier").select(F.to_json(fields).alias("payload")), "CVPR", 2021).select("source_paper_id", "title", "venue_raw", "year", "doi")


@query("SELECT 'n' || s_suppkey AS source_paper_id, s_name AS title, 'k1,k2' AS comments, 'A|B' AS authors, 'ICLR' AS venue_raw FROM supplier")
def payload_openreview(spark, sf_dir):
    """Fields that are values in every second note, and wrapped in the others."""
    wrapped = lambda c: F.struct(c.alias("value"))
    words, authors = F.array(F.lit("k1"), F.lit(""), F.lit("k2")), F.array(F.lit("A"), F.lit("B"))
    note = lambda f: F.to_json(F.struct(F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("id"), F.struct(f(F.col("s_name")).alias("title"), f(words).alias("keywords"), f(authors).alias("authors")).alias("content")))
    rows = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, note(wrapped)).otherwise(note(lambda c: c)).alias("payload"))
    return payloads.openreview(rows, "ICLR", 2024).select("source_paper_id", "title", "comments", F.array_join("authors", "|").alias("authors"), "venue_raw")


# ------------------------------------------------------------ feeds

_FEED = "feed AS (SELECT event_id::VARCHAR AS source_paper_id, event_id AS place, ts AS retrieved_at, CAST(year(ts) AS INTEGER) AS year, event_type AS categories, ts FROM events)"


def _feed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("event_id").cast("string").alias("source_paper_id"), F.col("event_id").alias("place"), ts.alias("retrieved_at"), F.year(ts).alias("year"), F.col("event_type").alias("categories"), ts.alias("published_at"), F.col("event_type").alias("title"), F.lit(None).cast("string").alias("abstract"))


@query(f"WITH {_FEED} SELECT source_paper_id, categories FROM feed WHERE (contains(categories, 'click') OR contains(categories, 'view')) AND contains(lower(categories), 'i') ORDER BY ts DESC, source_paper_id LIMIT 50 OFFSET 20")
def feed_search(spark, sf_dir):
    return feeds.search(_feed(spark, sf_dir), ["click", "view"], "I", 20, 50).select("source_paper_id", "categories")


_FRESH = "place % 10 < CASE WHEN place < 500 THEN 7 ELSE 3 END"


@query(f"""WITH {_FEED}, p AS (SELECT place // 100 AS page, avg(({_FRESH})::INT::DOUBLE) AS share FROM feed GROUP BY 1), s AS (SELECT min(page) AS stop FROM p WHERE share < 0.5)
    SELECT page, count(*) AS records FROM (SELECT place // 100 AS page FROM feed WHERE {_FRESH}), s WHERE stop IS NULL OR page <= stop GROUP BY page""")
def feed_until_stale(spark, sf_dir):
    """Pages of a feed, read until one has under half recent records: seven of ten are recent at first, then three."""
    at = lambda day: F.lit(f"2030-{day}").cast("timestamp")
    rows = _feed(spark, sf_dir).withColumn("retrieved_at", F.when(F.expr(_FRESH), at("06-02")).otherwise(at("05-01"))).withColumn("year", F.lit(2029))
    kept = feeds.until_stale(rows, at("06-01"), page=100)
    return kept.groupBy(F.floor(F.col("place") / 100).alias("page")).agg(F.count("*").alias("records"))


@query(f"WITH {_FEED} SELECT source_paper_id FROM feed WHERE categories = 'click' AND source_paper_id > '2' ORDER BY source_paper_id LIMIT 30")
def feed_works_page(spark, sf_dir):
    return feeds.works(_feed(spark, sf_dir), feeds.works_filter(categories="click", year=None), after="2", page=30).select("source_paper_id")


@query("SELECT s_name AS name FROM supplier WHERE contains(lower(s_name), '00001') ORDER BY s_name LIMIT 10")
def feed_named_venues(spark, sf_dir):
    return feeds.named_venues(A.venues(spark, sf_dir), "00001").select("name")


@query("""WITH r AS (SELECT o_custkey % 40 AS venue, o_orderpriority AS invitation, o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 END AS k FROM orders), m AS (SELECT venue, min(k) AS k FROM r GROUP BY venue)
    SELECT venue, invitation, count(*) AS submissions FROM r JOIN m USING (venue, k) GROUP BY ALL""")
def feed_with_fallback(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("venue"), F.col("o_orderpriority").alias("invitation"), F.col("o_orderkey").alias("id"))
    return feeds.with_fallback(o, ["1-URGENT", "3-MEDIUM"]).groupBy("venue", "invitation").agg(F.count("*").alias("submissions"))


# ------------------------------------------------------------ keywords of batches and buckets


@query(f"""WITH {SQL_PK}, n AS (SELECT l_orderkey AS paper_id, '  ' || upper(p_name) || ' ' AS raw, 'R' AS method, 2.0::DOUBLE AS score FROM lineitem JOIN part ON l_partkey = p_partkey),
    u AS (SELECT paper_id, lower(trim(raw)) AS keyword, method, score, 1 AS w FROM n UNION ALL SELECT paper_id, keyword, method, score::DOUBLE, 0 FROM pk), r AS (SELECT *, row_number() OVER (PARTITION BY paper_id, keyword, method ORDER BY w DESC, score DESC) AS i FROM u)
    SELECT method, count(*) AS keywords, count(*) FILTER (score = 2) AS replaced FROM r WHERE i = 1 GROUP BY method""")
def put_keywords(spark, sf_dir):
    pk = A.paper_keywords(spark, sf_dir).withColumn("score", F.col("score").cast("double"))
    new = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("paper_id"), F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")).alias("keyword"), F.lit("R").alias("method"), F.lit(2.0).alias("score"))
    return B.put_keywords(pk, new).groupBy("method").agg(F.count("*").alias("keywords"), F.count_if(F.col("score") == 2).alias("replaced"))


@query(f"""WITH {SQL_SUB}, r AS (SELECT *, {'lower(trim(regexp_replace(title, chr(92) || chr(115) || chr(43), chr(32), chr(103))))'} AS k FROM sub), g AS (SELECT * FROM r WHERE k <> ''), had AS (SELECT DISTINCT k, year FROM g WHERE raw_id % 5 = 0),
    f AS (SELECT k, year, min(raw_id) AS seq FROM g GROUP BY ALL) SELECT seq, md5(k) AS title_md5, year FROM f WHERE NOT EXISTS (SELECT 1 FROM had WHERE had.k = f.k AND had.year IS NOT DISTINCT FROM f.year)""")
def legacy_save(spark, sf_dir):
    rows = A.submissions(spark, sf_dir).select(F.col("raw_id").alias("seq"), "title", "year", F.lit("v").alias("venue"), F.array("source").alias("author"), F.array("venue_raw").alias("extracted"))
    known = A.submissions(spark, sf_dir).where("raw_id % 5 = 0").select(F.col("title").alias("canonical_title"), "year")
    return B.save_legacy(rows, known)[0].select("seq", F.md5("title_key").alias("title_md5"), "year")


@query(f"""WITH {SQL_SUB}, r AS (SELECT lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS k, year, unnest([['author', 'A ' || source], ['extracted', venue_raw], ['extracted', 'x']]) AS w FROM sub)
    SELECT DISTINCT md5(k) AS title_md5, year, lower(trim(w[2])) AS keyword, w[1] AS method FROM r WHERE k <> '' AND length(trim(w[2])) BETWEEN 2 AND 100""")
def legacy_keywords(spark, sf_dir):
    rows = A.submissions(spark, sf_dir).select(F.col("raw_id").alias("seq"), "title", "year", F.lit("v").alias("venue"), F.array(F.concat(F.lit("A "), "source")).alias("author"), F.array("venue_raw", F.lit("x")).alias("extracted"))
    return B.save_legacy(rows, rows.limit(0).select(F.col("title").alias("canonical_title"), "year"))[1].select(F.md5("title_key").alias("title_md5"), "year", "keyword", "method")


_VALID = "regexp_full_match(lower(trim(keyword)), '[a-z][a-z\\s-]*') AND length(trim(keyword)) > 2"


@query(f"""WITH {SQL_PAPERS}, {SQL_PK}, b AS (SELECT strftime(published_at, '%Y-%m') AS bucket, paper_id FROM papers), d AS (SELECT bucket, keyword, count(*) AS c FROM b JOIN pk USING (paper_id) WHERE paper_id % 3 = 0 AND bucket < '1996' AND {_VALID} GROUP BY ALL),
    f AS (SELECT bucket, 'unnamed' AS keyword, count(*) AS c FROM b GROUP BY bucket), a AS (SELECT bucket, keyword, c, 0 AS tier FROM d UNION ALL SELECT bucket, keyword, c, 1 FROM f),
    m AS (SELECT bucket, min(tier) AS tier FROM a GROUP BY bucket), r AS (SELECT a.*, row_number() OVER (PARTITION BY bucket ORDER BY c DESC, keyword) AS n FROM a JOIN m USING (bucket, tier))
    SELECT bucket, keyword, c AS count, tier FROM r WHERE n <= 10""")
def bucket_keyword_tiers(spark, sf_dir):
    """Stored keywords of a month's papers where there are any, else the fallback tier: the first tier with keywords counts for the month."""
    b = A.papers(spark, sf_dir).select("paper_id", F.date_format("published_at", "yyyy-MM").alias("bucket"))
    stored = E.stored_tier(b, A.paper_keywords(spark, sf_dir).where("paper_id % 3 = 0")).where("bucket < '1996'")
    last = b.groupBy("bucket").agg(F.count("*").alias("count")).select("bucket", F.lit("unnamed").alias("keyword"), "count")
    return E.tiered([stored, last], 10, ("bucket",))


@query()
def bucket_keyword_phrases(spark, sf_dir):
    """Whole texts of a language and source count as one: its key phrases, or title words where it has none."""
    papers = A.raw_papers(spark, sf_dir).select(F.col("raw_id").alias("paper_id"), F.concat_ws(" ", "categories", "source").alias("bucket"), "title", "abstract")
    return E.tiered([E.phrase_tier(papers, 10), E.token_tier(papers)], 10, ("bucket",))


@query(f"""WITH {SQL_SUB}, p AS (SELECT raw_id, year, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS k FROM sub), y AS (SELECT k, year, min(raw_id) AS id FROM p GROUP BY k, year), t AS (SELECT k, min(raw_id) AS id FROM p GROUP BY k)
    SELECT raw_id AS ask, CASE WHEN p.year IS NULL THEN t.id ELSE y.id END AS paper_id FROM p LEFT JOIN y ON y.k = p.k AND y.year = p.year LEFT JOIN t ON t.k = p.k""")
def title_lookup(spark, sf_dir):
    rows = A.submissions(spark, sf_dir)
    papers = rows.select(F.col("raw_id").alias("paper_id"), F.col("title").alias("canonical_title"), "year")
    return L.by_title(papers, rows.select(F.col("raw_id").alias("ask"), "title", "year")).select("ask", "paper_id")


@query(f"""WITH {SQL_COMMENTED}, o AS (SELECT raw_id, CASE WHEN raw_id % 4 > 0 THEN comments END AS venue FROM com), v AS (SELECT DISTINCT venue FROM o WHERE venue <> '')
    SELECT o.venue, count(*) AS papers, count(v.venue) AS linked FROM o LEFT JOIN v ON o.venue = v.venue GROUP BY o.venue""")
def legacy_migration(spark, sf_dir):
    old = A.commented(spark, sf_dir).select(F.col("raw_id").alias("id"), F.lit("t").alias("title"), F.when(F.col("raw_id") % 4 > 0, F.col("comments")).alias("venue"), F.lit(2020).alias("year"))
    venues, papers = B.migrated(old)
    return papers.groupBy("venue").agg(F.count("*").alias("papers"), F.count("venue_id").alias("linked"))


@query(f"""WITH {SQL_PK}, n AS (SELECT DISTINCT keyword FROM pk), e AS (SELECT keyword, count(*) AS count FROM pk GROUP BY keyword), t AS (SELECT keyword FROM e ORDER BY count DESC, keyword LIMIT 50)
    SELECT 0::BIGINT AS changed, (SELECT count(*) FROM t WHERE regexp_matches(keyword, '^[0-9\\s.,-]+$') OR length(keyword) < 3) AS noisy_top, (SELECT count(*) FROM n WHERE keyword IN ({', '.join("'" + x.replace("'", "''") + "'" for x in sorted(set(lexicon.SYNONYMS.values())))})) AS synonym_hits""")
def keyword_idempotency(spark, sf_dir):
    pk = A.paper_keywords(spark, sf_dir)
    distinct = pk.select("keyword").distinct()
    again = distinct.select(X.clean_keyword(F.col("keyword")).alias("keyword")).where("keyword is not null").select("keyword", X.clean_keyword(F.col("keyword")).alias("twice"))
    return Q.acceptance(distinct, again, K.counts(pk), F.col("keyword").rlike(r"^[0-9\s.,-]+$") | (F.length("keyword") < 3), sorted(set(lexicon.SYNONYMS.values())))
