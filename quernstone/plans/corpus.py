"""Queries over raw records: structuring rules, keyword cleaning, extraction and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone import lexicon
from quernstone.functions import text as X
from quernstone.operators import extract as E
from quernstone.operators import quality as Q
from quernstone.operators import structuring
from quernstone.operators.keywords import share
from quernstone.plans import adapters as A
from quernstone.plans.adapters import SQL_COMMENTED, SQL_PK, SQL_RAW, SQL_SUB
from quernstone.plans.registry import query
from quernstone.sources.tables import table


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_KEY = "lower(trim(regexp_replace(title, '\\s+', ' ', 'g')))"


@query(f"""WITH {SQL_RAW}, k AS (SELECT raw_id, {_KEY} AS k, CASE WHEN raw_id % 5 = 0 THEN NULL ELSE 2020 + raw_id % 2 END AS y FROM raw)
    SELECT raw_id, CASE WHEN y IS NULL THEN min(raw_id) OVER (PARTITION BY k) ELSE min(raw_id) OVER (PARTITION BY k, y) END AS keep_id FROM k""")
def title_dedup(spark, sf_dir):
    rows = A.raw_papers(spark, sf_dir).select("raw_id", X.title_key(F.col("title")).alias("title_key"), F.when(F.col("raw_id") % 5 == 0, F.lit(None).cast("bigint")).otherwise(2020 + F.col("raw_id") % 2).alias("year"))
    return structuring.deduplicate(rows).select("raw_id", "keep_id")


@query("SELECT doc_id AS raw_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unprocessed_raw(spark, sf_dir):
    links = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("raw_id"))
    return structuring.unprocessed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("raw_id"), "source"), links)


_TOKENS = f"""{SQL_RAW}, w AS (SELECT unnest(string_split_regex(lower(title), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS keyword FROM raw)"""


@query(f"""WITH {_TOKENS} SELECT keyword, count(*) AS count FROM w WHERE regexp_full_match(keyword, '[a-z]{{3,}}') AND keyword NOT IN ({_in(lexicon.TITLE_STOPWORDS)})
    GROUP BY keyword ORDER BY count DESC, keyword LIMIT 100""")
def title_token_frequency(spark, sf_dir):
    return E.tokens(A.raw_papers(spark, sf_dir)).orderBy(F.desc("count"), "keyword").limit(100)


def sql_venue(column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i)" + "|".join(f"(?:{p})" for p in ps).replace("'", "''") + f"') THEN '{v}'" for v, ps in lexicon.VENUE_PATTERNS) + " END"


_VENUE = sql_venue("comments")


@query(f"""WITH {SQL_COMMENTED}, v AS (SELECT raw_id, comments, {_VENUE} AS venue FROM com)
    SELECT venue, CASE WHEN venue IS NULL THEN 0.0::DOUBLE ELSE 0.7::DOUBLE END AS confidence, CASE WHEN venue IS NULL THEN 'preprint' ELSE 'conference' END AS venue_type,
    CASE WHEN venue IS NOT NULL AND contains(lower(comments), 'accepted') THEN 'accepted' ELSE 'unknown' END AS quality_flag, count(*) AS papers FROM v GROUP BY ALL""")
def venue_match(spark, sf_dir):
    none, source = F.lit(None).cast("string"), F.lit("arxiv")
    rows = A.commented(spark, sf_dir).withColumn("v", X.detect_venue(source, none, F.col("comments"), none))
    venue = F.col("v.venue")
    out = rows.select(venue.alias("venue"), F.col("v.confidence").alias("confidence"), X.venue_kind(venue, source, none, none).alias("venue_type"), X.quality_flag(venue, source, F.col("comments")).alias("quality_flag"))
    return out.groupBy("venue", "confidence", "venue_type", "quality_flag").agg(F.count("*").alias("papers"))


def _redetect_case(column: str, from_comments: bool) -> str:
    """A struct (confidence, venue, year), or NULL."""
    hits = [(v, p.replace("'", "''")) for v, long in lexicon.VENUES_WITH_YEAR for p in X._dated_patterns(v, long)]
    case = lambda value: "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i){p}') THEN {value(v, p)}" for v, p in hits) + " END"
    venue, weight = case(lambda v, p: f"'{v}'"), case(lambda v, p: "0.8::DOUBLE" if not from_comments else "0.9::DOUBLE" if p.startswith("accepted") else "0.7::DOUBLE")
    y = "TRY_CAST(" + case(lambda v, p: f"nullif(regexp_extract({column}, '(?i){p}', 1), '')") + " AS INTEGER)"
    return f"CASE WHEN {venue} IS NOT NULL THEN {{'confidence': {weight}, 'venue': {venue}, 'year': CASE WHEN {y} < 100 THEN 2000 + {y} ELSE {y} END}} END"


@query(f"WITH {SQL_COMMENTED}, v AS (SELECT {_redetect_case('comments', True)} AS v FROM com) SELECT v.venue AS venue, v.confidence AS confidence, v.year AS year, count(*) AS papers FROM v WHERE v IS NOT NULL GROUP BY ALL")
def venue_redetect(spark, sf_dir):
    rows = A.commented(spark, sf_dir).withColumn("v", X.redetect_venue(F.col("comments"), F.lit(None).cast("string"))).where("v is not null")
    return rows.groupBy("v.venue", "v.confidence", "v.year").agg(F.count("*").alias("papers"))


def sql_domain() -> str:
    """The domain by categories, or by the lower-cased text t."""
    score = {d: " + ".join(f"contains(t, '{p.lower()}')::INT" for p in ps) for d, ps in lexicon.DOMAIN_PHRASES}
    best = "greatest(" + ", ".join(score.values()) + ")"
    category = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(categories), '{p.lower()}')" for p in ps) + f" THEN '{d}'" for d, ps in lexicon.DOMAIN_PHRASES) + " END"
    text = "CASE " + f"WHEN {best} = 0 THEN NULL " + " ".join(f"WHEN {s} = {best} THEN '{d}'" for d, s in score.items()) + " END"
    return f"coalesce({category}, {text})"


@query(f"WITH {SQL_SUB}, t AS (SELECT raw_id, categories, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS t FROM sub) SELECT {sql_domain()} AS domain, count(*) AS papers, sum(raw_id)::BIGINT AS ids FROM t GROUP BY ALL")
def domain_classify(spark, sf_dir):
    domain = X.classify_domain(F.col("categories"), F.col("title"), F.col("abstract"))
    return A.submissions(spark, sf_dir).groupBy(domain.alias("domain")).agg(F.count("*").alias("papers"), F.sum("raw_id").alias("ids"))


_RAW_KEYWORDS = "rk AS (SELECT DISTINCT unnest([p_name, upper(p_type) || '-' || p_brand || '.', '  (\"' || p_type || ' Models\")', p_size::VARCHAR || '.' || p_size::VARCHAR, 'LLMs', 'vision_transformers', 'http://x.org', 'the']) AS raw FROM part)"
_NORMAL = "nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(raw)), '[-_/]', ' ', 'g'), '[,;:.!?''\")\\]]+$', ''), '^[(\\[\"'']+', ''), '\\s+', ' ', 'g')), '')"
_LISTED = _in(sorted({*lexicon.BANNED_WORDS, *lexicon.STOPWORDS, *lexicon.DOMAIN_NOISE}))
_SYNONYM = "CASE k " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in lexicon.SYNONYMS.items()) + " ELSE k END"


@query(f"""WITH {_RAW_KEYWORDS}, n AS (SELECT raw, {_NORMAL} AS k FROM rk)
    SELECT raw, CASE WHEN k IS NULL OR length(k) < 3 OR length(k) > 60 OR regexp_matches(k, '^[0-9\\s.,-]+$') OR length(regexp_replace(k, '[^0-9]', '', 'g')) * 2 > length(k)
    OR regexp_matches(k, 'http|www|\\.com|\\.org|@') OR k IN ({_LISTED}) THEN NULL ELSE {_SYNONYM} END AS keyword FROM n""")
def keyword_normalize_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    forms = [F.col("p_name"), F.concat(F.upper("p_type"), F.lit("-"), "p_brand", F.lit(".")), F.concat(F.lit('  ("'), "p_type", F.lit(' Models")')), F.concat(size, F.lit("."), size), *map(F.lit, ("LLMs", "vision_transformers", "http://x.org", "the"))]
    raw = p.select(F.explode(F.array(*forms)).alias("raw")).distinct()
    return raw.select("raw", X.clean_keyword(F.col("raw")).alias("keyword"))


@query(f"WITH {_RAW_KEYWORDS} SELECT raw FROM rk WHERE regexp_full_match(trim(lower(raw)), '[a-z][a-z\\s-]*') AND length(trim(lower(raw))) > 2")
def valid_bucket_keywords(spark, sf_dir):
    raw = keyword_normalize_filter(spark, sf_dir).select("raw")
    return raw.where(X.valid_bucket_keyword(F.col("raw")))


_IDS = ["ICLR.cc", "NeurIPS.cc", "aclweb.org/EMNLP", "robot-learning.org", "logconference.org", "siggraph.org", "kdd.org"]
_ID_SQL = f"ids AS (SELECT DISTINCT [{_in(_IDS)}][CAST(o_orderkey % 7 AS INTEGER) + 1] || '/' || year(o_orderdate) || '/' || CASE WHEN o_orderkey % 3 = 0 THEN 'Workshop/W' ELSE 'Conference' END AS id FROM orders)"


def _venue_ids_sql() -> str:
    org = "upper(split_part(split_part(id, '/', 1), '.', 1))"
    acl = "CASE " + " ".join(f"WHEN contains(id, '{v}') THEN '{v}'" for v in ("ACL", "EMNLP", "NAACL", "COLING", "ARR")) + f" ELSE {org} END"
    name = f"CASE WHEN contains(id, 'aclweb.org') THEN {acl} WHEN contains(id, 'robot-learning.org') THEN 'CoRL' WHEN contains(id, 'logconference.org') THEN 'LOG' ELSE {org} END"
    domain = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(id) || ' ' || lower(name), '{p.lower()}')" for p in ps) + f" THEN '{d}'" for d, ps in lexicon.VENUE_DOMAINS) + " ELSE 'General' END"
    tier = "CASE " + " ".join(f"WHEN name IN ({_in(ns)}) THEN '{t}'" for t, ns in lexicon.VENUE_TIERS.items()) + " ELSE 'C' END"
    full = "CASE name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in lexicon.VENUE_FULL_NAMES.items()) + " ELSE name END"
    return f"""WITH {_ID_SQL}, n AS (SELECT id, {name} AS name, CAST(regexp_extract(id, '/([0-9]{{4}})/', 1) AS INTEGER) AS year, contains(id, 'Workshop') AS is_workshop FROM ids)
        SELECT id, name, year, is_workshop, {domain} AS domain, {tier} AS tier, {full} AS full_name FROM n"""


def _venue_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    org = F.element_at(F.array(*[F.lit(i) for i in _IDS]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "Workshop/W").otherwise("Conference")
    ids = o.select(F.concat_ws("/", org, F.year("o_orderdate").cast("string"), kind).alias("id")).distinct()
    return ids.withColumn("v", X.parse_venue_id(F.col("id"))).where("v is not null")


@query(_venue_ids_sql())
def venue_id_parse(spark, sf_dir):
    n = F.col("v.name")
    return _venue_ids(spark, sf_dir).select("id", "v.name", "v.year", "v.is_workshop", X.venue_domain(F.col("id"), n).alias("domain"), X.venue_tier(n).alias("tier"), X.venue_full_name(n).alias("full_name"))


@query(f"WITH v AS ({_venue_ids_sql()}) SELECT domain, tier, count(DISTINCT name) AS venues, string_agg(DISTINCT name, '|' ORDER BY name) AS names, min(year) AS first_year, max(year) AS last_year FROM v GROUP BY ALL")
def venues_by_domain(spark, sf_dir):
    rows = venue_id_parse(spark, sf_dir)
    return rows.groupBy("domain", "tier").agg(F.count_distinct("name").alias("venues"), F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


_REGISTRY_SQL = "reg(name, domain, years) AS (VALUES " + ", ".join(f"('{n}', '{d}', {len(ys)}::BIGINT)" for n, (d, ys) in lexicon.REGISTRY.items()) + ")"


@query(f"""WITH {_REGISTRY_SQL}, v AS ({_venue_ids_sql()}), c AS (SELECT name, count(*) AS n FROM v GROUP BY name)
    SELECT name, domain, years, coalesce(n, 0) AS paper_count FROM reg LEFT JOIN c USING (name)""")
def registry_venues(spark, sf_dir):
    reg = spark.createDataFrame([(n, d, len(ys)) for n, (d, ys) in lexicon.REGISTRY.items()], "name string, domain string, years bigint")
    counted = venue_id_parse(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"))
    return reg.join(counted, "name", "left").select("name", "domain", "years", F.coalesce("n", F.lit(0)).alias("paper_count"))


# ------------------------------------------------------------ quality

_PCT = "round(count(*) FILTER ({c} IS NOT NULL AND {c} <> '') * 100.0 / count(*), 2)::DOUBLE"


@query(f"WITH {SQL_RAW} SELECT count(*) AS rows, {_PCT.format(c='title')} AS title_pct, {_PCT.format(c='abstract')} AS abstract_pct, {_PCT.format(c='categories')} AS categories_pct FROM raw")
def completeness(spark, sf_dir):
    return Q.completeness(A.raw_papers(spark, sf_dir), ["title", "abstract", "categories"])


_DUP = f"d AS (SELECT count(*) AS n FROM raw GROUP BY {_KEY})"


@query(f"WITH {SQL_RAW}, {_DUP} SELECT sum(n)::BIGINT AS rows, count(*) FILTER (n > 1) AS groups, coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS extra FROM d")
def duplicates(spark, sf_dir):
    return Q.duplicates(A.raw_papers(spark, sf_dir), [X.title_key(F.col("title"))])


@query(f"WITH {SQL_RAW} SELECT count(*) AS rows, count(*) FILTER (1985 + raw_id % 45 < 1990 OR 1985 + raw_id % 45 > 2027) AS bad_years, count(*) FILTER (length(title) < 10) AS short_titles, count(*) FILTER (length(title) > 500) AS long_titles FROM raw")
def anomalies(spark, sf_dir):
    rows = A.raw_papers(spark, sf_dir)
    return Q.anomalies(rows, 1985 + F.col("raw_id") % 45, F.col("title"), 2026)


@query(f"""WITH {SQL_RAW} SELECT source, count(*) AS rows, sum(CASE WHEN abstract IS NULL OR abstract = '' THEN 1 ELSE 0 END)::BIGINT AS missing_abstracts, round(avg(length(title)), 4) AS mean_title,
    round(count(*) * 100.0 / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM raw GROUP BY source""")
def source_quality(spark, sf_dir):
    per = A.raw_papers(spark, sf_dir).groupBy("source").agg(F.count("*").alias("rows"), F.count_if(X.blank(F.col("abstract"))).alias("missing_abstracts"), F.round(F.avg(F.length("title")), 4).alias("mean_title"))
    return per.select("*", share("rows"))


_DQ = f"""{SQL_RAW}, {_DUP}, g AS (SELECT count(*) FILTER (n > 1) * 100.0 / sum(n) AS dup FROM d),
    m AS (SELECT {_PCT.format(c='title')} AS t, {_PCT.format(c='abstract')} AS a, count(*) FILTER (length(title) < 10 OR length(title) > 500) * 100.0 / count(*) AS bad FROM raw),
    c AS (SELECT 'title' AS name, t AS value, 99.0::DOUBLE AS threshold, t >= 99 AS passed FROM m UNION ALL SELECT 'abstract', a, 95.0, a >= 95 FROM m
    UNION ALL SELECT 'duplicate titles', round(dup, 4)::DOUBLE, 3.0, round(dup, 4) <= 3 FROM g UNION ALL SELECT 'odd titles', round(bad, 4)::DOUBLE, 1.0, round(bad, 4) <= 1 FROM m)"""


@query(f"WITH {_DQ} SELECT * FROM c")
def dq_report(spark, sf_dir):
    raw = A.raw_papers(spark, sf_dir)
    title = F.length("title")
    odd = raw.agg(F.round(F.count_if((title < 10) | (title > 500)) * 100.0 / F.greatest(F.count("*"), F.lit(1)), 4).alias("odd"))
    dup = duplicates(spark, sf_dir).select(F.round(F.col("groups") * 100.0 / F.greatest("rows", F.lit(1)), 4).alias("dup"))
    measures = completeness(spark, sf_dir).join(F.broadcast(odd)).join(F.broadcast(dup))
    return Q.report(measures, [Q.check("title", F.col("title_pct"), 99), Q.check("abstract", F.col("abstract_pct"), 95), Q.check("duplicate titles", F.col("dup"), 3, False), Q.check("odd titles", F.col("odd"), 1, False)])


@query(f"WITH {_DQ}, s AS (SELECT count(*) AS checks, count(*) FILTER (passed) AS passed FROM c) SELECT checks, passed, round(passed * 100.0 / checks, 1)::DOUBLE AS pass_rate, CASE WHEN passed * 100.0 / checks >= 95 THEN 'A' WHEN passed * 100.0 / checks >= 80 THEN 'B' ELSE 'C' END AS grade FROM s")
def dq_grade(spark, sf_dir):
    return Q.grade(dq_report(spark, sf_dir))


@query(f"""WITH {SQL_PK}, n AS (SELECT paper_id, count(*) AS n FROM pk GROUP BY paper_id) SELECT round((SELECT count(*) FROM n) * 100.0 / (SELECT count(*) FROM orders), 2)::DOUBLE AS coverage,
    (SELECT round(avg(n), 4) FROM n) AS mean_keywords, (SELECT count(*) FROM pk WHERE regexp_matches(keyword, '^[0-9\\s.,-]+$')) AS numeric_keywords, (SELECT count(*) FROM pk WHERE keyword IN ({_LISTED})) AS listed_keywords""")
def keyword_acceptance(spark, sf_dir):
    pk = A.paper_keywords(spark, sf_dir)
    k = F.col("keyword")
    per = pk.groupBy("paper_id").agg(F.count("*").alias("n"), F.count_if(k.rlike(r"^[0-9\s.,-]+$")).alias("num"), F.count_if(X.listed_keyword(k)).alias("listed"))
    agg = per.agg(F.count("*").alias("papers"), F.round(F.avg("n"), 4).alias("mean_keywords"), F.coalesce(F.sum("num"), F.lit(0)).alias("numeric_keywords"), F.coalesce(F.sum("listed"), F.lit(0)).alias("listed_keywords"))
    total = table(spark, sf_dir, "orders").agg(F.count("*").alias("all"))
    return agg.join(F.broadcast(total)).select(F.round(F.col("papers") * 100.0 / F.greatest("all", F.lit(1)), 2).cast("double").alias("coverage"), "mean_keywords", "numeric_keywords", "listed_keywords")


# ------------------------------------------------------------ extraction


@query("SELECT doc_id AS raw_id, text AS abstract FROM documents")
def inverted_index_abstract(spark, sf_dir):
    """Each whole text as an inverted index, and back."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("raw_id"), "text")
    words = docs.select("raw_id", F.posexplode_outer(F.split("text", " ")).alias("p", "w"))
    places = words.groupBy("raw_id", "w").agg(F.collect_list("p").alias("ps"))
    index = places.groupBy("raw_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("w", "ps")))).alias("index"))
    return index.select("raw_id", F.when(F.size("index") > 0, E.abstract_of(F.col("index"))).alias("abstract"))


@query()
def fuzzy_dedup(spark, sf_dir):
    """Each paper's keywords by falling score, without those too like a kept one."""
    items = F.array_sort(F.collect_list(F.struct("score", "keyword")))
    per = A.paper_keywords(spark, sf_dir).groupBy("paper_id").agg(F.transform(items, lambda x: F.struct(x["keyword"].alias("keyword"), x["score"].alias("score"))).alias("items"))
    return E.deduplicated(per)


def _documents(spark, sf_dir):
    return A.raw_papers(spark, sf_dir).select(F.col("raw_id").alias("paper_id"), "title", "abstract")


@query()
def yake_keywords(spark, sf_dir):
    return E.extract(_documents(spark, sf_dir), "yake")


@query()
def keyphrase_embedding(spark, sf_dir):
    return E.extract(_documents(spark, sf_dir), "keybert")


@query(f"WITH {SQL_RAW}, k AS (SELECT coalesce({_KEY}, '') AS k FROM raw) SELECT count(*) AS processed, count(*) FILTER (k = '') AS failed, count(DISTINCT k) FILTER (k <> '') AS success, count(*) FILTER (k <> '') - count(DISTINCT k) FILTER (k <> '') AS merged FROM k")
def structured_batch(spark, sf_dir):
    none = F.lit(None).cast("string")
    raw = A.raw_papers(spark, sf_dir).withColumns({"venue_raw": none, "comments": F.col("abstract"), "journal_ref": none, "year": F.lit(None).cast("int")})
    return structuring.structure(raw).counters
