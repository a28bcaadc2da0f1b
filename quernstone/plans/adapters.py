"""The engine's tables over the driver's, and the same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import first_line
from quernstone.sources.tables import table

#: Comments as authors write them, dealt to orders by key; they exercise the venue rules.
COMMENTS = [
    "Accepted at NeurIPS 2023", "ICLR 2024 camera ready", "to appear in Computer Vision and Pattern Recognition 2022", "12 pages, 5 figures", "accepted by ICML", "NAACL 2022 main conference", "Published at ACL 2021",
    "accepted to EMNLP 23", "AAAI'24 oral", "journal version", "Conference on Robot Learning", "NIPS 2016 workshop", "submitted", "IJCAI 2020",
]


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("venue")), "o_custkey")
    return rows.select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("year"), "venue", F.col("o_orderdate").cast("timestamp").alias("published_at"), F.col("o_orderstatus").alias("quality_flag"))


def paper_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each paper, keyword and method, with the largest score."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    named = lines.join(part.select(F.col("p_partkey").alias("l_partkey"), F.lower(F.trim("p_name")).alias("keyword")), "l_partkey")
    return named.groupBy(F.col("l_orderkey").alias("paper_id"), "keyword", F.col("l_returnflag").alias("method")).agg(F.max("l_discount").alias("score"))


def paper_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("raw_id")).agg(F.min("l_linestatus").alias("source"))


def raw_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    title = first_line(F.coalesce("text", F.lit("")))
    return docs.select(F.col("doc_id").alias("raw_id"), "source", title.alias("title"), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("abstract"), F.col("lang").alias("categories"), "n_chars")


def commented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw_id, comments): an order's comment."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("raw_id"))
    return orders.withColumn("comments", F.element_at(F.array(*[F.lit(c) for c in COMMENTS]), (F.col("raw_id") % len(COMMENTS) + 1).cast("int")))


#: Journal references, categories and stated venues, dealt to documents by key.
JOURNALS = [None, "Journal of Computer Vision", "Proc. ICML 2019", "AAAI 21 proceedings", ""]
CATEGORIES = ["cs.CV", "cs.CL,stat.ML", "article", None, "math.CO"]
STATED = ["NeurIPS 2023", "A small workshop", ""]


def _dealt(values: list, key: str = "raw_id"):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw records of four sources, with all that the structuring rules look at."""
    rows = raw_papers(spark, sf_dir).select("raw_id", "title", "abstract").withColumn("source", _dealt(["openreview", "arxiv", "openalex", "s2"]))
    stated = F.when(F.col("source") == "openreview", "ICLR").when(F.col("source") == "s2", _dealt(STATED))
    year = F.when(F.col("raw_id") % 7 != 0, (2018 + F.col("raw_id") % 6).cast("int"))
    return rows.withColumns({"venue_raw": stated, "comments": _dealt(COMMENTS), "journal_ref": _dealt(JOURNALS), "categories": _dealt(CATEGORIES), "year": year})


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(venue_id, name, domain, tier): suppliers as venues."""
    v = table(spark, sf_dir, "supplier")
    domain = F.when(F.col("s_nationkey") % 3 > 0, F.concat(F.lit("D"), (F.col("s_nationkey") % 3).cast("string")))
    return v.select(F.col("s_suppkey").alias("venue_id"), F.col("s_name").alias("name"), domain.alias("domain"), F.when(F.col("s_acctbal") > 6000, "A").when(F.col("s_acctbal") > 2000, "B").otherwise("C").alias("tier"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, ts, category, keyword, user_id)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("paper_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("category"), F.get_json_object("props", "$.k").alias("keyword"), "user_id")


SQL_PAPERS = """papers AS (
    SELECT o_orderkey AS paper_id, CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment AS venue, o_orderdate AS published_at, o_orderstatus AS quality_flag
    FROM orders JOIN customer ON o_custkey = c_custkey)"""
SQL_PK = """pk AS (
    SELECT l_orderkey AS paper_id, lower(trim(p_name)) AS keyword, l_returnflag AS method, max(l_discount) AS score
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
SQL_KP = f"""{SQL_PAPERS}, {SQL_PK}, kp AS (SELECT keyword, method, venue, year FROM pk JOIN papers USING (paper_id))"""
SQL_SOURCES = """ps AS (SELECT l_orderkey AS paper_id, l_partkey AS raw_id, min(l_linestatus) AS source FROM lineitem GROUP BY ALL)"""
SQL_EVENTS = """ev AS (SELECT event_id AS paper_id, ts, event_type AS category, json_extract_string(props, '$.k') AS keyword, user_id FROM events)"""
SQL_RAW = """raw AS (
    SELECT doc_id AS raw_id, source, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS abstract, lang AS categories, n_chars FROM documents)"""
_LIST = ", ".join("'" + c.replace("'", "''") + "'" for c in COMMENTS)
SQL_COMMENTED = f"""com AS (SELECT o_orderkey AS raw_id, [{_LIST}][CAST(o_orderkey % {len(COMMENTS)} AS INTEGER) + 1] AS comments FROM orders)"""


def sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


SQL_SUB = f"""sub AS (SELECT doc_id AS raw_id, ['openreview', 'arxiv', 'openalex', 's2'][CAST(doc_id % 4 AS INTEGER) + 1] AS source, split_part(coalesce(text, ''), chr(10), 1) AS title,
    substr(text, length(split_part(text, chr(10), 1)) + 2) AS abstract, CASE doc_id % 4 WHEN 0 THEN 'ICLR' WHEN 3 THEN {sql_list(STATED)}[CAST(doc_id % {len(STATED)} AS INTEGER) + 1] END AS venue_raw,
    {sql_list(COMMENTS)}[CAST(doc_id % {len(COMMENTS)} AS INTEGER) + 1] AS comments, {sql_list(JOURNALS)}[CAST(doc_id % {len(JOURNALS)} AS INTEGER) + 1] AS journal_ref,
    {sql_list(CATEGORIES)}[CAST(doc_id % {len(CATEGORIES)} AS INTEGER) + 1] AS categories, CASE WHEN doc_id % 7 <> 0 THEN CAST(2018 + doc_id % 6 AS INTEGER) END AS year FROM documents)"""
SQL_VENUES = """ven AS (SELECT s_suppkey AS venue_id, s_name AS name, CASE WHEN s_nationkey % 3 > 0 THEN 'D' || (s_nationkey % 3) END AS domain, CASE WHEN s_acctbal > 6000 THEN 'A' WHEN s_acctbal > 2000 THEN 'B' ELSE 'C' END AS tier FROM supplier)"""
