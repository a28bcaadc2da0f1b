"""Every query that has SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import duckdb
import pytest

from quernstone.functions import udfs
from quernstone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(want.columns, want.fetchall())


def plain_keyword(k):
    """The cleaning rules one by one, in Python."""
    from quernstone import lexicon

    k = re.sub(r"[-_/]", " ", k.lower().strip())
    k = re.sub("[,;:.!?'\")\\]]+$", "", k)
    k = re.sub(r"\s+", " ", re.sub("^[(\\[\"']+", "", k)).strip()
    digits = sum(c in "0123456789" for c in k)
    if len(k) < 3 or len(k) > 60 or re.fullmatch(r"[0-9\s.,-]+", k) or 2 * digits > len(k) or re.search(r"http|www|\.com|\.org|@", k):
        return None
    return None if k in {*lexicon.BANNED_WORDS, *lexicon.STOPWORDS, *lexicon.DOMAIN_NOISE} else lexicon.SYNONYMS.get(k, k)


def plain_dedup(items):
    kept = []
    for k, s in sorted(items, key=lambda x: -x[1]):
        if all(k.rstrip("s") != x.rstrip("s") and SequenceMatcher(None, k, x).ratio() < 0.85 for x, _ in kept):
            kept.append((k, s))
    return kept


@pytest.mark.parametrize(("name", "extractor"), [("yake_keywords", udfs.statistical_phrases), ("keyphrase_embedding", udfs.embedded_phrases)])
def test_extraction_by_plain_loops(spark, duck, sf_dir, name, extractor):
    got = {}
    for r in registry.QUERIES[name](spark, sf_dir).collect():
        got.setdefault(r["paper_id"], []).append((r["keyword"], round(r["score"], 9)))
    for doc_id, text in duck.sql("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id LIMIT 60").fetchall():
        title, _, abstract = text.partition("\n")
        best = {}
        for k, s in extractor(f"{title}. {abstract}") if len(f"{title}. {abstract}") >= 10 else []:
            if (c := plain_keyword(k)) is not None:
                best[c] = max(best.get(c, s), s)
        assert got.get(doc_id, []) == [(k, round(s, 9)) for k, s in plain_dedup(list(best.items()))[:10]]


def test_fuzzy_dedup_by_plain_loops(spark, duck, sf_dir):
    got = {}
    for r in registry.QUERIES["fuzzy_dedup"](spark, sf_dir).collect():
        got.setdefault(r["paper_id"], set()).add((r["keyword"], r["score"]))
    rows = duck.sql("SELECT l_orderkey, lower(trim(p_name)), max(l_discount) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, 2, l_returnflag ORDER BY 1, 3, 2").fetchall()
    papers = {}
    for paper, k, s in rows:
        papers.setdefault(paper, []).append((k, s))
    assert got == {p: set(plain_dedup(items)) for p, items in papers.items()}


def test_phrases_of_buckets_by_plain_loops(spark, duck, sf_dir):
    from quernstone import lexicon

    got = sorted(tuple(r) for r in registry.QUERIES["bucket_keyword_phrases"](spark, sf_dir).select("bucket", "keyword", "count", "tier").collect())
    valid = lambda k: re.fullmatch(r"[a-z][a-z\s-]*", k.lower().strip()) and len(k.strip()) > 2
    united, words = {}, {}
    for lang, source, text in duck.sql("SELECT lang, source, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall():
        bucket = " ".join(x for x in (lang, source) if x is not None)
        title, _, abstract = text.partition("\n")
        united.setdefault(bucket, []).append(f"{title}. {abstract}")
        for w in re.split(r"[^\w]+", title.lower()):
            if re.fullmatch("[a-z]{3,}", w) and w not in lexicon.TITLE_STOPWORDS:
                words.setdefault(bucket, Counter())[w] += 1
    want = []
    for bucket, texts in united.items():
        first = sorted(k for k, _ in udfs.statistical_phrases("\n".join(texts), top=20) if valid(k))[:10]
        want += [(bucket, k, 1, 0) for k in first] or [(bucket, k, n, 1) for k, n in sorted(words.get(bucket, {}).items(), key=lambda x: (-x[1], x[0]))[:10]]
    assert got == sorted(want)


def test_queries_without_sql_are_those_tested_here():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"yake_keywords", "keyphrase_embedding", "fuzzy_dedup", "bucket_keyword_phrases"}


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Documents whose keywords stand below the first line, or that have no text."""
    at = str(tmp_path_factory.mktemp("texts"))
    below = "A plain first line\n" + "Quantum annealing solves lattice problems. " * 30
    rows = [(1, below, "en", "arxiv", 1), (2, None, "en", "arxiv", 0), (3, "", "en", "arxiv", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["yake_keywords", "keyphrase_embedding"])
def test_keywords_below_the_first_line(spark, texts, name):
    found = {r["keyword"] for r in registry.QUERIES[name](spark, texts).where("paper_id = 1").collect()}
    assert any("annealing" in k or "lattice" in k for k in found)


def test_comments_are_whole(spark, texts, monkeypatch):
    from quernstone.operators import structuring

    seen, structure = [], structuring.structure
    monkeypatch.setattr(structuring, "structure", lambda raw: seen.append(raw) or structure(raw))
    long = spark.read.parquet(f"{texts}/documents.parquet").where("doc_id = 1").selectExpr("1000 AS doc_id", "concat(text, repeat('x', 3000)) AS text", "lang", "source", "n_chars")
    long.write.parquet(f"{texts}/long/documents.parquet")
    registry.QUERIES["structured_batch"](spark, f"{texts}/long")
    assert seen[0].where("comments = abstract and length(comments) > 2000").count() == 1


def test_an_index_of_no_text(spark, texts):
    got = {r["raw_id"]: r["abstract"] for r in registry.QUERIES["inverted_index_abstract"](spark, texts).collect()}
    whole = spark.read.parquet(f"{texts}/documents.parquet").where("doc_id = 1").first()["text"]
    assert got == {1: whole, 2: None, 3: ""}


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
