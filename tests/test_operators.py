"""Operators on small frames, with the cases that the driver's tables lack."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quernstone.operators import extract, filters, quality, structuring, upsert
from quernstone.operators import keywords as K
from quernstone.operators import series as S
from quernstone.sources import payloads
from quernstone.sources.tables import registry
from quernstone.streaming import series as stream


@pytest.fixture(scope="module")
def tables(spark):
    """Three papers over two venues and years; each keyword list as its author gave it."""
    papers = spark.createDataFrame([(1, 2023, "ICLR"), (2, 2024, "ICLR"), (3, 2024, "NeurIPS")], "paper_id bigint, year int, venue string")
    pk = [(1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, "d"), (3, "b"), (3, "e"), (3, "f")]
    return papers, spark.createDataFrame([(p, k, "author", 0.5) for p, k in pk] + [(1, "b", "yake", 0.9)], "paper_id bigint, keyword string, method string, score double")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_top_and_filters(tables):
    papers, pk = tables
    assert rows(K.top(K.of_papers(pk, papers), 2)) == [("b", 4), ("a", 1)]
    assert rows(K.top(K.of_papers(pk, papers, venue="ICLR", method="author"), 1)) == [("b", 2)]
    assert K.of_papers(pk, papers, venue="", year=0).count() == 9
    assert K.of_papers(pk, papers, venue="none").count() == 0


def test_growth(spark):
    trend = spark.createDataFrame([("up", 2020, 10), ("up", 2021, 20), ("down", 2020, 10), ("down", 2022, 5), ("zero", 2020, 0), ("zero", 2021, 5), ("one", 2020, 3)], "keyword string, year int, count bigint")
    assert {r["keyword"]: r["growth_rate"] for r in K.growth(trend).collect()} == {"up": 1.0, "down": -0.5, "zero": 0.0, "one": 0.0}


def test_grid_is_dense(tables):
    papers, pk = tables
    grid = K.trend_grid(K.of_papers(pk, papers), ["venue"])
    assert grid.where("venue = 'ICLR'").count() == 8  # four keywords on two years
    assert rows(grid.where("venue = 'ICLR' AND keyword = 'a'").select("year", "count", "rank"), "year") == [(2023, 1, 2), (2024, 0, 0)]  # after b, which two methods found


def test_emerging_new_and_growing(spark):
    papers = spark.createDataFrame([(i, 2022 + i // 10, "v") for i in range(30)], "paper_id bigint, year int, venue string")
    pk = [(i, "new") for i in range(20, 26)] + [(i, "old") for i in range(0, 30)] + [(i, "up") for i in (0, 10, *range(20, 28))]
    kw = spark.createDataFrame([(p, k, "m", 0.1) for p, k in pk], "paper_id bigint, keyword string, method string, score double")
    found = rows(K.emerging(K.of_papers(kw, papers), papers))
    assert [f[0] for f in found] == ["new", "up"] and found[0][2] and found[0][3] == float("inf") and found[1][3] == pytest.approx(8.0)
    detailed = rows(K.emerging_detailed(K.of_papers(kw, papers), papers))
    assert detailed[0][:2] == ("new", None) and detailed[0][2] == "2024=6"


def test_emerging_topics(spark):
    data = [("c", f"2024-W{w:02d}", "up", n) for w, n in enumerate([1, 1, 2, 2], 1)] + [("c", f"2024-W{w:02d}", "late", 3) for w in (3, 4)] + [("d", "2024-W01", "up", 1)]
    counted = spark.createDataFrame(data, "category string, bucket string, keyword string, count bigint")
    got = {r["keyword"]: r for r in S.emerging_topics(counted, window=2).collect()}
    assert set(got) == {"up", "late"} and got["up"]["growth_rate"] == 2.0 and got["late"]["growth_rate"] == 30.0 and got["up"]["first_seen"] == "2024-W01"


def test_sets(spark):
    sets = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "z")], "category string, keyword string")
    assert rows(S.overlap(sets)) == [(1, 3, 0.33, "x")]
    assert rows(S.only_in(sets), "category") == [("a", "y", 1), ("b", "z", 1)]
    assert S.only_in(sets.where("category = 'a'")).count() == 2
    assert rows(S.overlap(sets.limit(0))) == [(0, 0, 0.0, "")]


def test_category_membership(spark):
    records = spark.createDataFrame([("cs.LG stat.ML",), ("cs.CV",), (None,)], "categories string")
    assert rows(S.category_counts(records, ["CS.lg", "stat.ML", "cs.AI"]), "category") == [("CS.lg", 1), ("stat.ML", 1)]
    assert records.where(filters.in_category(F.col("categories"), "ALL")).count() == 3


def test_dedup_without_year(spark):
    raw = spark.createDataFrame([(1, "k", 2020), (2, "k", None), (3, "k", 2021), (4, "k", 2020), (5, "m", None), (6, "m", 2020), (7, "m", None)], "raw_id bigint, title_key string, year int")
    assert dict(rows(structuring.deduplicate(raw).select("raw_id", "keep_id"))) == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6, 7: 5}


def test_structure(spark):
    raw = spark.createDataFrame(
        [(1, "arxiv", "A  Title", "image", 2020, None, "accepted at ICML 2020", None, "cs.CV"), (2, "openreview", "a title", "", 2020, "ICML", None, None, None), (3, "s2", " ", None, 2020, None, None, None, None)],
        "raw_id bigint, source string, title string, abstract string, year int, venue_raw string, comments string, journal_ref string, categories string",
    )
    done = structuring.structure(raw)
    assert rows(done.papers.select("canonical_title", "venue", "quality_flag")) == [("a title", "ICML", "accepted")]
    assert done.links.count() == 2 and rows(done.rejects) == [(3, "s2")] and rows(done.counters) == [(3, 1, 1, 1)]
    assert structuring.structure(raw, done.links).papers.count() == 0


def test_upserts(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    once = upsert.upsert(old, new, ["k"], [F.col("n")])
    assert rows(once.select("k", "v"), "k") == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(upsert.upsert(once, new, ["k"], [F.col("n")]), "k") == rows(once, "k")
    assert rows(upsert.first_wins(old, new, ["k"], [F.col("n")]).select("k", "v"), "k") == [(1, "a"), (2, "b"), (3, "e")]
    t = upsert.Table(spark, f"file://{tmp_path}/t")
    t.upsert(old, ["k"], [F.col("n")])
    t.upsert(new, ["k"], [F.col("n")])
    assert rows(t.read().select("k", "v"), "k") == [(1, "a"), (2, "d"), (3, "e")]


def test_merge_venues(spark):
    a = spark.createDataFrame([("X", ["i"], [2020, 2021])], "name string, ids array<string>, years array<int>")
    b = spark.createDataFrame([("X", ["j"], [2022]), ("Y", ["k"], [2019])], "name string, ids array<string>, years array<int>")
    assert rows(upsert.merge_venues(a, b), "name") == [("X", ["i", "j"], [2022, 2021, 2020], 2020, 2022), ("Y", ["k"], [2019], 2019, 2019)]


def test_quality(spark):
    df = spark.createDataFrame([("a", None), ("", "x"), ("A", "y")], "t string, u string")
    assert rows(quality.completeness(df, ["t", "u"])) == [(3, 66.67, 66.67)]
    assert rows(quality.duplicates(df, [F.lower("t")])) == [(3, 1, 1)]
    assert rows(quality.completeness(df.limit(0), ["t"])) == [(0, 0.0)]
    checks = quality.report(quality.completeness(df, ["t"]), [quality.check("t", F.col("t_pct"), 50), quality.check("n", F.col("rows"), 2, False)])
    assert rows(quality.grade(checks)) == [(2, 1, 50.0, "C")]


def test_extract(spark):
    papers = spark.createDataFrame([(1, "Graph networks for robots", "Graph networks let robots plan. Robots plan."), (2, "", None)], "paper_id bigint, title string, abstract string")
    found = extract.extract(papers, "both")
    assert {r["paper_id"] for r in found.collect()} == {1} and found.groupBy("method").count().count() == 2


def test_abstract_from_index(spark):
    df = spark.createDataFrame([({"a": [0, 3], "b": [1]},), ({},), (None,)], "m map<string,array<int>>")
    assert [r[0] for r in df.select(extract.abstract_of(F.col("m"))).collect()] == ["a b  a", "", ""]


def test_payloads(spark):
    arxiv = '{"id": "http://x/abs/2401.00001v2", "title": "A\\nB ", "summary": "s", "published": "2024-01-02T00:00:00Z", "authors": ["X", ""], "categories": ["cs.LG", "cs.AI"]}'
    got = payloads.arxiv(spark.createDataFrame([(arxiv,), ("junk",)], "payload string"))
    r = payloads.accepted(got).first()
    assert (r["source_paper_id"], r["title"], r["year"], r["authors"], r["categories"], r["published_at"]) == ("2401.00001", "A B", 2024, ["X"], "cs.LG,cs.AI", dt.datetime(2024, 1, 2))
    assert payloads.rejects(got).count() == 1
    note = '{"id": "n1", "content": {"title": {"value": "T"}, "keywords": {"value": ["k", "l"]}, "authors": ["A"]}}'
    r = payloads.openreview(spark.createDataFrame([(note,)], "payload string"), "ICLR", 2024).first()
    assert (r["source_paper_id"], r["title"], r["comments"], r["authors"]) == ("n1", "T", "k,l", ["A"])
    work = '{"id": "https://o/W1", "display_name": "", "title": "T", "doi": "https://doi.org/10/x", "abstract_inverted_index": {"b": [1], "a": [0]}, "concepts": []}'
    r = payloads.openalex(spark.createDataFrame([(work,)], "payload string")).first()
    assert (r["source_paper_id"], r["title"], r["doi"], r["abstract"]) == ("W1", "T", "10/x", "a b")


def test_registry_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text('canonical_name,full_name,domain,tier,source_preference,openreview_id_pattern,s2_venue_key,openalex_venue_name,aliases\nX,Full,ML,A,s2,,X,X,"a, b,"\n')
    assert registry(spark, f"file://{tmp_path}/r.csv").first()["aliases"] == ["a", "b"]


def test_stream_upserts_windows(spark, tmp_path):
    events = spark.createDataFrame([(dt.datetime(2024, 1, d, 5), "c") for d in (1, 1, 2)], "ts timestamp, category string")
    events.write.parquet(f"{tmp_path}/in")
    table = upsert.Table(spark, f"file://{tmp_path}/out")
    for _ in range(2):
        source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
        stream.into_table(stream.windowed(source), table, f"{tmp_path}/cp", ["start", "category"]).awaitTermination()
        assert [r["count"] for r in table.read().orderBy("start").collect()] == [2, 1]
