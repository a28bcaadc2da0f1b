"""Feeds, batches, versioned tables, files and streams, on small frames."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.operators import batch as B
from quernstone.operators import export, filters, series, upsert
from quernstone.operators import lookups as L
from quernstone.operators import quality as Q
from quernstone.sources import feeds
from quernstone.sources.tables import landing, static_json
from quernstone.streaming import series as stream


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_search_text_and_filters():
    assert feeds.arxiv_expression(["cs.LG", "stat.ML"], "graph") == "(cat:cs.LG OR cat:stat.ML) AND (graph)"
    assert feeds.arxiv_expression([], "graph") == "(graph)" and feeds.arxiv_expression(["cs.CV"]) == "(cat:cs.CV)"
    assert feeds.works_filter(venue="V", year=2020, type=None) == "venue:V,year:2020"


def test_runs_are_planned_by_source():
    known = {"ICLR": [2024, 2022], "NeurIPS": [2023]}
    plan = feeds.plan_run(["openreview", "arxiv", "openalex", "s2"], known, categories=["cs.LG"])
    assert plan == [{"source": "openreview", "venue": "ICLR", "year": 2024}, {"source": "openreview", "venue": "NeurIPS", "year": 2023}, {"source": "arxiv", "search": "(cat:cs.LG)"}]
    assert feeds.plan_run(["s2", "openreview"], known, ["ICLR"], [2022, 2021]) == [{"source": "s2", "venue": "ICLR", "year": y} for y in (2022, 2021)] + [{"source": "openreview", "venue": "ICLR", "year": 2022}]
    assert feeds.plan_run(["openalex"], known, ["ICLR"]) == []
    with pytest.raises(ValueError):
        feeds.plan_run(["x"], known)


def test_lists_can_be_given(spark):
    one = lambda k, **kw: spark.range(1).select(X.clean_keyword(F.lit(k), **kw).alias("x")).first()["x"]
    assert one("Methods") is None and one("Methods", words=["other"]) == "methods" and one("other", words=["other"]) is None
    assert one("RL", least=2, synonyms={"rl": "reinforcement"}) == "reinforcement" and one("abcdef", most=5) is None


def test_pages_stop_where_few_are_recent(spark):
    at = lambda day: dt.datetime(2024, 6, day)
    data = [(i, at(10) if i < 5 or i in (6, 8) else at(1), 2023) for i in range(8)] + [(8, at(10), 2023), (9, None, 2024)]
    feed = spark.createDataFrame(data, "place bigint, retrieved_at timestamp, year int")
    kept = rows(feeds.until_stale(feed, F.lit("2024-06-05").cast("timestamp"), page=4), "place")
    assert [r[0] for r in kept] == [0, 1, 2, 3, 4, 6, 8, 9]  # half of the second page is recent: it goes on
    kept = rows(feeds.until_stale(feed.where("place <> 6"), F.lit("2024-06-05").cast("timestamp"), page=4), "place")
    assert [r[0] for r in kept] == [0, 1, 2, 3, 4]
    assert feeds.until_stale(feed.limit(0), F.current_timestamp()).count() == 0


def test_fallback_and_ids(spark):
    notes = spark.createDataFrame([("a", "Submission", 1), ("a", "Blind", 2), ("b", "Submission", 3), ("c", "Other", 4)], "venue string, invitation string, id int")
    assert rows(feeds.with_fallback(notes, ["Blind", "Submission"]).select("venue", "id"), "venue") == [("a", 2), ("b", 3)]
    assert rows(feeds.of_ids(notes.withColumn("source_paper_id", F.col("id").cast("string")), ["3"]).select("venue")) == [("b",)]


def test_batch_of_keywords_is_idempotent(spark):
    text = "Quantum annealing solves lattice problems. Lattice problems are solved by quantum annealing."
    papers = spark.createDataFrame([(1, "Quantum annealing", text), (2, "", ""), (3, "Lattice problems", text)], "paper_id bigint, title string, abstract string")
    pk = spark.createDataFrame([(3, "lattice", "yake", 0.5), (1, "x", "author", 1.0)], "paper_id bigint, keyword string, method string, score double")
    table, found = B.keyword_batch(papers, pk)
    assert {r["paper_id"] for r in found.collect()} == {1} and table.where("paper_id = 3").count() == 1
    again, new = B.keyword_batch(papers, table)
    assert new.count() == 0 and again.exceptAll(table).count() == 0
    assert rows(B.needs_keywords(papers, table, "yake", 1).select("paper_id")) == [(2,)]


def test_keywords_are_normal_and_replaced(spark):
    schema = "paper_id bigint, keyword string, method string, score double"
    pk = spark.createDataFrame([(1, "a b", "m", 0.1)], schema)
    new = spark.createDataFrame([(1, " A B ", "m", 0.7), (1, "a b", "m", 0.3), (1, "  ", "m", 1.0), (1, None, "m", 1.0)], schema)
    assert rows(B.put_keywords(pk, new)) == [(1, "a b", "m", 0.7)]


def test_legacy_save(spark):
    schema = "seq int, title string, year int, venue string, author array<string>, extracted array<string>"
    new = spark.createDataFrame([(1, "A  Title", 2020, "v", ["K One", "k one"], None), (2, "a title", 2020, "v", [], ["x", "two"]), (3, "Known", None, "v", [], []), (4, " ", 2020, "v", ["z z"], [])], schema)
    known = spark.createDataFrame([("KNOWN", None)], "canonical_title string, year int")
    saved, words = B.save_legacy(new, known)
    assert [r["seq"] for r in saved.collect()] == [1]
    assert rows(words.select("title_key", "keyword", "method"), "keyword") == [("a title", "k one", "author"), ("a title", "two", "extracted")]


def test_two_writers_of_one_version(spark, tmp_path):
    table = upsert.Table(spark, f"file://{tmp_path}/t")
    assert not table.exists()
    table.upsert(spark.createDataFrame([(1, 1), (2, 1)], "k int, v int"), ["k"], [F.col("v")])
    base = table.version()
    table.upsert(spark.createDataFrame([(2, 2)], "k int, v int"), ["k"], [F.col("v")])
    with pytest.raises(upsert.Conflict):
        table.write(spark.createDataFrame([(9, 9)], "k int, v int"), base=base)
    assert rows(table.read(), "k") == [(1, 1), (2, 2)] and rows(table.read(base), "k") == [(1, 1), (2, 1)]


def test_runs_of_many_upserts(spark, tmp_path):
    """Each upsert writes its own rows; runs of one size are merged; any version reads as the last rows of its keys."""
    table = upsert.Table(spark, f"file://{tmp_path}/t")
    want, merged = {}, []
    for i in range(9):
        new = [(k, i * 10 + n) for k in (i % 3, i) for n in (0, 1)]
        table.upsert(spark.createDataFrame(new, "k int, v int"), ["k"], [F.col("v")])
        want |= {k: v for k, v in new}
        merged.append([m for _, m in table.state()["runs"]])
        if i == 4:
            then = sorted(want.items())
    assert merged == [[0], [0, 0], [0, 0, 0], [1], [1, 0], [1, 0, 0], [1, 0, 0, 0], [1, 1], [1, 1, 0]]
    assert rows(table.read(), "k") == sorted(want.items()) and rows(table.read(5), "k") == then
    last = table.state()["runs"][-1][0]
    assert spark.read.parquet(f"file://{tmp_path}/t/{last}").count() == 2


def test_upserts_into_what_was_written(spark, tmp_path):
    """Rows written under no key are rewritten once; columns that a later batch adds are NULL before it; an empty batch changes nothing."""
    table = upsert.Table(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    table.write(spark.createDataFrame([(1, 1), (1, 2), (None, 3)], "k int, v int"))
    assert table.read().count() == 3
    table.upsert(spark.createDataFrame([(2, 5)], "k int, v int"), ["k"], [F.col("v")])
    table.upsert(spark.createDataFrame([(None, 9, "x")], "k int, v int, w string"), ["k"], [F.col("v")])
    table.upsert(spark.createDataFrame([], "k int, v int"), ["k"], [F.col("v")])
    got = sorted(map(tuple, table.read().select("k", "v", "w").collect()), key=str)
    assert got == [(1, 2, None), (2, 5, None), (None, 9, "x")]
    assert len(table.state()["runs"]) == 3


@pytest.mark.parametrize("dense", [False, True])
def test_emerging_topics_by_plain_loops(spark, dense):
    """Sparse and dense series against lists made bucket by bucket."""
    rng = random.Random(5)
    data = {(c, k, b): rng.randint(1, 9) * (1 + b // 3) for c in "xy" for k in "abcdefghij" for b in range(12 if c == "x" else 5) if rng.random() < 0.6}
    counted = spark.createDataFrame([(c, k, b, n) for (c, k, b), n in data.items()], "category string, keyword string, bucket int, count bigint")
    got = {(r["category"], r["keyword"]): (r["growth_rate"], r["first_seen"], r["recent_count"]) for r in series.emerging_topics(counted, window=3, dense=dense).collect()}
    want = {}
    for c in "xy":
        buckets = sorted({b for d, _, b in data if d == c})
        for k in "abcdefghij":
            own = [b for b in buckets if (c, k, b) in data]
            line = [data.get((c, k, b), 0) for b in buckets if own and b >= own[0]] if dense else [data[c, k, b] for b in own]
            if len(buckets) < 6 or len(line) < 3:
                continue
            recent, before = sum(line[-3:]) / 3, line[-6:-3]
            mean = sum(before) / len(before) if before else 0
            rate = recent / (mean if mean > 0 else 0.1)
            if rate >= 1.5:
                want[c, k] = (rate, own[0], int(recent))
    assert want and set(got) == set(want)
    assert all(abs(got[x][0] - want[x][0]) <= 0.0051 and got[x][1:] == want[x][1:] for x in want)


def test_unknown_venues(spark):
    papers = spark.createDataFrame([(1, 7), (2, 8)], "paper_id int, venue_id int")
    venues = spark.createDataFrame([(7, "ICLR")], "venue_id int, canonical_name string")
    n = lambda **kw: filters.resolve_venue(papers, venues, **kw).count()
    assert (n(name="ICLR"), n(name="none"), n(name="none", lenient=True), n(name=None)) == (1, 0, 2, 2)
    assert not papers.select(filters.in_category(F.lit("cs.LG"), "CS.lg", any_case=False).alias("x")).first()["x"]


def test_evolution(spark):
    from pyspark.sql.types import StructType

    old = spark.createDataFrame([(1, "t", "5")], "id int, name string, n string")
    assert rows(upsert.evolve(old, {"name": "title"}, StructType.fromDDL("id bigint, title string, n int, extra double"))) == [(1, "t", 5, None)]


def test_lookups(spark):
    papers = spark.createDataFrame([(5, "Éine Sache", 2020), (4, "éine  sache", 2021)], "paper_id int, canonical_title string, year int")
    asked = spark.createDataFrame([(1, "ÉINE SACHE", None), (2, "éine sache", 2020), (3, "none", None)], "ask int, title string, year int")
    assert rows(L.by_title(papers, asked).select("ask", "paper_id", "found"), "ask") == [(1, 4, True), (2, 5, True), (3, None, False)]
    entries = spark.createDataFrame([("arxiv_x", "1"), ("ARXIV_y", "2"), ("z", "3")], "key string, value string")
    assert L.meta(entries, "arxiv").count() == 2
    kw = spark.createDataFrame([(1, "a", "author"), (1, "a", "yake"), (1, "b", "yake")], "paper_id int, keyword string, method string")
    got = L.split_keywords(spark.createDataFrame([(1,), (2,)], "paper_id int"), kw)
    assert rows(got.withColumn("all", L.all_keywords()), "paper_id") == [(1, ["a"], ["a", "b"], ["a", "b"]), (2, [], [], [])]


def test_gates(spark):
    latest = spark.createDataFrame([(dt.datetime(2024, 1, 2),)], "retrieved_at timestamp")
    meta = spark.createDataFrame([("arxiv_cs.LG_week", "2024-01-02 00:00:00"), ("bad", "not a time")], "key string, value string")
    assert not Q.needs_series(latest, meta, "cs.LG", "week").first()["run"] and Q.needs_series(latest, meta, "cs.LG", "day").first()["run"]


def test_checks_and_report_as_text(spark):
    checks = spark.createDataFrame([("b", 1.0, 2.0, False), ("a", 3.0, 2.0, True)], "name string, value double, threshold double, passed boolean")
    assert export.checks_json(checks).first()["json"].startswith('[{"name":"a","value":3.0')
    overview = spark.createDataFrame([(3, 2, 1, "2020-2021")], "papers int, keywords int, venues int, year_range string")
    top = spark.createDataFrame([("graph", 5)], "keyword string, count int")
    new = spark.createDataFrame([("llm", True, float("inf")), ("rag", False, 2.0)], "keyword string, is_new boolean, growth_rate double")
    text = export.report(overview, top, new)
    assert "- papers: 3" in text and "| 1 | graph | 5 |" in text and "- llm: new" in text and "- rag: 2.00" in text


def test_files(spark, tmp_path):
    counted = spark.createDataFrame([("a", "week", "2024-W01", 2), ("b", "day", "2024-01-01", 0)], "category string, granularity string, bucket string, paper_count int")
    listed = spark.createDataFrame([("a", "week", "2024-W01", "x:1")], "category string, granularity string, bucket string, top_keywords string")
    files = export.series_files(counted, listed)
    export.write_partitioned(files, str(tmp_path / "p"), ["granularity", "category"])
    assert rows(spark.read.json(str(tmp_path / "p")).select("granularity", "category", "paper_count")) == [("week", "a", 2)]
    export.write_json(counted.where("paper_count > 0"), str(tmp_path / "one"))
    assert landing(spark, str(tmp_path / "one")).count() == 1
    (tmp_path / "whole.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert rows(static_json(spark, str(tmp_path / "whole.json")), "a") == [(1,), (2,)]


def test_url(spark):
    assert spark.range(1).select(X.paper_url(F.lit("u/"), F.col("id")).alias("x")).first()["x"] == "u/0"


@pytest.mark.parametrize(
    ("kind", "want"),
    [
        ("sliding", [("10:00", 1), ("10:30", 2), ("11:00", 2), ("11:30", 1)]),
        ("sessions", [("10:50", 2), ("11:40", 1)]),
        ("first", [("10:50", 1), ("11:40", 1)]),
    ],
)
def test_streams(spark, tmp_path, kind, want):
    at = lambda s: dt.datetime.fromisoformat(f"2024-01-01 {s}")
    data = [(1, at("10:50"), "c", 5), (2, at("11:05"), "c", 5), (3, at("11:40"), "c", 5)]
    spark.createDataFrame(data, "id int, ts timestamp, category string, user_id int").write.parquet(f"{tmp_path}/in")
    records = spark.readStream.schema("id int, ts timestamp, category string, user_id int").parquet(f"{tmp_path}/in")
    if kind == "sliding":
        out, mode = stream.windowed(records, "1 hour", "30 minutes"), "complete"
    elif kind == "sessions":
        out, mode = stream.sessions(records, "20 minutes"), "complete"
    else:
        out, mode = stream.first_seen(records.withColumn("id", F.when(F.col("id") == 3, 3).otherwise(1)), ["id"]), "append"
    name = f"out_{kind}"
    out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = spark.table(name)
    if kind == "first":
        assert got.count() == 2
    else:
        assert sorted((f"{r['start']:%H:%M}", r["count"]) for r in got.collect()) == want
