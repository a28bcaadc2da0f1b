"""Defaults, totals, details, logs, gates, chart sets and layouts on small rows."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from quernstone.operators import layout, lookups, reads


def test_defaults_are_those_of_the_table(spark):
    rows = spark.createDataFrame([(1, None, None, None, None), (2, "t", ["a"], dt.datetime(2024, 1, 1), "x")], "raw_id int, title string, authors array<string>, retrieved_at timestamp, doi string")
    got = [tuple(r) for r in reads.decoded(rows, "raw_papers").orderBy("raw_id").collect()]
    assert got == [(1, "", [], None, None), (2, "t", ["a"], dt.datetime(2024, 1, 1), "x")]
    venue = spark.createDataFrame([(None, None)], "tier string, years_available array<int>")
    assert tuple(reads.decoded(venue, "venues").first()) == ("C", [])


def test_a_page_knows_the_total(spark):
    rows = spark.range(25)
    for offset, want in [(0, [0, 1]), (24, [24]), (30, [])]:
        got = reads.page_with_total(rows, [F.asc("id")], offset, 2).collect()
        assert [r.id for r in got] == want and all(r.total == 25 for r in got)
    assert reads.page_with_total(rows.limit(0), [F.asc("id")], 0, 2).collect() == []


def test_details_by_title(spark):
    records = spark.createDataFrame([("a", "A  Title", None), ("b", "a title", 2020), ("c", "other", 2020), ("d", None, 2020)], "source_paper_id string, title string, year int")
    papers = spark.createDataFrame([(5, "A title", 2021), (7, "a  TITLE", 2020), (9, "A title", None)], "paper_id bigint, canonical_title string, year int")
    pk = spark.createDataFrame([(5, f"k{i:02}") for i in range(12)] + [(7, "x"), (7, "x")], "paper_id bigint, keyword string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("none",)], "source_paper_id string")
    got = {r.source_paper_id: (r.status, r.paper_id, r.keywords) for r in reads.details(asked, records, papers, pk).collect()}
    assert got == {"a": (200, 5, [f"k{i:02}" for i in range(10)]), "b": (200, 7, ["x"]), "c": (200, None, []), "d": (404, None, []), "none": (404, None, [])}


def test_lookups_meet_a_hot_title_as_one_row(spark):
    papers = spark.range(3000).select(F.col("id").alias("paper_id"), F.lit("Hot title").alias("canonical_title"), (F.col("id") % 3 + 2000).cast("int").alias("year"))
    asked = spark.range(3000).select(F.col("id").alias("ask"), F.lit("hot  TITLE").alias("title"), F.when(F.col("id") % 4 > 0, F.col("id") % 4 + 1999).cast("int").alias("year"))
    got = {(r.ask % 4, r.paper_id) for r in lookups.by_title(papers, asked).collect()}
    assert got == {(0, 0), (1, 0), (2, 1), (3, 2)}


def test_logs_say_what_is_due(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    logs = spark.createDataFrame([("v", 2020, 1, dt.datetime(2024, 1, 1)), ("v", 2020, 2, dt.datetime(2024, 1, 5)), ("w", 2020, 1, dt.datetime(2024, 1, 1)), ("x", 2020, 1, dt.datetime(2024, 1, 3))], "venue string, year int, paper_count bigint, scraped_at timestamp")
    asked = spark.createDataFrame([("v", 2020), ("v", 2021), ("w", 2020), ("x", 2020)], "venue string, year int")
    assert {(r.venue, r.year): r.due for r in reads.due(asked, logs, now).collect()} == {("v", 2020): False, ("v", 2021): True, ("w", 2020): True, ("x", 2020): False}
    after = reads.logged(logs, asked.withColumn("paper_count", F.lit(3)), now)
    assert after.count() == 8 and not any(r.due for r in reads.due(asked, after, now).collect())


def test_gates_see_records_and_paper_counts(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 678)
    scopes = spark.createDataFrame([("same", at, 3), ("later", at, 3), ("more", at, 3), ("new", at, 3), ("none", None, 0)], "scope string, retrieved_at timestamp, papers bigint")
    meta = reads.after_run(spark.createDataFrame([("same", at, 3), ("later", at - dt.timedelta(microseconds=1), 3), ("more", at, 2)], scopes.schema), F.lit("2024-02-01"))
    got = {r.scope: (r.run, r.reason) for r in reads.gates(scopes, meta).collect()}
    assert got == {"same": (False, None), "later": (True, "records"), "more": (True, "papers"), "new": (True, "first"), "none": (True, "first")}
    again = reads.gates(scopes.where("scope <> 'none'"), reads.after_run(scopes, F.lit("2024-02-01")))
    assert not any(r.run for r in again.collect())


def test_skew_of_the_last_days(spark):
    day = lambda n: dt.datetime(2024, 3, 1) + dt.timedelta(days=n)
    papers = spark.createDataFrame([("old", day(-40))] * 9 + [("a", day(-1))] * 39 + [("b", day(-2))], "venue string, created_at timestamp")
    now = F.lit("2024-03-01").cast("timestamp")
    assert tuple(reads.recent_skew(papers, now).first()) == ("a", 39, 0.975, True)
    assert reads.recent_skew(papers, now, most=0.98).first().warning is False
    assert reads.recent_skew(papers.where("venue = 'old'"), now).collect() == []


def test_chart_sets(spark):
    counted = spark.createDataFrame([("a", 4), ("b", 8), ("c", 4)], "keyword string, count bigint")
    assert [tuple(r) for r in reads.bars(counted, 2).orderBy("place").collect()] == [(1, "b", 8, 1.0), (2, "a", 4, 0.5)]
    papers = spark.createDataFrame([("v", 2020), ("v", 2021), ("v", 2021), ("w", 2019)], "venue string, year int")
    ranks = spark.createDataFrame([("v", 2020, "x", 5, 1), ("v", 2021, "y", 2, 1), ("v", 2021, "z", 1, 2), ("w", 2019, "y", 1, 1)], "venue string, year int, keyword string, count bigint, rank int")
    assert sorted(tuple(r) for r in reads.latest_years(papers, ranks, 1).collect()) == [("v", 2021, 2, "y", 2, 1), ("w", 2019, 1, "y", 1, 1)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_and_group_without_an_exchange(spark):
    name, size = uuid.uuid4().hex, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    papers = layout.bucketed(spark.range(500).withColumnRenamed("id", "paper_id"), f"p_{name}", "paper_id", 4)
    pk = layout.bucketed(spark.range(2000).select((F.col("id") % 400).alias("paper_id"), (F.col("id") % 7).alias("keyword")), f"k_{name}", "paper_id", 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = pk.join(papers, "paper_id").groupBy("paper_id").agg(F.count("*").alias("n"))
        without = papers.join(pk, "paper_id", "left_anti")
        assert "Exchange" not in plan_of(joined) and "Exchange" not in plan_of(without)
        assert joined.count() == 400 and without.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_point_reads_open_the_files_of_their_range(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = spark.range(40_000).select(F.format_string("id%06d", "id").alias("source_paper_id"), F.col("id"))
    table = layout.for_lookups(rows, str(tmp_path / "t"), "source_paper_id", 10_000)
    one = table.where("source_paper_id = 'id012345'")
    assert one.first().id == 12345 and "PushedFilters: [IsNotNull(source_paper_id), EqualTo(source_paper_id,id012345)]" in plan_of(one)
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "t").glob("*.parquet")]
    held = [m.row_group(i).column(0).statistics for m in files for i in range(m.num_row_groups)]
    assert sum(s.min <= "id012345" <= s.max for s in held) == 1 and sum(m.num_rows for m in files) == 40_000
