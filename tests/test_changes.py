"""Keyed state, sketches, VARIANT payloads, replacing batches and the cube, on small rows and against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quernstone.operators import keywords as K
from quernstone.operators import series, sketches, upsert
from quernstone.plans import changes, registry
from quernstone.sources import variants
from quernstone.streaming import topics
from quernstone.streaming.feeds import drain, until_batches

WEEK = 7 * 86_400_000


def events(seed, n=1500):
    """(week, category, keyword) in no order; some keywords appear late, in few weeks, or in one category alone."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        k = rng.randrange(12)
        week = rng.randrange(30) if k < 6 else 20 + rng.randrange(10) if k < 10 else rng.choice([3, 29])
        out.append((week, rng.choice(["a", "b"]), f"k{k}"))
    return out + [(w, "few", "k0") for w in range(5)]


def landed(spark, rows, path, files):
    ms = (F.col("week") + 1000).cast("bigint") * WEEK
    table = spark.createDataFrame(rows, "week int, category string, keyword string")
    table = table.groupBy("week", "category", "keyword", (F.rand(1) * 3).cast("int").alias("part")).agg(F.count("*").alias("count"))
    table = table.select(F.timestamp_millis(ms).alias("ts"), "category", "keyword", F.format_string("w%03d", "week").alias("bucket"), "count", (ms + WEEK).alias("end_ms"))
    table.repartition(files, F.rand(3)).write.parquet(path)


def run(spark, tmp_path, late, stop):
    at = {n: str(tmp_path / n) for n in ("rows", "rings", "checkpoint")}
    start = lambda: topics.into_batches(topics.rings(spark.readStream.schema(changes.RECORDS).option("maxFilesPerTrigger", 1).parquet(at["rows"]), late), at["rings"], at["checkpoint"])
    if stop:
        until_batches(start(), 2)
    drain(start())
    return topics.latest(spark, at["rings"])


def test_topics_of_a_stream_are_those_of_all_rows(spark, tmp_path):
    rows = events(5)
    landed(spark, rows, str(tmp_path / "rows"), 4)
    found = run(spark, tmp_path, "36500 days", stop=True)
    counted = spark.createDataFrame(rows, "week int, category string, keyword string").groupBy("category", F.format_string("w%03d", "week").alias("bucket"), "keyword").agg(F.count("*").alias("count"))
    for growth in (0.0, 1.05, 1.5):
        want = sorted(map(tuple, series.emerging_topics(counted, min_growth=growth, falling=-1).collect()))
        assert sorted(map(tuple, topics.emerging(found, min_growth=growth).collect())) == want
    assert {r.category for r in topics.emerging(found, min_growth=0.0).collect()} == {"a", "b"}


def test_buckets_close_when_the_watermark_has_passed(spark, tmp_path):
    (tmp_path / "rows").mkdir()
    for i, weeks in enumerate([[0, 1], [2], [6], [0, 6], [9]]):
        rows = spark.createDataFrame([(w, "c", "k") for w in weeks], "week int, category string, keyword string")
        ms = (F.col("week") + 1000).cast("bigint") * WEEK
        part = rows.select(F.timestamp_millis(ms).alias("ts"), "category", "keyword", F.format_string("w%03d", "week").alias("bucket"), F.lit(1).cast("bigint").alias("count"), (ms + WEEK).alias("end_ms"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "one"))
        (path,) = (tmp_path / "one").glob("*.parquet")
        path.rename(tmp_path / "rows" / f"{i}.parquet")
        import os

        os.utime(tmp_path / "rows" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    (row,) = run(spark, tmp_path, "7 days", stop=False).collect()
    assert row.closed >= "w002" and row.first_seen == "w000"
    assert dict(zip(row.buckets, row.counts)) == {"w000": 1, "w001": 1, "w002": 1, "w006": 2, "w009": 1}  # the second w000 came too late


def test_a_ring_keeps_the_latest_buckets():
    ring = {}
    for b, n in [("w5", 1), ("w1", 2), ("w9", 1), ("w5", 3), ("w7", 1)]:
        ring = topics.turned(ring, {b: (n, 0)}, keep=3)
    assert ring == {"w5": (4, 0), "w7": (1, 0), "w9": (1, 0)}


def test_sketches_within_their_bounds_and_refreshed_by_union(spark, tmp_path):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("h"), F.concat(F.lit("k"), F.col("id") % 20_011).alias("keyword"), F.rand(7).alias("score"))
    rows = spark.createDataFrame(rows.toPandas())
    exact = {r.g: r for r in rows.groupBy("g").agg(F.count_distinct("keyword").alias("n"), F.percentile("score", F.lit(0.5)).alias("m")).collect()}
    got = sketches.estimates(sketches.united(sketches.sketched(rows, "g", "h"), "g"), "g").collect()
    for r in got:
        assert r.n == 20_000 and abs(r.keywords - exact[r.g].n) <= sketches.within() * exact[r.g].n
        assert abs(r.q50 - exact[r.g].m) <= 2 * sketches.RANK
    at = str(tmp_path / "stored")
    sketches.sketched(rows.where("score < 0.4"), "g", "h").write.parquet(at)
    rows.where("score >= 0.4").write.parquet(str(tmp_path / "new"))
    rows.where("score < 0.4").write.parquet(str(tmp_path / "old"))
    again = sketches.refreshed(spark.read.parquet(at), spark.read.parquet(str(tmp_path / "new")), "g", "h")
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/old" not in plan and plan.count("Scan parquet") == 2
    whole = {(r.g, r.h): r for r in sketches.estimates(sketches.sketched(rows, "g", "h"), "g", "h").collect()}
    for r in sketches.estimates(again, "g", "h").collect():
        assert r.n == whole[r.g, r.h].n and abs(r.keywords - whole[r.g, r.h].keywords) <= 0.02 * r.keywords


PAYLOADS = {
    '{"id": "a", "content": {"title": "T"}}': ("a", "T", None),
    '{"id": {"value": "a"}, "content": {"title": {"value": " T "}}}': ("a", "T", None),
    '{"id": 7, "content": {"title": true}}': ("7", "true", None),
    '{"id": "a", "content": {"title": {"value": null}}}': ("a", None, "no title"),
    '{"id": "a", "content": {"title": {"value": {"x": 1}}}}': ("a", None, "no title"),
    '{"id": "a", "content": []}': ("a", None, "no title"),
    '{"id": "a"}': ("a", None, "no title"),
    '{"id": "", "content": {"title": "T"}}': ("", "T", "no id"),
    '{"content": {"title": "T"}}': (None, "T", "no id"),
    '{"id": "a"': (None, None, "malformed"),
    "words": (None, None, "malformed"),
    '"text"': (None, None, "no object"),
    "null": (None, None, "no object"),
    "12": (None, None, "no object"),
    "[]": (None, None, "no object"),
    "": (None, None, "empty"),
    " \n": (None, None, "empty"),
    None: (None, None, "empty"),
}


def test_payloads_of_any_shape(spark):
    rows = spark.createDataFrame([(p,) for p in PAYLOADS], "payload string").repartition(3)
    judged = variants.judged(rows, "id", "content.title")
    assert {r.payload: (r.source_paper_id, r.title, r.cause) for r in judged.collect()} == PAYLOADS
    assert variants.records(judged).count() == 3 and variants.rejects(judged).count() == len(PAYLOADS) - 3
    typed = variants.parsed(spark.createDataFrame([('{"y": {"value": 3}, "l": ["a"]}',), ('{"y": "x", "l": 1}',)], "payload string"))
    assert {(r.y, tuple(r.l or ())) for r in typed.select(variants.field("y", "int").alias("y"), variants.field("l", "array<string>").alias("l")).collect()} == {(3, ("a",)), (None, ())}
    assert variants.shape(spark.createDataFrame([('{"a": 1}',), ('{"b": "x"}',), ("no",)], "payload string")).first().schema == "OBJECT<a: BIGINT, b: STRING>"


def test_a_batch_replaces_records_and_their_links_go(spark):
    current = spark.createDataFrame([(1, "s", "a", "old a"), (2, "s", "b", "old b"), (3, "t", "a", "other")], "raw_id bigint, source string, id string, title string")
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13), (9, 14)], "raw_id bigint, paper_id bigint")
    new = spark.createDataFrame([(5, "s", "a", "first"), (7, "s", "a", None), (6, "u", "z", "new")], "seq bigint, source string, id string, title string")
    rows, kept, changed = upsert.replaced(current, links, new, ["source", "id"])
    assert sorted(map(tuple, rows.collect())) == [(2, "s", "b", "old b"), (3, "t", "a", "other"), (6, "u", "z", "new"), (7, "s", "a", None)]
    assert sorted((r.raw_id, r.paper_id) for r in kept.collect()) == [(2, 12), (3, 13), (9, 14)]
    assert sorted((r.source, r.id, r.kind, r.raw_id, r.old_id, r.links) for r in changed.collect()) == [("s", "a", "replace", 7, 1, 2), ("u", "z", "insert", 6, None, 0)]
    same, still, none = upsert.replaced(current, links, new.limit(0), ["source", "id"])
    assert same.exceptAll(current).count() == 0 and still.count() == 5 and none.count() == 0


def test_the_cube_has_every_level(spark):
    rows = spark.createDataFrame([("v", 1, "a"), ("v", 1, "a"), ("v", 2, "b"), ("w", 1, "a"), (None, None, "a")], "venue string, year int, keyword string")
    got = sorted(map(tuple, K.cube(rows).collect()), key=str)
    want = [(0, "v", 1, "a", 2), (0, "v", 2, "b", 1), (0, "w", 1, "a", 1), (0, None, None, "a", 1), (1, "v", None, "a", 2), (1, "v", None, "b", 1), (1, "w", None, "a", 1), (1, None, None, "a", 1)]
    want += [(2, None, 1, "a", 3), (2, None, 2, "b", 1), (2, None, None, "a", 1), (3, None, None, "a", 4), (3, None, None, "b", 1)]
    assert got == sorted(want, key=str)


def test_emerging_keywords_shuffle_few_times(spark, sf_dir):
    plan = registry.QUERIES["emerging_keywords"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") + plan.count("Exchange rangepartitioning") <= 7
    assert plan.count("BroadcastExchange") <= 4  # parts, customers twice, years
