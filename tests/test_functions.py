"""Truth tables of the column rules."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.functions import time as T
from quernstone.functions import udfs as U


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_titles(spark):
    assert column(spark, ["  A \n b\t c ", None, ""], "string", X.normal_title) == ["A b c", "", ""]
    assert column(spark, ["ÉTÉ  x"], "string", X.title_key) == ["été x"]
    assert column(spark, ["The Graph x1 of Été naïve graphs, at"], "string", X.title_tokens) == [["graph", "graphs"]]


def test_keywords(spark):
    given = [" Deep-Learning. ", '("Graph_Nets")', "", None, "LLMs", "the", "12.5", "a1234", "x", "http abc", "Vision Transformers", "RL"]
    normal = ["deep learning", "graph nets", None, None, "llms", "the", "12.5", "a1234", "x", "http abc", "vision transformers", "rl"]
    assert column(spark, given, "string", X.normal_keyword) == normal
    clean = ["deep learning", "graph nets", None, None, "large language model", None, None, None, None, None, "vision transformer", None]
    assert column(spark, given, "string", X.clean_keyword) == clean
    assert column(spark, ["graph", "123", "ab", "Deep Nets", "x1y", None], "string", X.valid_bucket_keyword) == [True, False, False, True, False, False]
    assert column(spark, [" A ", "ab", "x" * 101], "string", X.legacy_keyword) == [None, "ab", None]


def test_venues(spark):
    given = ["ICML 2020", "Nips workshop", "ACL 2021", "the oracle", "North American Chapter of ACL", None]
    assert column(spark, given, "string", X.match_venue) == ["ICML", "NeurIPS", "ACL", None, "NAACL", None]
    found = column(spark, ["accepted at ICLR 24", "NAACL 2022", "plain", "Accepted to EMNLP"], "string", lambda c: X.redetect_venue(c, F.lit(None).cast("string")))
    assert [tuple(x) if x else None for x in found] == [(0.7, "ICLR", 2024), (0.7, "ACL", 2022), None, (0.9, "EMNLP", None)]
    ids = column(spark, ["ICLR.cc/2024/Conference", "aclweb.org/NAACL/2023/Workshop/X", "nothing"], "string", X.parse_venue_id)
    assert [tuple(x) if x else None for x in ids] == [("ICLR", 2024, False), ("ACL", 2023, True), None]
    assert column(spark, ["ICLR", "LOG", "XYZ"], "string", X.venue_tier) == ["A", "B", "C"]


def test_venue_cascade(spark):
    rows = spark.createDataFrame([("openreview", "Some Venue", "ICML", None), ("arxiv", None, "at CVPR", "ICCV"), ("arxiv", "ICLR", "at CVPR", None), ("arxiv", "", None, "ECCV"), ("s2", None, None, None)], "s string, v string, c string, j string")
    got = rows.select(X.detect_venue(F.col("s"), F.col("v"), F.col("c"), F.col("j")).alias("d")).collect()
    assert [tuple(r["d"]) for r in got] == [("Some Venue", 1.0), ("CVPR", 0.7), ("ICLR", 0.9), ("ECCV", 0.8), (None, 0.0)]


def test_domains(spark):
    rows = spark.createDataFrame([("cs.CV", "x", None), (None, "robot control text", ""), (None, "nothing", None)], "c string, t string, a string")
    fixed = [r[0] for r in rows.select(X.classify_domain(F.col("c"), F.col("t"), F.col("a"))).collect()]
    plain = [r[0] for r in rows.select(X.classify_domain(F.col("c"), F.col("t"), F.col("a"), False)).collect()]
    assert fixed == ["CV", "RL", None] and plain == [None, "RL", None]


def test_buckets(spark):
    days = [dt.datetime(2024, 1, 15), dt.datetime(2024, 12, 30), dt.datetime(2021, 1, 3), None]
    assert column(spark, days, "timestamp", T.week_bucket) == ["2024-W03", "2025-W01", "2020-W53", None]
    assert column(spark, days, "timestamp", T.month_bucket) == ["2024-01", "2024-12", "2021-01", None]
    assert column(spark, days, "timestamp", T.day_bucket) == ["2024-01-15", "2024-12-30", "2021-01-03", None]
    assert column(spark, [2024, 0, None], "int", T.year_bucket) == ["2024", None, None]
    assert column(spark, ["2024-01-05T10:00:00", "junk", None], "string", T.lenient_timestamp) == [dt.datetime(2024, 1, 5, 10), None, None]


def test_greedy_dedup():
    items = [("graph networks", 0.9), ("graph network", 0.95), ("robots", 0.5), ("robot", 0.4), ("vision", 0.1)]
    assert U.greedy_dedup(items) == [("graph network", 0.95), ("robots", 0.5), ("vision", 0.1)]
    assert U.similarity("abcd", "bcde") == pytest.approx(0.75)


@pytest.mark.parametrize("extractor", [U.statistical_phrases, U.embedded_phrases])
def test_phrases(extractor):
    text = "Graph networks learn on graphs. Graph networks scale. Robots use graph networks in the field."
    found = extractor(text)
    assert found and all(isinstance(k, str) and -1e-9 <= s <= 1 for k, s in found)
    assert extractor("") == [] and extractor("the and or") == []
    assert extractor(text) == found


def test_embedded_phrases_look_closely_at_few(monkeypatch):
    """Of a long text's thousands of phrases only those near the best are embedded one by one."""
    import random

    rng, calls, embed = random.Random(3), [], U._embed
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(3000))
    monkeypatch.setattr(U, "_embed", lambda s, size: calls.append(s) or embed(s, size))
    assert len(U.embedded_phrases(text)) == 10
    assert len(calls) < 200
