"""The paged feed: pages written and read back, by number and by token, in batches and as a stream, over folders and HTTP."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quernstone.operators.numbering import placed
from quernstone.sources import paged
from quernstone.streaming.feeds import drain, into_files, until_batches

SCHEMA = "request string, place bigint, id bigint, name string"


def records(spark, n, requests=3):
    return spark.range(n).select(F.concat(F.lit("venue:V"), F.col("id") % requests, F.lit(",year:2020")).alias("request"), "id", F.concat(F.lit('n "x" '), "id").alias("name"))


def asked(requests=3):
    return [f"venue:V{i},year:2020" for i in range(requests)]


def want(n, requests=3):
    return sorted((f"venue:V{i % requests},year:2020", i // requests, i, f'n "x" {i}') for i in range(n))


@pytest.mark.parametrize("paging", ["token", "offset"])
@pytest.mark.parametrize("n", [0, 1, 29, 30, 31, 200])
def test_every_record_once_and_in_place(spark, tmp_path, paging, n):
    path = str(tmp_path / "pages")
    paged.land(records(spark, n).repartition(5), path, ["id"], size=10, paging=paging)
    got = paged.read(spark, asked(), paging, SCHEMA, path=path, page_size="10", pages_each="2")
    assert sorted(tuple(r) for r in got.collect()) == want(n)


def test_numbers_within_groups_of_any_size(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string")).alias("g"), F.col("id")).repartition(7)
    got = {}
    for r in placed(rows, "g", [F.desc("id")]).collect():
        got.setdefault(r.g, []).append((-r.id, r.place))
    assert all([p for _, p in sorted(v)] == list(range(len(v))) for v in got.values())


@pytest.mark.parametrize("paging", ["token", "offset"])
@pytest.mark.parametrize(("start", "results"), [(0, 5), (7, 10), (25, 100), (100, 5), (10, 0)])
def test_ranges(spark, tmp_path, paging, start, results):
    path = str(tmp_path / "pages")
    paged.land(records(spark, 90), path, ["id"], size=10, paging=paging)
    got = paged.read(spark, asked(), paging, SCHEMA, path=path, page_size="10", start=str(start), results=str(results))
    assert sorted(tuple(r) for r in got.collect()) == [r for r in want(90) if start <= r[1] < start + results]


def test_a_search_has_a_largest_size(spark, tmp_path):
    path = str(tmp_path / "pages")
    paged.land(spark.range(3000).select(F.lit("cat:cs.LG").alias("request"), "id"), path, ["id"], size=500, paging="offset")
    assert paged.search(spark, "", 100, 5000, "id bigint", path=path, page_size="500").agg(F.count("*"), F.min("id"), F.max("id")).first()[:] == (2000, 100, 2099)


def test_wanted_values_drop_requests_before_a_page_is_read(spark, tmp_path):
    path = str(tmp_path / "pages")
    paged.land(records(spark, 60), path, ["id"], size=10)
    for page in (tmp_path / "pages").glob("request=*V1*/*/part*"):
        page.write_text("no page at all")
    rows = lambda **only: paged.read(spark, asked(), "token", "venue string, year int, id bigint, request string", only=only, path=path)
    assert rows(venue=["V0"], year=[2020]).count() == 20
    assert rows(venue=["V0", "V2"]).count() == 40
    assert rows(request=[asked()[2]]).count() == 20
    assert rows(year=[1999]).count() == 0
    assert rows(venue=["V0"]).rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="JSON|Expecting"):
        rows().count()


def test_filters_lose_no_rows_of_later_plans(spark, tmp_path):
    path = str(tmp_path / "pages")
    paged.land(records(spark, 60), path, ["id"], size=10)
    rows = paged.read(spark, asked(), "token", "venue string, id bigint", path=path)
    assert [rows.where("venue = 'V0'").count(), rows.count(), rows.where("venue = 'V9'").count(), rows.count()] == [20, 60, 0, 60]


def test_types_payloads_and_what_a_request_fixes(spark, tmp_path):
    path = str(tmp_path / "pages")
    folder = tmp_path / "pages" / "request=venue%3AV,year%3A2020" / "key=start"
    folder.mkdir(parents=True)
    (folder / "part-0").write_text(json.dumps({"data": [{"id": "7", "name": {"value": "x"}, "score": "0.5", "tags": ["a"]}, {"id": "seven", "year": 1999}, {}]}))
    got = paged.read(spark, ["venue:V,year:2020"], "token", "id bigint, name string, score double, tags array<string>, year int, venue string, payload string", path=path).collect()
    assert [(r.id, r.name, r.score, r.tags, r.year, r.venue) for r in got] == [(7, '{"value": "x"}', 0.5, ["a"], 2020, "V"), (None, None, None, None, 1999, "V"), (None, None, None, None, 2020, "V")]
    assert json.loads(got[1].payload) == {"id": "seven", "year": 1999}


def test_the_first_alternative_that_has_any(spark, tmp_path):
    path = str(tmp_path / "pages")
    rows = spark.createDataFrame([("a.cc/-/Blind_Submission", 1), ("a.cc/-/blind-submission", 2), ("b.cc/-/Submission", 3), ("b.cc/-/Blind_Submission", 4)], "request string, id bigint")
    paged.land(rows, path, ["id"], size=1)
    got = paged.submissions(spark, ["a.cc", "b.cc", "none.cc"], schema="request string, id bigint", path=path).collect()
    assert sorted(r.id for r in got) == [1, 3]


def test_tokens_in_a_circle_are_an_error(spark, tmp_path):
    for key, token in (("start", "x"), ("x", "start")):
        folder = tmp_path / "request=r" / f"key={key}"
        folder.mkdir(parents=True)
        (folder / "part-0").write_text(json.dumps({"data": [{"id": 1}], "token": token}))
    with pytest.raises(Exception, match="back to it"):
        paged.read(spark, ["r"], "token", "id bigint", path=str(tmp_path)).collect()


@pytest.mark.parametrize("paging", ["token", "offset"])
def test_a_stream_goes_on_where_it_stopped_and_reads_what_a_page_has_gained(spark, tmp_path, paging):
    path, out, checkpoint = (str(tmp_path / x) for x in ("pages", "out", "checkpoint"))
    paged.land(records(spark, 200), path, ["id"], size=10, paging=paging)
    rows = lambda: paged.stream(spark, asked(), paging, SCHEMA, path=path, page_size="10", pages_each="1")
    until_batches(into_files(rows(), out, checkpoint), 2)
    early = spark.read.parquet(out).count()
    assert 0 < early < 200 if paging == "token" else early == 200
    drain(into_files(rows(), out, checkpoint))
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == want(200)
    paged.land(records(spark, 233), str(tmp_path / "more"), ["id"], size=10, paging=paging)
    (tmp_path / "pages").rename(tmp_path / "old")
    (tmp_path / "more").rename(tmp_path / "pages")
    drain(into_files(rows(), out, checkpoint))
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == want(233)


def test_a_batch_is_read_again_as_it_was():
    class Pages:
        def get(self, request, key):
            n = 0 if key == paged.FIRST else int(key)
            return {"data": [{"id": 10 * n + i} for i in range(10)], "token": str(n + 1) if n < 5 else None}

    from pyspark.sql.types import LongType, StructField, StructType

    feed = paged.Feed({"requests": '["a", "b"]', "path": "-", "pages_each": "2"})
    feed.pages = Pages()
    reader = paged.TokenStream(feed, StructType([StructField("id", LongType())]))
    at, seen = reader.initialOffset(), []
    while True:
        rows, end = reader.read(at)
        rows = list(rows)
        assert rows == list(reader.readBetweenOffsets(at, end))
        if end == at:
            break
        seen += rows
        at = end
    assert sorted(seen) == sorted((i,) for i in range(60) for _ in "ab")


def test_pages_over_http(spark):
    failures = {"b": 2}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            _, request, key = self.path.split("/")
            if failures.get(request, 0):
                failures[request] -= 1
                self.send_error(503)
                return
            if request == "none":
                self.send_error(404)
                return
            n = int(key or 0)
            body = json.dumps({"data": [{"id": 3 * n + i} for i in range(3)], "token": str(n + 1) if n < 4 else None}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        address = f"http://127.0.0.1:{server.server_port}/{{request}}/{{key}}"
        got = paged.read(spark, ["a", "b", "none"], "token", "request string, id bigint", address=address).collect()
    finally:
        server.shutdown()
    assert sorted(r.id for r in got if r.request == "a") == list(range(15)) == sorted(r.id for r in got if r.request == "b") and len(got) == 30


@pytest.mark.parametrize("paging", ["token", "offset"])
def test_many_pages_share_a_file(spark, tmp_path, paging):
    path = str(tmp_path / "pages")
    paged.land(records(spark, 3000), path, ["id"], size=1, paging=paging)
    assert len(list((tmp_path / "pages").glob("*/*/part*"))) == 12  # 1,000 pages a request, 256 a file
    got = paged.read(spark, asked(), paging, SCHEMA, path=path, page_size="1", pages_each="100")
    assert sorted(tuple(r) for r in got.collect()) == want(3000)
