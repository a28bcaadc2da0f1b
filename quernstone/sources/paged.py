"""Feeds that answer in pages, as a data source: spark.read.format("paged_feed"), and readStream.

A feed is asked for a request (a search text, a filter text, an invitation) and a page of it. Two kinds are known:

* offset: pages have numbers and the feed states the total, so the pages of a request are dealt over partitions and read in parallel, as rows
  start to start + results of it;
* token: every page names the next one (a cursor or continuation token), so a request is one partition that follows its pages.

Requests are read in parallel in either kind. A request text "venue:CVPR,year:2021" fixes these columns, and `only` drops the requests that contradict
the wanted values before a page is fetched. (Filters are not pushed: a relation of Spark 4.1 that has pruned for one plan stays pruned in
later plans without a filter, which would lose rows.) A request of several texts joined by "|" is the first of them that has any record.

As a stream, the offset of a request is a row number (offset) or the page last seen and the number of records read of it (token). So
a stream that was stopped goes on from its checkpoint with the page it stopped at, a page that has grown gives only its new records, and
each record comes once.

Pages come from a folder that `land` or a crawler has written, or over HTTP; both answer with {"data": [...], "token": ..., "total": ...}.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, MapType, StringType, StructType

from quernstone.operators.numbering import placed

#: Rows of a request at most where the feed is asked for a range, as the feed states it.
MOST_RESULTS = 2_000
FIRST = "start"
#: Pages, and records, of one file at most: a file a page would be more files than a folder or its writer can take.
BUNDLE_PAGES, BUNDLE_RECORDS = 256, 20_000

# ---------------------------------------------------------------- where pages come from


def bundle(n: int, size: int) -> int:
    """The bundle of page number n of `size` records."""
    return n // bundled(size)


def bundled(size: int) -> int:
    """Pages of a bundle, so that neither files nor their records are too many."""
    return max(1, min(BUNDLE_PAGES, BUNDLE_RECORDS // size))


class Folder:
    """Pages as text files under request=<request>/key=<page>, or many pages a file under request=<request>/bundle=<number>, a line of <page>, a tab
    and its text each. Of these a token ends in "-<number>", pages with numbers are `size` records each, and the first page is in number 0."""

    def __init__(self, root: str, paging: str = "token", size: int = 100):
        self.root, self.paging, self.size = root, paging, size
        self.held: tuple | None = None

    def _at(self):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        return fs, files, path

    def _files(self, folder: str) -> list:
        fs, files, _ = self._at()
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)

    def _text(self, found: list) -> str:
        files = self._at()[1]
        return "".join(files.open_input_stream(f.path).read().decode() for f in found)

    def _number(self, key: str) -> str:
        if key == FIRST:
            return "0"
        return str(bundle(int(key), self.size)) if self.paging == "offset" else key.rpartition("-")[2]

    def get(self, request: str, key: str) -> dict | None:
        """The page, or None where there is none."""
        folder = f"{self._at()[2]}/request={escaped(request)}"
        text = self._text(self._files(f"{folder}/key={escaped(key)}"))
        if not text.strip():
            found = self._files(f"{folder}/bundle={escaped(self._number(key))}")
            sign = [(f.path, f.size, f.mtime_ns) for f in found]
            if self.held is None or self.held[0] != sign:
                lines = [line.partition("\t") for line in self._text(found).split("\n") if line.strip()]
                self.held = sign, {k if tab else FIRST: page if tab else k for k, tab, page in lines}
            text = self.held[1].get(key, "")
        return json.loads(text) if text.strip() else None


class Http:
    """Pages over HTTP: {request} and {key} of the address are filled in; key is empty for the first page. A failed request is tried again."""

    def __init__(self, address: str, delay: float = 0.0, tries: int = 4):
        self.address, self.delay, self.tries = address, delay, tries

    def get(self, request: str, key: str) -> dict | None:
        quoted = {"request": urllib.parse.quote(request, safe=""), "key": urllib.parse.quote("" if key == FIRST else key, safe="")}
        for left in reversed(range(self.tries)):
            time.sleep(self.delay)
            try:
                with urllib.request.urlopen(self.address.format(**quoted), timeout=60) as answer:
                    return json.loads(answer.read())
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                if not left or e.code < 500 and e.code != 429:
                    raise
            except OSError:
                if not left:
                    raise
            time.sleep(2.0 ** (self.tries - left - 2))
        return None


def escaped(value: str) -> str:
    """A value as Spark writes it into the name of a partition folder."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in value)


# ---------------------------------------------------------------- requests and records


def terms(request: str) -> dict[str, str]:
    """name: value of a filter text; nothing of other texts."""
    parts = [t.partition(":") for t in request.split(",")]
    return {k: v for k, sep, v in parts if sep and k.isidentifier()}


def pruned(requests: list[str], only: dict[str, list]) -> list[str]:
    """The requests that none of the wanted values of a column (or of `request`) rules out."""
    return [r for r in requests if not any(contradicts(r, c, {str(v) for v in values}) for c, values in only.items())]


def contradicts(request: str, column: str, values: set[str]) -> bool:
    if column == "request":
        return request not in values
    fixed = [terms(r).get(column) for r in request.split("|")]
    return all(f is not None and f not in values for f in fixed)


def _cast(value, kind):
    if value is None or isinstance(kind, StringType) and isinstance(value, str):
        return value
    if isinstance(kind, StringType):
        return json.dumps(value, ensure_ascii=False)
    try:
        if isinstance(kind, (IntegerType, LongType)):
            return int(value)
        if isinstance(kind, DoubleType):
            return float(value)
    except (TypeError, ValueError):
        return None
    return value if isinstance(kind, (ArrayType, MapType)) else None


def as_row(record: dict, request: str, place: int, schema: StructType) -> tuple:
    """A record by the names of the schema; request, place and payload are the source's own, and what a request fixes fills what a record lacks."""
    own = {"request": request, "place": place, "payload": json.dumps(record, ensure_ascii=False)}
    fixed = terms(request)
    return tuple(own[f.name] if f.name in own else _cast(record.get(f.name, fixed.get(f.name)), f.dataType) for f in schema.fields)


class Feed:
    """The requests of a source and how their pages are read."""

    def __init__(self, options: dict[str, str]):
        self.requests: list[str] = json.loads(options["requests"])
        self.paging = options.get("paging", "token")
        if self.paging not in ("token", "offset"):
            raise ValueError(f"unknown paging: {self.paging}")
        self.size = int(options.get("page_size", "100"))
        self.start = int(options.get("start", "0"))
        self.results = int(options["results"]) if "results" in options else None
        self.pages_each = int(options.get("pages_each", "4"))
        self.pages = Http(options["address"], float(options.get("delay", "0"))) if "address" in options else Folder(options["path"], self.paging, self.size)

    def chosen(self, request: str) -> tuple[str, dict | None]:
        """The first alternative that has any record, and its first page; the first alternative if none has."""
        first = None
        for text in request.split("|"):
            page = self.pages.get(text, FIRST if self.paging == "token" else "0")
            first = first or (text, page)
            if page and page.get("data"):
                return text, page
        return first

    def follow(self, text: str, key: str, page: dict | None = None) -> Iterator[tuple[str, dict]]:
        """(key, page) from a page on, by the tokens; a token that comes again is an error of the feed."""
        seen = set()
        while key is not None:
            if key in seen:
                raise ValueError(f"the feed leads from {key!r} of {text!r} back to it")
            seen.add(key)
            page = page or self.pages.get(text, key)
            if page is None:
                return
            yield key, page
            key, page = page.get("token"), None

    def range_of(self, total: int) -> tuple[int, int]:
        return min(self.start, total), total if self.results is None else min(total, self.start + self.results)

    def numbered(self, text: str, a: int, b: int) -> Iterator[tuple[int, dict]]:
        """Records a to b of a request whose pages have numbers."""
        for k in range(a // self.size, -(-b // self.size)):
            page = self.pages.get(text, str(k))
            for i, record in enumerate((page or {}).get("data", []), k * self.size):
                if a <= i < b:
                    yield i, record

    def in_order(self, request: str) -> Iterator[tuple[str, int, dict]]:
        """(text, place, record) of a request that is followed by tokens, from start on and as many as results."""
        text, first = self.chosen(request)
        place = 0
        last = None if self.results is None else self.start + self.results
        for _, page in self.follow(text, FIRST, first):
            for record in page.get("data", []):
                if last is not None and place >= last:
                    return
                if place >= self.start:
                    yield text, place, record
                place += 1
            if last is not None and place >= last:
                return


# ---------------------------------------------------------------- readers


class Span(InputPartition):
    """Rows a to b of a request; all rows of it if b is None."""

    def __init__(self, request: str, a: int = 0, b: int | None = None):
        self.request, self.a, self.b = request, a, b


class PagedReader(DataSourceReader):
    def __init__(self, feed: Feed, schema: StructType):
        self.feed, self.schema = feed, schema

    def partitions(self):
        if self.feed.paging == "token":
            return [Span(r) for r in self.feed.requests]
        out, step = [], self.feed.size * self.feed.pages_each
        for request in self.feed.requests:
            text, page = self.feed.chosen(request)
            a, b = self.feed.range_of(int((page or {}).get("total", 0)))
            edges = [a, *range((a // step + 1) * step, b, step), b]
            out += [Span(text, x, y) for x, y in zip(edges, edges[1:]) if x < y]
        return out

    def read(self, partition):
        if partition is None or not isinstance(partition, Span):
            return
        if partition.b is None:
            for text, place, record in self.feed.in_order(partition.request):
                yield as_row(record, text, place, self.schema)
        else:
            for place, record in self.feed.numbered(partition.request, partition.a, partition.b):
                yield as_row(record, partition.request, place, self.schema)


class OffsetStream(DataSourceStreamReader):
    """Pages with numbers: an offset says how many rows of each request have been read."""

    def __init__(self, feed: Feed, schema: StructType):
        self.feed, self.schema = feed, schema

    def initialOffset(self):
        return {r: 0 for r in self.feed.requests}

    def latestOffset(self):
        return {r: int((self.feed.pages.get(r, "0") or {}).get("total", 0)) for r in self.feed.requests}

    def partitions(self, start, end):
        step = self.feed.size * self.feed.pages_each
        return [Span(r, a, min(a + step, b)) for r, b in end.items() for a in range(start.get(r, 0), b, step)]

    def read(self, partition):
        for place, record in self.feed.numbered(partition.request, partition.a, partition.b):
            yield as_row(record, partition.request, place, self.schema)


class TokenStream(SimpleDataSourceStreamReader):
    """Pages that name the next: an offset has, for each request, the page last seen, the records read of it and of all.

    A batch has pages_each pages of every request at most, since the driver follows the tokens.
    """

    def __init__(self, feed: Feed, schema: StructType):
        self.feed, self.schema = feed, schema

    def initialOffset(self):
        return {r: {"key": FIRST, "seen": 0, "place": 0} for r in self.feed.requests}

    def _from(self, request: str, at: dict, until: dict | None) -> tuple[list[tuple], dict]:
        rows, place, seen, key = [], at["place"], at["seen"], at["key"]
        for n, (key_now, page) in enumerate(self.feed.follow(request, key)):
            if until is None and n == self.feed.pages_each + (at["seen"] > 0):
                break
            key, skip = key_now, seen if n == 0 else 0
            data = page.get("data", [])
            stop = until["seen"] if until is not None and key == until["key"] else len(data)
            rows += [as_row(x, request, place + i, self.schema) for i, x in enumerate(data[skip:stop])]
            place, seen = place + max(0, stop - skip), max(skip, stop)
            if until is not None and key == until["key"]:
                break
        return rows, {"key": key, "seen": seen, "place": place}

    def read(self, start):
        rows, end = [], {}
        for r in self.feed.requests:
            more, end[r] = self._from(r, start.get(r) or self.initialOffset()[r], None)
            rows += more
        return iter(rows), end

    def readBetweenOffsets(self, start, end):
        for r, until in end.items():
            yield from self._from(r, start.get(r) or {"key": FIRST, "seen": 0, "place": 0}, until)[0]


class PagedFeed(DataSource):
    """Options: requests (a JSON list), paging (token or offset), path or address, page_size, pages_each, start, results, delay."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return "request string, place bigint, payload string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(Feed(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        if self.options.get("paging", "token") == "offset":
            return OffsetStream(Feed(self.options), schema)
        return super().streamReader(schema)  # not there: Spark asks for the simple one

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return TokenStream(Feed(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedFeed)


def _reader(reader, requests: list[str], paging: str, schema: str | None, options: dict):
    reader = reader.format("paged_feed").option("requests", json.dumps(requests)).option("paging", paging).options(**options)
    return (reader if schema is None else reader.schema(schema)).load()


def read(spark: SparkSession, requests: list[str], paging: str = "token", schema: str | None = None, only: dict[str, list] | None = None, **options) -> DataFrame:
    """Records of the requests; only: wanted values by column, which prune requests and filter rows."""
    register(spark)
    rows = _reader(spark.read, pruned(requests, only or {}), paging, schema, options)
    for column, values in (only or {}).items():
        rows = rows.where(F.col(column).isin(values)) if column in rows.columns else rows
    return rows


def stream(spark: SparkSession, requests: list[str], paging: str = "token", schema: str | None = None, **options) -> DataFrame:
    register(spark)
    return _reader(spark.readStream, requests, paging, schema, options)


def search(spark: SparkSession, expression: str, start: int = 0, results: int = 100, schema: str | None = None, **options) -> DataFrame:
    """Rows start to start + results of a search, MOST_RESULTS at most; a blank expression asks for the default category."""
    return read(spark, [expression or "cat:cs.LG"], "offset", schema, start=str(start), results=str(min(results, MOST_RESULTS)), **options)


def submissions(spark: SparkSession, venues: list[str], start: int = 0, limit: int | None = None, schema: str | None = None, **options) -> DataFrame:
    """Submissions of each venue under the first invitation that has any, from start on, limit of them if given."""
    asked = ["|".join(f"{v}/-/{kind}" for kind in ("Submission", "Blind_Submission", "blind-submission")) for v in venues]
    more = {} if limit is None else {"results": str(limit)}
    return read(spark, asked, "token", schema, start=str(start), **more, **options)


# ---------------------------------------------------------------- writing pages


def land(records: DataFrame, path: str, order: list[Column | str], size: int = 100, paging: str = "token", request: str = "request") -> None:
    """Writes records as the pages of a feed: `request` says whose pages, the other columns are the record. A page has `size` records, a file many pages."""
    fields = [c for c in records.columns if c != request]
    rows = placed(records.where(F.col(request).isNotNull()), request, order)
    rows = rows.select(request, F.floor(F.col("place") / size).cast("bigint").alias("n"), "place", F.to_json(F.struct(*fields)).alias("record"))
    pages = rows.groupBy(request, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "record"))), lambda r: r["record"]).alias("data"))
    totals = rows.groupBy(request).agg(F.count("*").alias("total"))

    def file(n: Column) -> Column:
        return F.floor(n / bundled(size)).cast("bigint")

    def key(n: Column) -> Column:
        opaque = F.when(n == 0, F.lit(FIRST)).otherwise(F.substring(F.sha2(F.concat_ws("/", request, n.cast("string")).cast("binary"), 256), 1, 16))
        opaque = F.when(n == 0, opaque).otherwise(F.concat(opaque, F.lit("-"), file(n).cast("string")))
        return opaque if paging == "token" else n.cast("string")

    follows = F.when((F.col("n") + 1) * size < F.col("total"), key(F.col("n") + 1))
    token = F.coalesce(F.concat(F.lit('"'), follows, F.lit('"')), F.lit("null"))
    text = F.concat(F.lit('{"total": '), F.col("total").cast("string"), F.lit(', "token": '), token, F.lit(', "data": ['), F.array_join("data", ", "), F.lit("]}"))
    out = pages.join(totals, request).select(F.col(request).alias("request"), file(F.col("n")).alias("bundle"), F.concat(key(F.col("n")), F.lit("\t"), text).alias("value"))
    out.repartition("request", "bundle").write.mode("append").partitionBy("request", "bundle").text(path)
