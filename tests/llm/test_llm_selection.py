"""Url filters, fill-in-the-middle texts and hard negatives against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import op11_urls, op12_fim, op13_negatives

# ---------------------------------------------------------------- urls

URLS = [
    None, "", "no address", "http://", "http:///en/x", "HTTP://WWW.Example.com/en/1", "https://example.com/en/2?utm_source=feed", "https://m.example.com/en/", "https://badexample.com/en/3", "https://example.com/EN/3",
    "https://a.b.net/es/4#top", "https://net/fr/5", "https://x.net/de/6", "https://x.com", "https://x.com?q=/", "https://x.org/en/7", "ftp://casino-win.example.org/en/8/", "http://www.casino-win.example.org:80/en/8?ref=x", "http://CASINO-win.example.org/en/8?b=2&a=1&utm_id=3",
    "http://casino-win.example.org/en/8?a=1&b=2#z", "http://casinos.example.org/en/8", "https://ünïcode.ÉXAMPLE.com/ü?ä=ö", "a://b://c.com/d", "https://user@x.com:8080/p", "http://x.org/?ref", "http://x.org/?reference=1", "http://x.org/a//", "x" * 100_000 + "://y.com/" + "/" * 100_000,
]
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?", rest)
    return m[1].translate(ASCII_LOWER), m[2], m[3] or ""


def plain_canonical(url):
    host, path, asked = plain_parts(url)
    name = re.sub(r":(80|443)\Z", "", re.sub("^www\\.", "", host))
    kept = sorted(p for p in asked.split("&") if p and not re.match(r"(utm_[^=]*|ref|fbclid|gclid)(=|\Z)", p))
    return name + path.rstrip("/") + ("?" + "&".join(kept) if kept else "") if name else None


def plain_rule(host, path, rules=op11_urls.RULES):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def judged(spark, urls, listed):
    rows = spark.createDataFrame([(i, u, "x", True) for i, u in enumerate(urls)], "page_id int, url string, host string, listed boolean")
    listed = spark.createDataFrame([(u,) for u in listed], "url string")
    return {r.page_id: r for r in op11_urls.judge(rows, listed).collect()}


@pytest.mark.parametrize("most", [0, 200_000])
def test_urls_against_plain_rules(spark, monkeypatch, most):
    monkeypatch.setattr(op11_urls, "BROADCAST_BLOCKS", most)
    listed = ["http://casino-win.example.org/en/8", "https://x.org/en/7", None, "nothing"]
    on = {plain_canonical(u) for u in listed} - {None}
    rows = judged(spark, URLS + URLS[5:9], listed)
    for i, url in enumerate(URLS + URLS[5:9]):
        (host, path, _), key = plain_parts(url), plain_canonical(url)
        rule = plain_rule(host, path)
        verdict = rule.verdict if rule else "block" if key in on else "allow"
        assert (rows[i].host, rows[i].path, rows[i].canonical, rows[i].listed, rows[i].verdict) == (host, path, key, key in on, verdict), url
        assert rows[i].rule == (rule and rule.text)
    assert sum(r.listed for r in rows.values()) == 3


def test_urls_of_an_empty_list_or_table(spark):
    assert not any(r.listed for r in judged(spark, URLS, []).values())
    assert judged(spark, [], ["http://x.com/"]) == {}


@pytest.mark.parametrize("n", [1, 40, 20_000])
def test_filter_passes_every_listed_key_and_few_others(spark, n):
    listed = spark.range(n).select(F.concat(F.lit("host.example/"), "id").alias("listed"))
    rows = spark.range(3 * n + 2000).select(F.concat(F.lit("host.example/"), "id").alias("key"), (F.col("id") < n).alias("is_on"))
    out = op11_urls.with_may(rows, "key", listed, n)
    assert out.where("is_on and not __may").count() == 0
    assert out.where("not is_on and __may").count() <= 0.01 * (2 * n + 2000)


def test_unwanted_hosts_are_parts_of_names(spark):
    rows = spark.createDataFrame([("http://ads.x.com/",), ("http://www.free-BETS.org/1",), ("http://adsx.com/ads",), (None,)], "url string")
    assert op11_urls.unwanted(rows).count() == 2


# ---------------------------------------------------------------- fill in the middle

UNITS = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain_fim(doc_id, text):
    text = text or ""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNITS.findall(text)
    assert "".join(units) == text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts(seed, n):
    rng = random.Random(seed)
    alphabet = ["a", "b", "Z", " ", "\n", "é", "ß", "中", "😀", "\u0301", "\x00", "<", ">", "P", "S", "M", "ab" * 40, "7"]
    return [None, "", "a", "é", "<P>", "a<S", "<M", "word " * 30_000, "w" * 70_000, "中" * 20_000, *("".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(n))]


def test_fill_in_middle_against_plain_units(spark):
    texts = odd_texts(1, 500)
    rows = [(None if i == 3 else i, t, "kept", 1) for i, t in enumerate(texts + texts[:5])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, output string, cut int").repartition(3)
    made = op12_fim.transform(docs)
    assert set(made.columns) == {"doc_id", "text", "output", "cut", "n", "form", "prefix_chars", "middle_chars"}
    out = made.withColumn("back", op12_fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.cut == 1
    assert {r.form for r in out} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 4096])
def test_chunks_cut_where_whole_texts_are_cut(size):
    rng = np.random.default_rng(size)
    texts = [t or "" for t in odd_texts(size, 200) if size > 3 or len(t or "") < 1000]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    h1, h2 = rng.integers(0, 1 << 32, (2, len(texts)))
    n, a, b = op12_fim.cut(data, offsets, h1, h2, size)
    for i, text in enumerate(texts):
        units = UNITS.findall(text)
        lo, hi = sorted((h1[i] % (len(units) + 1), h2[i] % (len(units) + 1)))
        assert (n[i], a[i], b[i]) == (len(units), len("".join(units[:lo])), len("".join(units[:hi])))


def test_fill_in_middle_of_no_rows(spark):
    assert op12_fim.digest(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


# ---------------------------------------------------------------- hard negatives


def plain_negatives(rows, anchors, positives=5, negatives=5, least=80, most=100):
    one = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [max(-(1 << 24), min(1 << 24, math.floor(256 * x))) for x in v]
        one[i] = min(one.get(i, (label, whole)), (label, whole))
    width = max((len(v) for _, v in one.values()), default=0)
    ids = sorted(one)
    m = np.array([one[i][1] + [0] * (width - len(one[i][1])) for i in ids], object).reshape(len(ids), width)
    out = []
    for k, i in enumerate(ids):
        if not anchors(i):
            continue
        score = [int(s) for s in (m @ m[k] if width else [0] * len(ids))]
        order = sorted((j for j in range(len(ids)) if j != k), key=lambda j: (-score[j], ids[j]))
        for p in [j for j in order if one[ids[j]][0] == one[i][0]][:positives]:
            fits = [j for j in order if one[ids[j]][0] != one[i][0] and least * score[p] <= 100 * score[j] <= most * score[p]]
            out += [(i, ids[p], r, ids[j], score[p], score[j]) for r, j in enumerate(fits[:negatives], 1)]
    return sorted(out)


def family(seed, n, width=8, labels=4, copies=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, width))
    v = centres[rng.integers(0, 3, n)] + 0.4 * rng.normal(size=(n, width))
    v[rng.random(n) < copies] = v[0]
    return [(int(i), [float(x) for x in np.float32(r)], int(rng.integers(0, labels))) for i, r in enumerate(v)]


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id bigint, embedding array<float>, label int, id string, d int").repartition(3)
    got = op13_negatives.mine(table, F.col("id") % 10 == 0, **options).collect()
    return sorted(tuple(r) for r in got)


@pytest.mark.parametrize(("copies", "chunk", "pivots"), [(0.0, 8192, 16), (0.35, 7, 16), (0.9, 8192, 1)])
def test_negatives_against_all_pairs(spark, copies, chunk, pivots):
    rows = family(3, 600, copies=copies)
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows, chunk=chunk, most_pivots=pivots) == want
    assert len(want) > 500


def test_negatives_of_odd_rows(spark):
    rows = family(5, 60)
    rows += [rows[3], rows[10], (10, rows[11][1], 3), (12, rows[12][1], None), (None, rows[1][1], 1), (61, None, 1), (62, [], 2), (63, [1.0, None] + [0.0] * 6, 1), (64, [float("nan")] * 8, 1), (65, [float("inf")] + [0.0] * 7, 1), (66, [1.0], 1), (70, [0.0] * 8, 2), (80, [1e30, -1e30] + [1.0] * 6, 0), (90, [1e30, 0.5], 0), (-10, rows[0][1], 7)]
    assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows, positives=1, negatives=2, least=50, most=90) == plain_negatives(rows, lambda i: i % 10 == 0, 1, 2, 50, 90)


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, [], 1), (1, [], 1), (2, [], 2)], [(0, [1.0, 2.0], 1), (10, [1.0, 2.0], 1)]])
def test_negatives_of_few_rows(spark, rows):
    assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_brackets_hold_and_spare_products():
    """No pair outside its bracket; of clustered vectors most are never multiplied."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16)) * 500
    of = np.sort(rng.integers(0, 12, 4000))
    v = np.floor(centres[of] + rng.normal(size=(4000, 16)) * 20).astype(np.int64)
    square = float((v * v).sum(1).max())
    pivots = op13_negatives.Pivots.of(v[::7], square)
    d, ids, labels = pivots.distances(v), np.arange(4000), rng.integers(0, 3, 4000)
    q = ids[::100]
    search = op13_negatives.Search(q, labels[q], v[q].astype(float), pivots, np.full((40, 1), -(1 << 62)), np.full((40, 1), 1 << 62), 5, True, True)
    lo, hi = search.bracket(np.abs(search.d[:, None] - d[None]).max(2), (search.d[:, None] + d[None]).min(2), search.square[:, None])
    exact = v[q] @ v.T
    assert (lo <= exact).all() and (exact <= hi).all()
    search.start(ids[::7], labels[::7], v[::7])
    for i in range(0, 4000, 500):
        search.offer(ids[i : i + 500], labels[i : i + 500], v[i : i + 500], d[i : i + 500])
        search.settle()
    assert search.multiplied < 0.25 * 4000 * 40 / 3
    at, _, score, found = search.result()
    for k, anchor in enumerate(q):
        order = sorted((j for j in range(4000) if j != anchor and labels[j] == labels[anchor]), key=lambda j: (-exact[k, j], j))[:5]
        assert found[at == k].tolist() == order and score[at == k].tolist() == [exact[k, j] for j in order]
