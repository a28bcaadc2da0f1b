"""Document fingerprints from prefix polynomial hashes.

A text of code points c has, for each of two prime moduli, the prefix array H[i] = sum of c[j] B^j for
j < i; (H[j] - H[i]) B^-i is the hash of any span, so two spans are compared in constant time and the
longest common extension of two positions is found by binary search.

A fingerprint holds the hash of the whole text, its length, the hashes of its beginnings and of its ends of fixed lengths (8 code points,
and each a quarter longer than the one before), and the smallest span hash in each of 32 classes over all spans of eight
code points. Equal texts have equal fingerprints. Two fingerprints give the common beginning and the common end of
their texts, to the next fixed length, by binary search over span equality: a beginning that two texts share is one of all
shorter lengths. The likeness of two fingerprints is the larger of the share of the longer text that these two
extensions cover and the share of equal classes, which estimates the likeness of the sets of spans wherever they stand.

Defined results: a NULL text is empty; an empty text's fingerprint has empty classes only, and is like another
empty one (1.0) and nothing else; texts shorter than a span have one span, the whole; rows with a NULL doc_id
come last in descending order; rows of one doc_id are ordered by their text's hash, so that repeated rows have
equal texts next to them and get the same results except the last; a single row is its own next; an
empty table gives an empty result; other columns are ignored. Ids are whole numbers.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two primes below 2^31 and a base for each: products of residues fit 64 bits.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
SPAN, CLASSES = 8, 32
_EMPTY = "-" * 4
#: Hex digits of a beginning's or end's hash in a fingerprint, and bytes of text that one zone of the query holds, about.
_DIGITS, ZONE_BYTES = 6, 64 << 20


def _mod(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p; numpy divides by a scalar faster than it takes remainders."""
    q = np.uint64(p)
    return x - x // q * q


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """B^i and B^-i for each modulus, i up to n at least; grown by doubling."""
    if not _tables or len(_tables[0][0]) <= n:
        _tables.clear()
        for p, b in zip(PRIMES, BASES):
            pair = []
            for x in (b, pow(b, -1, p)):
                out = np.ones(1, np.uint64)
                while len(out) <= max(n, 1 << 14):
                    out = np.concatenate([out, _mod(out * np.uint64(pow(x, len(out), p)), p)])
                pair.append(out)
            _tables.append(tuple(pair))
    return _tables


class Prefix:
    """Prefix arrays of a text."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.tables = _powers(self.n)
        self.sums = []
        for p, (power, _) in zip(PRIMES, self.tables):
            terms = _mod((codes.astype(np.uint64) + np.uint64(1)) * power[: self.n], p)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])  # fits for any text below 2^33 code points
            self.sums.append(_mod(sums, p))

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each span [begin, end): both residues in one 62-bit number."""
        out = []
        for p, (_, inverse), sums in zip(PRIMES, self.tables, self.sums):
            out.append(_mod(_mod(sums[end] + np.uint64(p) - sums[begin], p) * inverse[begin], p))
        return out[0] << np.uint64(31) | out[1]

    def span(self, begin: int, end: int) -> int:
        return int(self.spans(np.array([begin]), np.array([end]))[0])


def same(a: Prefix, i: int, b: Prefix, j: int, length: int) -> bool:
    """Whether `length` code points from i of a are those from j of b."""
    return i + length <= a.n and j + length <= b.n and a.span(i, i + length) == b.span(j, j + length)


def longest_common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """How many code points from i of a agree with those from j of b: binary search over span equality."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if same(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@functools.cache
def cuts(n: int) -> np.ndarray:
    """The fixed lengths of beginnings and ends up to n: 8, and each a quarter longer than the one before."""
    out, at = [], SPAN
    while at <= n:
        out.append(at)
        at += at // 4
    return np.array(out, np.int64)


def fingerprint(codes: np.ndarray) -> str:
    """<hash of the whole, 16 hex digits>:<length, hex>:<beginnings>:<ends, 6 hex digits each>:<32 classes of 4 hex digits, ---- if empty>."""
    prefix = Prefix(codes)
    n = prefix.n
    whole = prefix.span(0, n)
    if n <= SPAN:
        spans = np.array([whole] if n else [], np.uint64)
    else:
        begin = np.arange(n - SPAN + 1)
        spans = prefix.spans(begin, begin + SPAN)
    least = np.full(CLASSES, 2**64 - 1, np.uint64)
    mixed = _mixed(spans)
    of = (mixed & np.uint64(CLASSES - 1)).astype(np.int64)
    np.minimum.at(least, of, mixed >> np.uint64(5))
    with np.errstate(over="ignore"):
        short = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    classes = "".join(_EMPTY if m == 2**64 - 1 else f"{s:04x}" for m, s in zip(least.tolist(), short.tolist()))
    at = cuts(1 << max(n, 1).bit_length())
    at = at[at <= n]
    parts = _mixed(prefix.spans(np.concatenate([np.zeros(len(at), np.int64), n - at]), np.concatenate([at, np.full(len(at), n)]))) >> np.uint64(64 - 4 * _DIGITS)
    ends = ["".join(f"{x:0{_DIGITS}x}" for x in part.tolist()) for part in (parts[: len(at)], parts[len(at) :])]
    return f"{whole:016x}:{n:x}:{ends[0]}:{ends[1]}:{classes}"


def _mixed(spans: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (spans ^ spans >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ mixed >> np.uint64(32)


def extent(a: str, b: str) -> int:
    """The longest fixed length at which two lists of beginnings (or ends) agree, by binary search: they agree at all shorter ones."""
    low, high = 0, min(len(a), len(b)) // _DIGITS
    while low < high:
        middle = (low + high + 1) // 2
        span = slice((middle - 1) * _DIGITS, middle * _DIGITS)
        low, high = (middle, high) if a[span] == b[span] else (low, middle - 1)
    return int(cuts(1 << 40)[low - 1]) if low else 0


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of the longer text that the common beginning and end cover, or that of equal classes among those that a span of either text is in."""
    if a == b:
        return 1.0
    x, y = a.split(":"), b.split(":")
    longer = max(int(x[1], 16), int(y[1], 16), 1)
    covered = min(extent(x[2], y[2]) + extent(x[3], y[3]), min(int(x[1], 16), int(y[1], 16))) / longer
    pairs = [(x[4][i : i + 4], y[4][i : i + 4]) for i in range(0, 4 * CLASSES, 4)]
    used = [(p, q) for p, q in pairs if p != _EMPTY or q != _EMPTY]
    return max(covered, sum(p == q for p, q in used) / len(used) if used else 0.0)


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def borders(rows: DataFrame, pieces: int | None = None, zone_bytes: int = ZONE_BYTES) -> list[tuple[int | None, int]]:
    """Where zones begin but the first, in the order of rows: (doc_id, hash), each the first place of a zone. rows: (doc_id, hash, text).

    There are as many zones as keep each to about zone_bytes of text. They are cut at quantiles of the ids; an id that several quantiles fall
    on, and the rows without an id, are cut by hash into as many.
    """
    spark = rows.sparkSession
    size = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("known"), F.sum(F.octet_length("text") + F.lit(64)).alias("bytes")).first()
    if not size["n"]:
        return []
    pieces = pieces or max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["bytes"] // zone_bytes))
    shares = lambda n: [-(2**63) + (2**64 * i) // n for i in range(n)]
    out: list[tuple[int | None, int]] = []
    if size["known"]:
        of = max(1, round(pieces * size["known"] / size["n"]))
        found = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / of) for i in range(1, of)] or [F.lit(0.5)]), F.lit(20 * of)).alias("c")).first()["c"] if of > 1 else []
        for doc_id, times in sorted(Counter(found).items(), reverse=True):
            out += [(doc_id, h) for h in shares(times)]
    nulls = size["n"] - size["known"]
    if nulls:
        out += [(None, h) for h in shares(max(1, round(pieces * nulls / size["n"])))]
    return out


def zone_of(at: list[tuple[int | None, int]]) -> Column:
    """The number of borders at or before a row (doc_id, hash), found among the first borders of groups and then within one group."""
    if not at:
        return F.lit(0)
    entry = lambda b: F.struct(F.lit(b[0]).cast("bigint").alias("i"), F.lit(b[1]).cast("bigint").alias("h"))
    step = max(1, int(len(at) ** 0.5))
    groups = [at[i : i + step] for i in range(0, len(at), step)]
    own, h = F.col("doc_id").cast("bigint"), F.col("hash")

    def behind(b: Column) -> Column:
        """Whether the row is at the border or after it: ids fall, NULLs are last, hashes rise."""
        after = F.when(own.isNull(), b["i"].isNotNull()).otherwise(F.coalesce(own < b["i"], F.lit(False)))
        return after | (own.eqNullSafe(b["i"]) & (h >= b["h"]))

    passed = F.size(F.filter(F.array(*[entry(g[0]) for g in groups]), behind))
    last = F.element_at(F.array(*[F.array(*map(entry, g)) for g in groups]), F.greatest(passed, F.lit(1)))
    return F.when(passed == 0, 0).otherwise((passed - 1) * step + F.size(F.filter(last, behind)))


def with_next(docs: DataFrame, pieces: int | None = None) -> DataFrame:
    """(zone, extra, doc_id, hash, text): rows in zones of descending doc_id, sorted; each zone ends with a row that is the next zone's first, marked extra.

    Each row's text moves once; the first row of each zone, twice.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    zoned = rows.withColumn("zone", zone_of(borders(rows, pieces)).cast("int"))
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.bitwise_not("hash").alias("h"))).alias("k")
    firsts = sorted(zoned.groupBy("zone").agg(first).collect())  # a row a zone
    if not firsts:
        return zoned.select("zone", F.lit(False).alias("extra"), "doc_id", "hash", "text")
    # The first zone's first row follows the last zone.
    ends = [(r["k"]["doc_id"], ~r["k"]["h"], before["zone"]) for before, r in itertools.pairwise([firsts[-1], *firsts])]
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = spark.createDataFrame(ends, f"__first {kind}, __hash bigint, __before int")
    zoned = zoned.join(F.broadcast(last), F.col("doc_id").eqNullSafe(F.col("__first")) & (F.col("hash") == F.col("__hash")), "left")
    before = F.col("__before")
    own = F.struct(F.col("zone").alias("zone"), F.lit(False).alias("extra"))
    targets = F.when(before.isNotNull(), F.array(own, F.struct(before.alias("zone"), F.lit(True).alias("extra")))).otherwise(F.array(own))
    return zoned.withColumn("to", F.explode(targets)).select("to.zone", "to.extra", "doc_id", "hash", "text")


def compare(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    zoned = with_next(docs)
    dealt = zoned.repartition("zone").sortWithinPartitions("zone", "extra", F.col("doc_id").desc_nulls_last(), "hash")
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        import pyarrow as pa

        held = None  # zone, doc_id, text, fingerprint of a row whose next is still to come
        passed = False  # whether this zone's extra row has been met
        for batch in batches:
            out = []
            for zone, extra, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and held[0] != zone:
                    raise RuntimeError("a zone has no row that follows it")
                if extra and passed:  # repeated rows of the next zone's first id: the first of them follows
                    continue
                own = fingerprint(codes_of(text))
                if held is not None:
                    _, before, old, print_old = held
                    new = edited(old, text)
                    print_new = fingerprint(codes_of(new))
                    out.append((before, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), print_old, print_new, likeness(print_old, print_new), likeness(print_old, own)))
                held, passed = (None, True) if extra else ((zone, doc_id, text, own), False)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = arrow.names
    return dealt.select("zone", "extra", "doc_id", "text").mapInArrow(run, schema)
