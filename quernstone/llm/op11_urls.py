"""URL filters: host and path rules, and a blocked Bloom filter of listed addresses before an exact join, in DataFrame functions only.

A rule judges all urls of its host and of the subdomains whose path starts with the rule's; the longest one that fits wins. Urls
that no rule fits are judged by a list of addresses in canonical form. A Bloom filter of the list, cut into blocks of 256 bits so that
an address touches one row of it, passes every listed address and few others; only what it passes is joined with the list
itself, which removes the false positives. So the rows that meet the list, the large side of the comparison, are those that may be on it.

The filter is a table (block, four words), built by one aggregate with bitwise or. Up to BROADCAST_BLOCKS blocks of 40 bytes it is
broadcast; a larger one is joined by block, which spreads the addresses over as many keys as there are blocks, and
a page that occurs very often is split by AQE as in any join. The list itself is never broadcast by force.

Defined results: a NULL url, and one without "://", has an empty host, an empty path and a NULL canonical form, and is on no list; a NULL
id, repeated ids and repeated urls give a row each; equal rules are one, rules of equal length go by their text; an empty list
blocks nothing; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm._common import materialise


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))

#: Parts of host names that put the addresses of the host on the list.
UNWANTED = ("adult", "ads", "bets", "casino", "pills", "spam")

#: Query parameters that name a visit and no page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|\z)"

#: Blocks of the filter (256 bits each) up to which it is broadcast: 8 MB. Beyond it the same join shuffles.
BROADCAST_BLOCKS = 200_000
#: Addresses of a block, on average: 16 bits for each, of which 8 are set.
PER_BLOCK = 16
_WORDS = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first "://"; nothing where there is none."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The address without what doesn't change the page: scheme, "www.", default port, slashes at the path's end, tracking parameters, the
    others' order, fragment. NULL without a host."""
    name = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)\z", "")
    given = F.filter(F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    asked = F.array_join(F.array_sort(given), "&")
    return F.when(name != "", F.concat(name, F.rtrim(path(url), F.lit("/")), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise("")))


def fits(rule: Rule, host_col: Column, path_col: Column) -> Column:
    return ((host_col == rule.host) | F.endswith(host_col, F.lit("." + rule.host))) & F.startswith(path_col, F.lit(rule.path))


def ruled(rules: tuple[Rule, ...], host_col: Column, path_col: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, else NULL."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(set(rules), key=lambda r: (len(r.text), r.text)):
        out = F.when(fits(rule, host_col, path_col), F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def unwanted(urls: DataFrame, words: tuple[str, ...] = UNWANTED, url_col: str = "url") -> DataFrame:
    """(url): those on hosts of which a part, between dots and hyphens, is one of the words."""
    return urls.select(F.col(url_col).alias("url")).where(F.arrays_overlap(F.split(host(F.col("url")), "[.-]"), F.array(*[F.lit(w) for w in words])))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """For each word of a block the two bits that the key sets."""
    bits = F.xxhash64(key, F.lit(1))

    def bit(i: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int"))

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(_WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 to w3): the filter of the column `listed`. A block without an address has no row."""
    masked = listed.select(_block(F.col("listed"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("listed")))])
    return masked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)])


def with_may(rows: DataFrame, key: str, listed: DataFrame, n: int) -> DataFrame:
    """rows with the boolean __may: false only if the filter says that the key is not among the n listed ones."""
    blocks = max(1, -(-n // PER_BLOCK))
    words = bloom(listed, blocks).withColumnRenamed("block", "__block")
    words = F.broadcast(words) if blocks <= BROADCAST_BLOCKS else words
    met = None
    for i, mask in enumerate(_masks(F.col(key))):
        one = F.col(f"w{i}").bitwiseAND(mask) == mask
        met = one if met is None else met & one
    out = rows.withColumn("__block", _block(F.col(key), blocks)).join(words, "__block", "left")
    return out.withColumn("__may", F.col(key).isNotNull() & F.coalesce(met, F.lit(False))).drop("__block", *[f"w{i}" for i in range(_WORDS)])


def judge(pages: DataFrame, listed_urls: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, canonical, listed): verdict is the rule's, else block for a listed address and allow for others.

    rules are few: each is a branch of one expression. listed_urls (url) may be of any size.
    """
    listed = materialise(listed_urls.select(canonical(F.col("url")).alias("listed")).where("listed is not null").distinct(), "listed")
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias(id_col), host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical"))
    rows = with_may(rows, "canonical", listed, listed.count())
    apart = rows.where(~F.col("__may")).withColumn("listed", F.lit(False))
    found = rows.where("__may").join(listed.withColumnRenamed("listed", "__listed"), F.col("canonical") == F.col("__listed"), "left")
    found = found.withColumn("listed", F.col("__listed").isNotNull()).drop("__listed")
    both = apart.unionByName(found).withColumn("__rule", ruled(rules, F.col("host"), F.col("path")))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return both.select(id_col, "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "canonical", "listed")
