"""Secret scanning through a trigram inverted index, in DataFrame functions only.

Each rule's regex is parsed on the driver into a Boolean query over trigrams that every match must
hold. A document-partitioned inverted index (block, trigram, postings) is built over all texts. The
query of each rule intersects and unites postings block by block, and only the candidates are verified
by the regex itself. A rule without mandatory trigrams is verified on every text.

Positions and redaction take time in proportion to the text and, for n matches in one text, to n times the root of n.

Defined results: a NULL text is empty; a NULL doc_id is never in the index and is always verified; ids may be of any type
that can be compared; repeated rows give repeated rows; equal starts are ordered by the rules' order; an empty table gives an
empty result; other columns are ignored, whatever their names; a column named as the result is kept, and the
result takes that name with "_" behind it.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm._common import free_name, materialise

#: A query in disjunctive form: one of the sets must be there as a whole. {{}} holds for every text.
Query = frozenset
TRUE: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Rule:
    """kind:start:end is reported for a match whose group has at least min_length characters; scan is the regex that finds them."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1
    guard: str = ""


#: Fixed values of the contract.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16, guard=r"[0-9a-f]{16}"),
)
#: What the method adds to them.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

#: Candidate ids up to this count (8 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_IDS = 500_000
#: Rows of one block of the index: what one task holds when it intersects postings.
BLOCK_ROWS = 20_000
_MOST_STRINGS = 64


def _minimal(clauses) -> Query:
    """Without clauses that another clause implies."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _and(a: Query, b: Query) -> Query:
    return _minimal({x | y for x in a for y in b})


def _trigrams(strings: set[str]) -> Query:
    """Holds wherever one of the strings stands."""
    return _minimal({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _item(op, av) -> tuple[set[str] | None, Query]:
    """The strings that the item stands for, if they are few, and a query that its matches meet."""
    if op is sre.LITERAL:
        return {chr(av).lower()}, TRUE
    if op is sre.IN and av[0][0] is not sre.NEGATE and all(x is sre.LITERAL for x, _ in av) and len(av) <= 8:
        return {chr(c).lower() for _, c in av}, TRUE
    if op is sre.SUBPATTERN:
        return _sequence(av[3])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in av[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= _MOST_STRINGS:
            return set().union(*(e for e, _ in parts)), TRUE
        return None, _minimal(set().union(*(_and(q, _trigrams(e)) if e is not None else q for e, q in parts)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, sub = av
        exact, query = _sequence(sub)
        if exact is not None and (least, most) == (0, 1):
            return exact | {""}, TRUE
        if exact is not None and least == most and len(exact) ** least <= _MOST_STRINGS:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in exact}
            return out, TRUE
        return None, TRUE if not least else _and(query, _trigrams(exact)) if exact is not None else query
    if op is sre.AT:
        return {""}, TRUE
    return None, TRUE


def _sequence(items) -> tuple[set[str] | None, Query]:
    query, strings, whole = TRUE, {""}, True
    for op, av in items:
        exact, q = _item(op, av)
        if exact is not None and len(strings) * len(exact) <= _MOST_STRINGS:
            strings = {a + b for a in strings for b in exact}
            continue
        query, whole = _and(_and(query, _trigrams(strings)), q), False
        strings = exact if exact is not None else {""}
    return (strings, query) if whole else (None, _and(query, _trigrams(strings)))


def trigram_query(pattern: str, most_terms: int = 4) -> Query:
    """What every match of the pattern holds, in lower case. A clause keeps at most most_terms trigrams, spread over it: fewer terms only widen the candidates."""
    strings, query = _sequence(sre_parse.parse(pattern))
    query = _and(query, _trigrams(strings)) if strings is not None else query

    def thin(clause):
        terms = sorted(clause)
        step = max(1, -(-len(terms) // most_terms))
        return frozenset(terms[::step])

    return _minimal({thin(c) for c in query})


#: Letters by how often English has them, the rarest last; what is no letter is rarer still.
_FREQUENT = "etaoinsrhldcumfpgwybvkxjqz"


def anchor(clause: frozenset) -> str:
    """The trigram of a clause that is the rarest in prose, by its letters."""
    return max(sorted(clause), key=lambda t: sum(_FREQUENT.index(c) if c in _FREQUENT else len(_FREQUENT) for c in t))


def held_trigrams(text: Column, clauses: list[frozenset]) -> Column:
    """Those trigrams of the clauses that the lower-cased text holds; of a clause whose rarest the text lacks, which it cannot meet, none is looked for."""
    by_anchor: dict[str, set] = {}
    for clause in clauses:
        by_anchor.setdefault(anchor(clause), set()).update(clause)

    def found(low: Column) -> Column:
        of = [F.when(F.contains(low, F.lit(a)), F.filter(F.array(*[F.lit(t) for t in sorted(terms)]), lambda t: F.contains(low, t))) for a, terms in sorted(by_anchor.items())]
        return F.array_distinct(F.flatten(F.array_compact(F.array(*of))))

    return let(F.lower(text), found)


def build_index(docs: DataFrame, clauses: list[frozenset], id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, trigram, postings): the sorted ids of the block's documents that hold the trigram and the rarest one of a clause that it is in.

    A block is a hash range of ids, so that a trigram of every document is spread over all blocks.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    blocks = max(1, -(-rows.count() // block_rows))
    held = rows.select("id", held_trigrams(F.col("text"), clauses).alias("held"))
    postings = held.select((F.pmod(F.xxhash64("id"), F.lit(blocks))).alias("block"), "id", F.explode("held").alias("trigram"))
    return postings.groupBy("block", "trigram").agg(F.array_sort(F.collect_set("id")).alias("postings"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(id, kinds): the ids that meet each rule's query, by intersecting postings within each block."""
    none = F.array().cast(index.schema["postings"].dataType)
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "postings"))).alias("of"))

    def posted(t: str) -> Column:
        return F.coalesce(F.try_element_at("of", F.lit(t)), none)

    def met(query: Query) -> Column:
        out = None
        for clause in sorted(query, key=sorted):
            one = None
            for t in sorted(clause):
                one = posted(t) if one is None else F.array_intersect(one, posted(t))
            out = one if out is None else F.array_union(out, one)
        return out

    def named(kind: str, query: Query) -> Column:
        return F.transform(met(query), lambda x: F.struct(x.alias("id"), F.lit(kind).alias("kind")))

    found = [named(k, q) for k, q in queries.items()]
    flat = blocks.select(F.explode(F.concat(*found)).alias("c")).select("c.id", "c.kind")
    return flat.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


# ---------------------------------------------------------------- positions

SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
#: Code points of the pieces that a long text is cut into before parts of it are taken.
PIECE = 1024


def let(value: Column, body) -> Column:
    """body of the value, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join) -> Column:
    """For each value the join (a sum or a maximum, of 0 at least) of all values up to it.

    Blocks of about the root of their number are joined first, so that no value is looked at more often than that.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), join)

    def blocked(x: Column) -> Column:
        v, size = x["v"], x["size"]
        sums = F.transform(F.sequence(F.lit(0), F.greatest(((F.size(v) - 1) / size).cast("int"), F.lit(0))), lambda b: total(F.slice(v, b * size + 1, size)))
        before = let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
        each = lambda p: F.transform(v, lambda _, i: join(p[(i / size).cast("int")], total(F.slice(v, (i / size).cast("int") * size + 1, i % size + 1))))
        return let(before, each)

    bound = let(values, lambda v: F.struct(v.alias("v"), F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int").alias("size")))
    return let(bound, blocked)


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, rank, end, kind) of the rule's matches, in code points.

    The lengths of the pieces between the matches, from split(), and of the matches add up to the positions.
    """
    whole, group = (F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)), lambda x: F.length(x).cast("bigint")) for g in (0, rule.group))
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("bigint"))

    def placed(x: Column) -> Column:
        ends = running(F.zip_with(F.slice(x["b"], F.lit(1), F.size(x["m"])), x["m"], lambda b, m: b + m), lambda a, b: a + b)
        spans = F.transform(F.arrays_zip(ends.alias("e"), x["m"].alias("m"), x["g"].alias("g")), lambda s: F.struct((s["e"] - s["m"]).alias("start"), F.lit(order).alias("rank"), s["e"].alias("end"), F.lit(rule.kind).alias("kind"), s["g"].alias("g")))
        long = F.filter(spans, lambda s: s["g"] >= rule.min_length)
        return F.transform(long, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))

    return F.when(text.rlike(rule.guard or rule.pattern), let(F.struct(between.alias("b"), whole.alias("m"), group.alias("g")), placed)).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS, block_rows: int = BLOCK_ROWS, spans_col: str | None = None) -> DataFrame:
    """docs with a column behind its own: the sorted array of (start, rank, end, kind) of all rules' matches. Its name is spans_col, or `spans`
    lengthened until no column has it."""
    columns = docs.columns
    id_, kinds = (free_name(x, columns) for x in ("candidate_id", "candidate_kinds"))
    spans_col = spans_col or free_name("spans", columns)
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != TRUE}
    clauses = sorted({c for q in queries.values() for c in q}, key=sorted)
    if queries:
        found = materialise(candidates(build_index(docs, clauses, id_col, text_col, block_rows), queries), "secret-candidates")
        found = found.withColumnRenamed("id", id_).withColumnRenamed("kinds", kinds)
        found = F.broadcast(found) if found.count() <= broadcast_ids else found
        docs = docs.join(found, F.col(id_col) == F.col(id_), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = []
    for order, rule in enumerate(rules):
        spans = rule_spans(text, rule, order)
        parts.append(spans if rule.kind not in queries else F.when(F.col(id_col).isNull() | F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False)), spans).otherwise(F.array().cast(SPANS)))
    return docs.select(*columns, F.array_sort(F.concat(*parts)).alias(spans_col))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span that no earlier one overlaps replaced by <KIND>.

    The text is cut into pieces once; what stands between two spans is taken from the few pieces that it lies in.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def part(of: Column, begin: Column, end: Column) -> Column:
        first, last = (begin / PIECE).cast("int"), (end / PIECE).cast("int")
        return F.substr(F.array_join(F.slice(of, first + 1, last - first + 1), ""), (begin % PIECE + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))

    def replaced(x: Column) -> Column:
        of, s = x["of"], x["s"]
        reach = running(F.transform(s, lambda v: v["end"]), lambda a, b: F.greatest(a, b))

        def built(r: Column) -> Column:
            before = F.concat(F.array(F.lit(0).cast("bigint")), r)
            kept = F.filter(F.arrays_zip(s.alias("s"), F.slice(before, F.lit(1), F.size(s)).alias("at")), lambda v: v["s"]["start"] >= v["at"])
            said = F.transform(kept, lambda v: F.concat(part(of, v["at"], v["s"]["start"]), F.lit("<"), F.upper(v["s"]["kind"]), F.lit(">")))
            return F.concat(F.array_join(said, ""), part(of, F.element_at(r, -1), x["n"]))

        return let(reach, built)

    return let(F.struct(pieces.alias("of"), spans.alias("s"), F.length(text).cast("bigint").alias("n")), replaced)


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """docs, as scan() returns them, with each span that no earlier one overlaps replaced by <KIND>; without the spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    clean = F.when(F.size(spans_col) > 0, redacted(text, F.col(spans_col))).otherwise(F.col(text_col))
    return docs.withColumn(text_col, clean).drop(spans_col)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    base = [r.kind for r in BASE_RULES]
    found = scan(docs.select("doc_id", "text"))
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in base], F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
