"""Column -> Column rules for titles, keywords, venues and domains; no actions, no Python workers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone import lexicon


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def let(value: Column, body) -> Column:
    """body of the value, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_match(rules: list[tuple[str, Column]], default: Column | None = None) -> Column:
    """The label of the first condition that holds."""
    out = None
    for label, condition in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(default if default is not None else F.lit(None).cast("string"))


# ------------------------------------------------------------ titles


def normal_title(c: Column) -> Column:
    """White space collapsed and trimmed; NULL becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def title_key(c: Column) -> Column:
    return F.lower(normal_title(c))


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def title_tokens(title: Column) -> Column:
    """ASCII words of three or more letters; a word with any other letter, digit or mark in it is none."""
    words = F.split(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{M}\p{N}_]+")
    return F.filter(words, lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(lexicon.TITLE_STOPWORDS))


# ------------------------------------------------------------ keywords


def normal_keyword(c: Column) -> Column:
    """Lower case; hyphens, underscores and slashes are spaces; outer punctuation goes; empty is NULL."""
    k = F.regexp_replace(F.trim(F.lower(c)), r"[-_/]", " ")
    k = F.regexp_replace(F.regexp_replace(k, r"[,;:.!?'\")\]]+$", ""), r"^[(\[\"']+", "")
    k = F.trim(F.regexp_replace(k, r"\s+", " "))
    return F.nullif(k, F.lit(""))


def noisy_keyword(k: Column, least: int = 3, most: int = 60) -> Column:
    """Too short or long, numeric, mostly digits, or an address."""
    digits = F.length(F.regexp_replace(k, r"[^0-9]", ""))
    return (F.length(k) < least) | (F.length(k) > most) | k.rlike(r"^[0-9\s.,-]+$") | (digits * 2 > F.length(k)) | k.rlike(r"http|www|\.com|\.org|@")


def listed_keyword(k: Column, words: list[str] | None = None) -> Column:
    """Whether the keyword is on a word list, by default the engine's three."""
    return k.isin(sorted({*lexicon.BANNED_WORDS, *lexicon.STOPWORDS, *lexicon.DOMAIN_NOISE} if words is None else set(words)))


def synonym(k: Column, pairs: dict[str, str] | None = None) -> Column:
    pairs = lexicon.SYNONYMS if pairs is None else pairs
    if not pairs:
        return k
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), k), k)


def fit_keyword(k: Column, words: list[str] | None = None, least: int = 3, most: int = 60) -> Column:
    """Whether a normal form passes every filter."""
    return k.isNotNull() & ~noisy_keyword(k, least, most) & ~listed_keyword(k, words)


def clean_keyword(c: Column, words: list[str] | None = None, synonyms: dict[str, str] | None = None, least: int = 3, most: int = 60) -> Column:
    """Normal form of a keyword that passes every filter, by its main spelling; else NULL. Word list, spellings and lengths can be given."""
    k = normal_keyword(c)
    return F.when(fit_keyword(k, words, least, most), synonym(k, synonyms))


def valid_bucket_keyword(c: Column) -> Column:
    k = F.trim(F.lower(c))
    return F.coalesce(~k.rlike(r"^\d+$") & (F.length(k) > 2) & k.rlike(r"^[a-z][a-z\s-]*$"), F.lit(False))


def legacy_keyword(c: Column) -> Column:
    k = F.trim(F.lower(c))
    return F.when(F.length(k).between(2, 100), k)


def singular(k: Column) -> Column:
    """Without any s at the end."""
    return F.regexp_replace(k, "s+$", "")


# ------------------------------------------------------------ venues


def match_venue(c: Column) -> Column:
    """The first venue one of whose patterns is in the text."""
    return first_match([(name, F.coalesce(c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))) for name, patterns in lexicon.VENUE_PATTERNS])


def detect_venue(source: Column, venue_raw: Column, comments: Column, journal_ref: Column) -> Column:
    """struct(venue, confidence): the open-review venue itself, else the first match of venue_raw, comments and journal_ref."""
    raw, com, jou = (match_venue(c) for c in (venue_raw, comments, journal_ref))
    found = lambda v, p: F.struct(v.alias("venue"), F.lit(p).alias("confidence"))
    trusted = (source == "openreview") & ~blank(venue_raw)
    return F.when(F.coalesce(trusted, F.lit(False)), found(venue_raw, 1.0)).when(raw.isNotNull(), found(raw, 0.9)).when(com.isNotNull(), found(com, 0.7)).when(jou.isNotNull(), found(jou, 0.8)).otherwise(found(F.lit(None).cast("string"), 0.0))


def _dated_patterns(name: str, long_name: str | None) -> list[str]:
    # The forms in which a venue stands beside its year.
    names = ([name, "NIPS"] if name == "NeurIPS" else [name])
    out = [rf"{x}['\s]*(\d{{2,4}})" for x in names] + [rf"accepted\s+(?:by|at|to)\s+{name}['\s]*(\d{{2,4}})?"]
    if long_name:
        out.append(rf"{long_name}['\s]*(\d{{2,4}})?")
    return out


def full_year(digits: Column) -> Column:
    y = F.nullif(digits, F.lit("")).cast("int")
    return F.when(y < 100, y + 2000).otherwise(y)


def venue_and_year(c: Column, from_comments: bool) -> Column:
    """struct(confidence, venue, year) of the first dated pattern; of comments those that say "accepted" weigh 0.9, others 0.7, of journal references all 0.8."""
    forms = [(name, p, (0.9 if p.startswith("accepted") else 0.7) if from_comments else 0.8) for name, long_name in lexicon.VENUES_WITH_YEAR for p in _dated_patterns(name, long_name)]
    pick = lambda n, of: F.get(F.array(*[F.lit(x) for x in of]), n)
    # Every form holds a venue's name: a text without any is done after one search. A branch gives its number alone, and the year is looked for once.
    names = sorted({n for row in lexicon.VENUES_WITH_YEAR for n in row if n} | {"NIPS"})
    number = F.when(c.rlike("(?i)" + "|".join(names)), first_match([(F.lit(i), c.rlike("(?i)" + p)) for i, (_, p, _) in enumerate(forms)], F.lit(None).cast("int")))

    def value(n: Column) -> Column:
        year = full_year(F.call_function("regexp_extract", c, pick(n, ["(?i)" + p for _, p, _ in forms]), F.lit(1)))
        return F.when(n.isNotNull(), F.struct(pick(n, [w for *_, w in forms]).alias("confidence"), pick(n, [v for v, *_ in forms]).alias("venue"), year.alias("year")))

    return let(number, value)


def redetect_venue(comments: Column, journal_ref: Column) -> Column:
    """The surer of comments and journal reference, comments if they are equal."""
    both = F.struct(venue_and_year(comments, True).alias("a"), venue_and_year(journal_ref, False).alias("b"))
    return let(both, lambda x: F.when(x["b"].isNull() | (x["a"]["confidence"] >= x["b"]["confidence"]), x["a"]).otherwise(x["b"]))


def venue_kind(venue: Column, source: Column, journal_ref: Column, categories: Column) -> Column:
    return (
        F.when(venue.isNotNull(), "conference")
        .when((source == "arxiv") & ~blank(journal_ref), "journal")
        .when(source == "arxiv", "preprint")
        .when(F.lower(categories).contains("article"), "journal")
        .otherwise("unknown")
    )


def quality_flag(venue: Column, source: Column, comments: Column) -> Column:
    return F.when(source == "openreview", "accepted").when(venue.isNotNull() & F.lower(comments).contains("accepted"), "accepted").otherwise("unknown")


def classify_domain(categories: Column, title: Column, abstract: Column, fix_category_case: bool = True) -> Column:
    """The first domain with a phrase in the categories, else the one with most phrases in title and abstract, the first of equals.

    fix_category_case compares category codes in lower case; without it they never match.
    """
    phrases = [(d, [p.lower() if fix_category_case else p for p in ps]) for d, ps in lexicon.DOMAIN_PHRASES]
    by_category = let(F.lower(categories), lambda low: first_match([(d, any_of(F.coalesce(low.contains(p), F.lit(False)) for p in ps)) for d, ps in phrases]))

    def scored(text: Column) -> Column:
        scores = [F.struct(reduce(lambda a, b: a + b, (text.contains(p).cast("int") for p in ps)).alias("n"), F.lit(-i).alias("first"), F.lit(d).alias("domain")) for i, (d, ps) in enumerate(phrases)]
        return let(F.array_max(F.array(*scores)), lambda best: F.when(best["n"] > 0, best["domain"]))

    # The text is lower-cased once, and only where the categories say nothing.
    return F.coalesce(by_category, let(F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit("")))), scored))


def parse_venue_id(c: Column) -> Column:
    """struct(name, year, is_workshop) of an id such as ORG.cc/2024/Conference; NULL without a year."""
    org = F.upper(F.substring_index(F.substring_index(c, "/", 1), ".", 1))
    acl = first_match([(v, c.contains(v)) for v in ("ACL", "EMNLP", "NAACL", "COLING", "ARR")], org)
    name = F.when(c.contains("aclweb.org"), acl).when(c.contains("robot-learning.org"), "CoRL").when(c.contains("logconference.org"), "LOG").otherwise(org)
    year = F.nullif(F.regexp_extract(c, r"/(\d{4})/", 1), F.lit("")).cast("int")
    return F.when(year.isNotNull(), F.struct(name.alias("name"), year.alias("year"), c.contains("Workshop").alias("is_workshop")))


def venue_domain(venue_id: Column, name: Column) -> Column:
    text = F.concat(F.lower(venue_id), F.lit(" "), F.lower(name))
    return first_match([(d, any_of(text.contains(p.lower()) for p in ps)) for d, ps in lexicon.VENUE_DOMAINS], F.lit("General"))


def venue_tier(name: Column) -> Column:
    return first_match([(t, name.isin(names)) for t, names in lexicon.VENUE_TIERS.items()], F.lit("C"))


def venue_full_name(name: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in lexicon.VENUE_FULL_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, name), name)


def extraction_text(title: Column, abstract: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit("")))


def year_range(least: Column, most: Column) -> Column:
    return F.coalesce(F.concat(least.cast("string"), F.lit("-"), most.cast("string")), F.lit("N/A"))


def paper_url(base: Column, paper_id: Column) -> Column:
    return F.concat(base, paper_id.cast("string"))
