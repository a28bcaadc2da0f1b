"""Raw records from upstream payloads, which land as JSON text; one projection for each source.

A payload that does not parse, or has no id, is a reject, not a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import blank
from quernstone.operators.extract import abstract_of

_ARXIV = "struct<id:string,title:string,summary:string,published:string,authors:array<string>,categories:array<string>,comment:string,journal_ref:string,doi:string,links:array<struct<href:string,type:string>>>"
_OPENALEX = "struct<id:string,display_name:string,title:string,doi:string,publication_year:int,type:string,concepts:array<struct<display_name:string>>,authorships:array<struct<author:struct<display_name:string>>>,abstract_inverted_index:map<string,array<int>>,publication_date:string>"
_S2 = "struct<paperId:string,title:string,abstract:string,authors:array<struct<name:string>>,externalIds:map<string,string>>"


def _one_line(c: Column) -> Column:
    return F.trim(F.translate(c, "\n", " "))


def _named(names: Column) -> Column:
    return F.filter(names, lambda n: ~blank(n))


def arxiv(payloads: DataFrame, column: str = "payload") -> DataFrame:
    p = F.from_json(column, _ARXIV)
    rows = payloads.select(F.col(column).alias("raw_json"), p.alias("p"))
    paper_id = F.substring_index(F.substring_index(F.col("p.id"), "/abs/", -1), "v", 1)
    return rows.select(
        F.lit("arxiv").alias("source"), paper_id.alias("source_paper_id"), _one_line(F.col("p.title")).alias("title"), _one_line(F.col("p.summary")).alias("abstract"),
        _named(F.col("p.authors")).alias("authors"), F.try_element_at(F.split("p.published", "-"), F.lit(1)).try_cast("int").alias("year"), F.lit(None).cast("string").alias("venue_raw"),
        F.col("p.journal_ref").alias("journal_ref"), F.col("p.comment").alias("comments"), F.array_join("p.categories", ",").alias("categories"), F.col("p.doi").alias("doi"), "raw_json",
        F.try_to_timestamp(F.regexp_replace("p.published", "Z$", "+00:00")).alias("published_at"),
        F.try_element_at(F.transform(F.filter("p.links", lambda x: x["type"] == "application/pdf"), lambda x: x["href"]), F.lit(1)).alias("pdf_url"),
    )


def openalex(payloads: DataFrame, column: str = "payload") -> DataFrame:
    rows = payloads.select(F.col(column).alias("raw_json"), F.from_json(column, _OPENALEX).alias("p"))
    return rows.select(
        F.lit("openalex").alias("source"), F.substring_index("p.id", "/", -1).alias("source_paper_id"), F.coalesce(F.nullif("p.display_name", F.lit("")), "p.title").alias("title"), abstract_of(F.col("p.abstract_inverted_index")).alias("abstract"),
        _named(F.transform("p.authorships", lambda a: a["author"]["display_name"])).alias("authors"), F.col("p.publication_year").alias("year"), F.lit(None).cast("string").alias("venue_raw"),
        F.lit(None).cast("string").alias("journal_ref"), F.array_join(F.slice(F.transform("p.concepts", lambda c: c["display_name"]), 1, 5), ",").alias("comments"), F.col("p.type").alias("categories"), F.regexp_replace("p.doi", "^https://doi.org/", "").alias("doi"), "raw_json",
        F.try_to_timestamp("p.publication_date").alias("published_at"),
    )


def semantic_scholar(payloads: DataFrame, venue: str, year: int, column: str = "payload") -> DataFrame:
    """Venue and year are those of the request."""
    rows = payloads.select(F.col(column).alias("raw_json"), F.from_json(column, _S2).alias("p")).where("p.paperId is not null")
    return rows.select(
        F.lit("s2").alias("source"), F.col("p.paperId").alias("source_paper_id"), F.col("p.title").alias("title"), F.col("p.abstract").alias("abstract"), _named(F.transform("p.authors", lambda a: a["name"])).alias("authors"),
        F.lit(year).alias("year"), F.lit(venue).alias("venue_raw"), F.lit(None).cast("string").alias("journal_ref"), F.lit(None).cast("string").alias("comments"), F.lit(None).cast("string").alias("categories"), F.try_element_at("p.externalIds", F.lit("DOI")).alias("doi"), "raw_json",
    )


def openreview(payloads: DataFrame, venue: str, year: int, column: str = "payload") -> DataFrame:
    """Each field is a value or {"value": value}."""

    def field(name: str) -> Column:
        return F.coalesce(F.get_json_object(column, f"$.content.{name}.value"), F.get_json_object(column, f"$.content.{name}"))

    listed = lambda name: _named(F.from_json(field(name), "array<string>"))
    return payloads.select(
        F.lit("openreview").alias("source"), F.get_json_object(column, "$.id").alias("source_paper_id"), field("title").alias("title"), field("abstract").alias("abstract"), listed("authors").alias("authors"), F.lit(year).alias("year"), F.lit(venue).alias("venue_raw"),
        F.lit(None).cast("string").alias("journal_ref"), F.array_join(listed("keywords"), ",").alias("comments"), F.lit(None).cast("string").alias("categories"), F.lit(None).cast("string").alias("doi"), F.col(column).alias("raw_json"),
    )


def accepted(records: DataFrame) -> DataFrame:
    return records.where(~blank(F.col("source_paper_id")) & ~blank(F.trim("title")))


def rejects(records: DataFrame) -> DataFrame:
    return records.where(blank(F.col("source_paper_id")) | blank(F.trim("title")))
