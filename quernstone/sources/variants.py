"""Upstream payloads as VARIANT values: parsed once, fields taken by path and type, and what can't be a record told apart by its cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Causes, in the order in which they are looked for.
CAUSES = ("empty", "malformed", "no object", "no id", "no title")


def parsed(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """payloads with `v`, the VARIANT of each text, NULL where it is not JSON."""
    return payloads.withColumn("v", F.try_parse_json(column))


def field(path: str, kind: str = "string", v: str = "v") -> Column:
    """The value at a path ("content.title"), itself or wrapped as {"value": value}; NULL if it is absent, JSON null, or of another type.

    An object is never taken for a string.
    """
    at = "$." + path

    def of(p: str) -> Column:
        raw = F.try_variant_get(v, p, "variant")
        value = F.try_variant_get(v, p, kind)
        return F.when(F.schema_of_variant(raw).startswith("OBJECT"), None).otherwise(value) if kind == "string" else value

    return F.coalesce(of(f"{at}.value"), of(at))


def judged(payloads: DataFrame, id_path: str, title_path: str, column: str = "payload") -> DataFrame:
    """payloads with v, source_paper_id, title and `cause`: why a payload is no record, NULL for records."""
    rows = parsed(payloads, column).withColumns({"source_paper_id": field(id_path), "title": F.trim(field(title_path))})
    cause = (
        F.when(F.coalesce(column, F.lit("")).rlike(r"^\s*$"), CAUSES[0])
        .when(F.col("v").isNull(), CAUSES[1])
        .when(~F.schema_of_variant("v").startswith("OBJECT"), CAUSES[2])
        .when(F.coalesce(F.col("source_paper_id"), F.lit("")) == "", CAUSES[3])
        .when(F.coalesce(F.col("title"), F.lit("")) == "", CAUSES[4])
    )
    return rows.withColumn("cause", cause)


def records(judged_rows: DataFrame) -> DataFrame:
    return judged_rows.where("cause is null")


def rejects(judged_rows: DataFrame) -> DataFrame:
    """(payload, cause) of what can't be a record."""
    return judged_rows.where("cause is not null")


def shape(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(schema): one type that all payloads that parse are of; where they disagree, VARIANT."""
    return parsed(payloads, column).agg(F.schema_of_variant_agg("v").alias("schema"))
