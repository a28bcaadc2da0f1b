"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, documents with benchmark
passages go, secrets are replaced, and the rest is packed into sequences.

Each stage takes what the one before has kept, written as Parquet and read again. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import op02_toxicity, op05_decontaminate, op06_simhash, op08_packing, op10_secrets
from quernstone.llm._common import free_name, materialise, table, tune


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the classifier, learnt from the labels of these documents, finds no toxic passages."""
    tune(spark)
    return op02_toxicity.without_toxic(docs, op02_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group at a similarity of 0.8 or more."""
    tune(spark)
    return op06_simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage within a fifth of a benchmark item's words of it."""
    tune(spark)
    return op05_decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by <KIND>; n_chars is that of the new text."""
    tune(spark)
    found = free_name("spans", docs.columns)
    clean = op10_secrets.redact(op10_secrets.scan(docs, spans_col=found), spans_col=found)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence, with its token ids' checksum."""
    tune(spark)
    return op08_packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL can express neither the learnt stage nor the hashing ones; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
