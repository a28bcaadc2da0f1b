"""The queries of this kind that SQL can express, against DuckDB; names and columns of the others."""

from __future__ import annotations

import duckdb
import pytest

from quernstone.llm import queries

COLUMNS = {
    "op2_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op3_quality": {"doc_id", "held_out", "score", "predicted"},
    "op6_simhash": {"doc_id", "fingerprint", "component_id"},
    "op7_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op8_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op9_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op10_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op11_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op12_fill_in_middle": {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"},
    "op13_hard_negatives": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir), c.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(r[k] for k in sorted(got.columns)) for r in got.collect()), key=str) == sorted((tuple(r[want.columns.index(k)] for k in sorted(got.columns)) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf_dir, name):
    assert COLUMNS[name] <= set(queries.QUERIES[name](spark, sf_dir).columns)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
