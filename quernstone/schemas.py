"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

_KEYWORDS = "array<struct<keyword:string,count:bigint>>"

TABLES = {
    "raw_papers": "raw_id bigint, source string not null, source_paper_id string not null, title string, abstract string, authors array<string>, year int, venue_raw string, journal_ref string, comments string, categories string, doi string, raw_json string, published_at timestamp, retrieved_at timestamp",
    "venues": "venue_id bigint, canonical_name string not null, full_name string, domain string, tier string, venue_type string, openreview_ids array<string>, years_available array<int>, first_year int, last_year int, discovered_at timestamp, created_at timestamp",
    "papers": "paper_id bigint, canonical_title string not null, abstract string, authors array<string>, year int, venue_id bigint, venue_type string, domain string, quality_flag string, doi string, url string, pdf_url string, created_at timestamp, updated_at timestamp",
    "paper_sources": "paper_id bigint, raw_id bigint, source string, confidence double, created_at timestamp",
    "paper_keywords": "paper_id bigint, keyword string, method string, score double, created_at timestamp",
    "trend_cache": "keyword string, venue_id bigint, year int, count bigint, updated_at timestamp",
    "ingestion_logs": "source string, started_at timestamp, finished_at timestamp, fetched bigint, saved bigint, status string",
    "scrape_logs": "venue string, year int, paper_count bigint, scraped_at timestamp",
    "analysis_meta": "key string, value string, updated_at timestamp",
    "analysis_venue_summary": f"venue string, year int, paper_count bigint, top_keywords {_KEYWORDS}, emerging_keywords array<string>, updated_at timestamp",
    "analysis_keyword_trends": "scope string, venue string, keyword string, granularity string, bucket string, count bigint, updated_at timestamp",
    "analysis_timeseries": f"category string, granularity string, bucket string, paper_count bigint, top_keywords {_KEYWORDS}, updated_at timestamp",
    "analysis_emerging": "category string, keyword string, growth_rate double, first_seen string, recent_count bigint, trend string, updated_at timestamp",
}


def schema(table: str) -> StructType:
    """The table's schema; a session must be running."""
    return StructType.fromDDL(TABLES[table])


#: Columns that identify a row of each table that takes upserts.
KEYS = {
    "raw_papers": ["source", "source_paper_id"],
    "venues": ["canonical_name"],
    "paper_sources": ["paper_id", "raw_id"],
    "paper_keywords": ["paper_id", "keyword", "method"],
    "trend_cache": ["keyword", "venue_id", "year"],
    "analysis_meta": ["key"],
    "analysis_venue_summary": ["venue", "year"],
    "analysis_keyword_trends": ["scope", "venue", "keyword", "granularity", "bucket"],
    "analysis_timeseries": ["category", "granularity", "bucket"],
    "analysis_emerging": ["category", "keyword"],
}
