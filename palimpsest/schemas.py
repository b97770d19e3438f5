"""Declared schemas of the base tables, and their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Table and column names.
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "master_index": ("accession string, cik bigint, company_name string, form string, date_filed date, index_quarter string", ("accession",)),
    "filers": ("cik bigint, name string, entity_type string, sic int, sic_description string, state_of_incorporation string, fiscal_year_end string, current_tickers string, fetched_at timestamp", ("cik",)),
    "filer_former_names": ("cik bigint, name string, valid_from date, valid_to date", ("cik", "name", "valid_from")),
    "universe": ("cik bigint, draw_rank string, seed int, status string, reason string, decided_at timestamp", ("cik",)),
    "filings": ("accession string, cik bigint, form string, filing_date date, report_date date, accepted_api_raw string, primary_document string, size_bytes bigint, items string, first_seen_at timestamp", ("accession",)),
    "filing_headers": ("accession string, accepted_at timestamp, header_period date, fetched_at timestamp", ("accession",)),
    "documents": ("accession string, url string, stored_path string, bytes_raw bigint, bytes_stored bigint, sha256 string, fetched_at timestamp", ("accession",)),
    "fetch_failures": ("url string, accession string, error string, failed_at timestamp", ("url",)),
    "ingest_runs": ("run_id string, started_at timestamp, finished_at timestamp, params string, requests bigint, retries bigint, bytes bigint, status string", ("run_id",)),
    "xbrl_facts": ("fact_id string, cik bigint, taxonomy string, concept string, unit string, value double, period_start date, period_end date, accession string, fy int, fp string, form string, filed date", ("fact_id",)),
    "report_tickers": ("accession string, cik bigint, ticker string, source string, candidates array<string>", ("accession",)),
    "symbol_catalogue": ("ticker string, exchange string, asset_type string, currency string, start_date date, end_date date", ()),
    "daily_prices": ("symbol string, day date, adj_close double, close double, volume double", ()),
    "sections": ("accession string, parser_version int, n_lines int, n_chars int, section string, status string, start_line int, end_line int, text string", ("accession", "section")),
    "section_changes": ("cik bigint, section string, accession string, fiscal_period_end date, accepted_at timestamp, prior_accession string, prior_period_end date, words bigint, prior_words bigint, sim_cosine double, sim_jaccard double, sim_tfidf double, sim_tfidf_pit double", ("accession", "section")),
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table][0])


def key(table: str) -> tuple[str, ...]:
    return TABLES[table][1]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def key_violations(df: DataFrame, table: str) -> DataFrame:
    """Key values that are null or occur more than once, with their number; none in a sound table."""
    keys = list(key(table))
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null)
