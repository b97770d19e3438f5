"""Filer documents: attributes, former names, and filings as parallel arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ARRAYS = "accessionNumber array<string>, form array<string>, filingDate array<string>, reportDate array<string>, acceptanceDateTime array<string>, primaryDocument array<string>, size array<bigint>, items array<string>"
#: The schema of a filer's JSON document, as far as it is used.
FILER = (
    "cik string, name string, entityType string, sic string, sicDescription string, stateOfIncorporation string, fiscalYearEnd string, "
    "tickers array<string>, formerNames array<struct<name:string, `from`:string, `to`:string>>, "
    f"filings struct<recent:struct<{_ARRAYS.replace(' array', ':array')}>, files:array<struct<name:string, filingFrom:string, filingTo:string>>>"
)
PAGE = _ARRAYS


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents below ``path``, one JSON object a file."""
    return spark.read.schema(FILER).json(path, multiLine=True)


def from_text(rows: DataFrame, column: str = "value") -> DataFrame:
    """Documents out of JSON strings."""
    return rows.select(F.from_json(F.col(column), FILER).alias("d")).select("d.*")


def _text(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _day(c: Column) -> Column:
    return F.substring(c, 1, 10).try_cast("date")


def attributes(docs: DataFrame) -> DataFrame:
    """One row per filer; empty strings are null, a code that is no number too."""
    return docs.select(
        F.col("cik").try_cast("long").alias("cik"), "name", F.col("entityType").alias("entity_type"),
        F.when(F.col("sic").rlike("^[0-9]+$"), F.col("sic").try_cast("int")).alias("sic"),
        F.col("sicDescription").alias("sic_description"), _text("stateOfIncorporation").alias("state_of_incorporation"),
        _text("fiscalYearEnd").alias("fiscal_year_end"), _text(F.array_join("tickers", ",")).alias("current_tickers"),
    )


def former_names(docs: DataFrame) -> DataFrame:
    """``cik, name, valid_from, valid_to``."""
    rows = docs.select(F.col("cik").try_cast("long").alias("cik"), F.explode("formerNames").alias("n"))
    return rows.select("cik", "n.name", _day(F.col("n.from")).alias("valid_from"), _day(F.col("n.to")).alias("valid_to"))


def pages(docs: DataFrame, since: str | None = None) -> DataFrame:
    """``cik, page`` of the documents with a filer's older filings; those that end before ``since`` are left out."""
    rows = docs.select(F.col("cik").try_cast("long").alias("cik"), F.explode("filings.files").alias("f"))
    if since:
        rows = rows.where(F.col("f.filingTo").isNull() | (_day(F.col("f.filingTo")) >= F.lit(since).cast("date")))
    return rows.select("cik", F.col("f.name").alias("page"))


def filings(rows: DataFrame, block: str | None = None) -> DataFrame:
    """Parallel arrays to one row per filing; ``rows`` has ``cik`` and the arrays, in the struct ``block`` or as columns."""
    at = lambda name: F.col(f"{block}.{name}" if block else name)
    items = F.coalesce(at("items"), F.transform(at("form"), lambda f: F.lit("")))
    zipped = F.arrays_zip(*(at(n).alias(n) for n in ("accessionNumber", "form", "filingDate", "reportDate", "acceptanceDateTime", "primaryDocument", "size")), items.alias("items"))
    each = rows.select(F.col("cik").try_cast("long").alias("cik"), F.explode(zipped).alias("f"))
    return each.select(
        F.col("f.accessionNumber").alias("accession"), "cik", "f.form", _day(F.col("f.filingDate")).alias("filing_date"), _day(F.col("f.reportDate")).alias("report_date"),
        _text(F.col("f.acceptanceDateTime")).alias("accepted_api_raw"), _text(F.col("f.primaryDocument")).alias("primary_document"),
        F.col("f.size").alias("size_bytes"), _text(F.col("f.items")).alias("items"),
    )
