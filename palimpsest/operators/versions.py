"""Report versions: an original and its amendments, ordered by when they became public."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import api_instant, local_time, seconds_between

# The annual forms.
ANNUAL_FORMS = ("10-K", "10-K405", "10-KT", "10-KSB", "10-K/A", "10-K405/A", "10-KT/A", "10-KSB/A")


def report_versions(filings: DataFrame, headers: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per version of an annual report.

    The period is the header's, else the filing list's. Versions of a (filer, period) are
    numbered by acceptance, then id; versions without an acceptance time come last.
    """
    annual = filings.where(F.col("form").isin(*ANNUAL_FORMS))
    joined = (
        annual.join(headers.select("accession", "accepted_at", "header_period"), "accession", "left")
        .join(documents.select("accession", "stored_path", "bytes_raw"), "accession", "left")
        .select(
            "accession", "cik", "form",
            F.col("form").endswith("/A").alias("is_amendment"),
            F.coalesce("header_period", "report_date").alias("fiscal_period_end"),
            "filing_date", "accepted_at",
            local_time(F.col("accepted_at")).alias("accepted_at_et"),
            "stored_path", "bytes_raw",
        )
    )
    order = Window.partitionBy("cik", "fiscal_period_end").orderBy(F.col("accepted_at").asc_nulls_last(), "accession")
    return joined.select(
        "*",
        F.row_number().over(order).cast("long").alias("version_no"),
        F.first_value("accession").over(order).alias("original_accession"),
        (F.col("accepted_at_et").cast("date") < F.col("filing_date")).alias("dated_next_business_day"),
    )


def as_of(reports: DataFrame, instant: Column) -> DataFrame:
    """What was public at ``instant``: the newest version of each (filer, period) accepted by then."""
    order = Window.partitionBy("cik", "fiscal_period_end").orderBy(F.col("accepted_at").desc(), F.col("accession").desc())
    public = reports.where(F.col("accepted_at") <= instant)
    return public.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def clock_check(filings: DataFrame, headers: DataFrame) -> DataFrame:
    """How many hours the filing list's time is off the header's, where both are known."""
    both = filings.join(headers.select("accession", "accepted_at"), "accession").where("accepted_at is not null and accepted_api_raw is not null")
    hours = F.round(seconds_between(F.col("accepted_at"), api_instant(F.col("accepted_api_raw"))) / F.lit(3600.0), 2)
    return both.select("accession", "cik", "form", "accepted_at", "accepted_api_raw", hours.alias("api_minus_header_hours"))
