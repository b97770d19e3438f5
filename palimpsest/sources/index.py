"""Quarterly form indexes: pipe-delimited lines below a ruler, plain or gzipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import ANNUAL_FORMS


def parse_lines(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``cik, company_name, form, date_filed, path, accession`` of each line of five fields.

    The caption above the ruler has no numeric first field and so drops out, which keeps the
    parse free of any order of lines.
    """
    parts = F.split(F.col(line), r"\|", -1)
    number = F.btrim(parts[0]).try_cast("long")
    rows = lines.where(F.size(parts) == 5).withColumn("__cik", number).where("__cik is not null")
    path = F.btrim(parts[4])
    return rows.select(
        *keep, F.col("__cik").alias("cik"), F.btrim(parts[1]).alias("company_name"), F.btrim(parts[2]).alias("form"),
        F.btrim(parts[3]).try_cast("date").alias("date_filed"), path.alias("path"),
        F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.txt$", "").alias("accession"),
    )


def read(spark: SparkSession, path: str, forms: tuple[str, ...] = ANNUAL_FORMS) -> DataFrame:
    """Rows of all index files below ``path`` with a form of interest and their ``index_quarter``.

    Files are named ``<year>/QTR<n>/...``; gzipped ones are read as they are.
    """
    name = F.input_file_name()
    quarter = F.concat(F.regexp_extract(name, r"(\d{4})/QTR\d", 1), F.lit("Q"), F.regexp_extract(name, r"QTR(\d)", 1))
    lines = spark.read.text(path, recursiveFileLookup=True).withColumn("index_quarter", F.when(quarter != "Q", quarter))
    rows = parse_lines(lines, keep=("index_quarter",))
    return rows.where(F.col("form").isin(*forms))


def quarters_due(years: tuple[int, int], today: Column, landed: DataFrame | None, spark: SparkSession, open_days: int = 120) -> DataFrame:
    """``year, quarter`` to fetch: those that have begun, were not landed, or ended less than
    ``open_days`` ago and so may still grow."""
    grid = spark.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("year"), F.explode(F.array(*map(F.lit, range(1, 5)))).alias("quarter"))
    first = F.make_date("year", F.col("quarter") * 3 - 2, F.lit(1))
    end = F.last_day(F.add_months(first, 2))
    begun = grid.where(first <= today).withColumn("open", F.datediff(today, end) < open_days)
    if landed is None:
        return begun.select("year", "quarter")
    seen = begun.join(landed.select("year", "quarter").distinct().withColumn("__seen", F.lit(True)), ["year", "quarter"], "left")
    return seen.where(F.col("open") | F.col("__seen").isNull()).select("year", "quarter")
