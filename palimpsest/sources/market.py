"""Prices, the list of symbols, and factor files."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FACTOR_COLUMNS = (("mkt", "smb", "hml", "rmw", "cma", "rf"), ("mom",))


def unzipped(content: bytes) -> str:
    """The first member of an archive (a small file, read on the driver)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return z.read(z.namelist()[0]).decode("latin-1")


def symbol_list(spark: SparkSession, csv: str) -> DataFrame:
    """``ticker, exchange, asset_type, currency, start_date, end_date`` of a CSV text; incomplete rows are dropped."""
    lines = spark.sparkContext.parallelize(csv.splitlines())
    rows = spark.read.csv(lines, header=True, inferSchema=False)
    named = rows.select(
        F.upper("ticker").alias("ticker"), "exchange", F.col("assetType").alias("asset_type"), F.col("priceCurrency").alias("currency"),
        F.col("startDate").try_cast("date").alias("start_date"), F.col("endDate").try_cast("date").alias("end_date"),
    )
    return named.na.drop(subset=["ticker", "start_date", "end_date"])


def prices(spark: SparkSession, path: str) -> DataFrame:
    """``symbol, day, adj_close, close, volume`` from one JSON array a symbol; files that start with ``_`` are not prices."""
    raw = spark.read.schema("date string, adjClose double, close double, volume double").json(path, multiLine=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json(?:\.gz)?$", 1)
    rows = raw.select(F.url_decode(name).alias("symbol"), F.substring("date", 1, 10).try_cast("date").alias("day"), F.col("adjClose").alias("adj_close"), "close", "volume")
    return rows.where(~F.col("symbol").startswith("_") & F.col("day").isNotNull())


def factor_table(spark: SparkSession, text: str, names: tuple[str, ...]) -> DataFrame:
    """The first block of monthly rows, from percent to fractions: ``month`` (its end) and ``names``.

    A factor file has some thousand lines, so one task orders them.
    """
    rows = [(i, line) for i, line in enumerate(text.splitlines())]
    lines = spark.createDataFrame(rows, "n long, line string")
    monthly = F.btrim(F.split("line", ",")[0]).rlike("^[0-9]{6}$")
    marked = lines.withColumn("monthly", monthly)
    before = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    ended = marked.withColumn("ended", F.coalesce(F.max(F.col("monthly").cast("int")).over(before), F.lit(0)) * (~F.col("monthly")).cast("int"))
    block = ended.withColumn("over", F.max("ended").over(Window.orderBy("n"))).where("monthly and over = 0")
    parts = F.split("line", ",")
    month = F.last_day(F.try_to_timestamp(F.btrim(parts[0]), F.lit("yyyyMM")).cast("date"))
    return block.select(month.alias("month"), *((F.btrim(F.get(parts, F.lit(k + 1))).try_cast("double") / 100).alias(c) for k, c in enumerate(names)))


def factors(spark: SparkSession, five: str, momentum: str) -> DataFrame:
    """Both factor files, for the months in both."""
    return factor_table(spark, five, FACTOR_COLUMNS[0]).join(factor_table(spark, momentum, FACTOR_COLUMNS[1]), "month")
