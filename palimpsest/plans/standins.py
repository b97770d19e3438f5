"""The test tables in the roles of the domain's tables, for both engines.

Orders play filings and their headers, lineitem prices and facts, conversations yearly
sections, pages raw documents. Each function has its DuckDB twin in CTES.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import report_versions


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = "o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 + (o_orderkey % 3 - 1) * 4 AS INT), CAST(o_orderkey % 60 AS INT))"
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS accession", "o_custkey AS cik",
        "CASE o_orderstatus WHEN 'O' THEN '10-K' WHEN 'F' THEN '10-K/A' ELSE '8-K' END AS form",
        "date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 3 AS INT)) AS filing_date",
        "CASE WHEN o_orderkey % 11 <> 0 THEN make_date(year(o_orderdate) - 1, 12, 31) END AS report_date",
        f"CASE WHEN o_orderkey % 7 <> 0 THEN date_format({shifted}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") END AS accepted_api_raw",
        "CASE o_orderkey % 5 WHEN 0 THEN '1.03' WHEN 1 THEN '2.01,9.01' WHEN 2 THEN '4.01' WHEN 3 THEN '4.02,9.01' END AS items",
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where("o_orderkey % 10 <> 9").selectExpr(
        "o_orderkey AS accession",
        "o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT), CAST(o_orderkey % 60 AS INT)) AS accepted_at",
        "CASE WHEN o_orderkey % 13 = 0 THEN make_date(year(o_orderdate) - 1, 6, 30) ELSE make_date(year(o_orderdate) - 1, 12, 31) END AS header_period",
    )


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where("o_orderkey % 8 <> 3").selectExpr(
        "o_orderkey AS accession", "concat('raw/', o_orderkey) AS stored_path",
        "CAST(o_totalprice * 1000 AS BIGINT) AS bytes_raw", "CAST(o_totalprice * 1000 AS BIGINT) DIV (3 + o_orderkey % 9) AS bytes_stored",
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_versions(filings(spark, sf_dir), headers(spark, sf_dir), stored(spark, sf_dir))


def filers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS cik", "c_name AS name", "c_mktsegment AS industry",
        "CASE WHEN c_custkey % 6 = 5 THEN 'other' ELSE 'operating' END AS entity_type",
        "CAST(CASE WHEN c_custkey % 10 = 3 THEN 6189 ELSE 1000 + c_nationkey END AS INT) AS sic",
        "CASE WHEN c_custkey % 4 <> 0 THEN concat('S', c_custkey % 97) END AS current_tickers",
    )


def yearly_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as filers, each two turns a year's report; every fifth conversation's are amended."""
    turns = read(spark, sf_dir, "conversations").selectExpr("conv_id AS cik", "turn DIV 2 AS y").distinct()
    made = turns.selectExpr(
        "cik * 100 + y AS accession", "cik", "date_add(DATE '2000-12-31', CAST(365 * y AS INT)) AS fiscal_period_end",
        "CAST(date_add(DATE '2001-02-20', CAST(365 * y + cik % 7 AS INT)) AS TIMESTAMP_NTZ) AS accepted_at", "CAST(1 AS BIGINT) AS version_no", "false AS is_amendment",
    )
    late = made.where("cik % 5 = 0").selectExpr("accession + 50 AS accession", "cik", "fiscal_period_end", "accepted_at + make_dt_interval(20) AS accepted_at", "CAST(2 AS BIGINT) AS version_no", "true AS is_amendment")
    return made.unionByName(late)


def yearly_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn DIV 2 AS y", "CASE role WHEN 'user' THEN 'risk_factors' ELSE 'mdna' END AS section", "struct(turn, text) AS t"
    )
    texts = texts.groupBy("conv_id", "y", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]), "\n").alias("text"))
    status = "CASE WHEN length(text) < 60 THEN 'too_short' ELSE 'found' END AS status"
    made = texts.selectExpr("conv_id * 100 + y AS accession", "section", status, "text")
    late = texts.where("conv_id % 5 = 0").selectExpr("conv_id * 100 + y + 50 AS accession", "section", status, "concat(text, ' as amended later') AS text")
    return made.unionByName(late)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("day")).agg(
        (F.floor(F.min(F.col("l_extendedprice") / F.col("l_quantity")) * 100) / 100.0).alias("close")
    ).select("symbol", "day", F.when(F.dayofmonth("day") % 9 != 4, F.col("close")).otherwise(0.0).alias("adj_close"), "close")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS accession", "CASE l_returnflag WHEN 'A' THEN 'Revenues' WHEN 'N' THEN 'SalesRevenueNet' ELSE 'EntityPublicFloat' END AS concept",
        "l_extendedprice AS value", "CASE WHEN l_linenumber % 5 = 4 THEN 'EUR' ELSE 'USD' END AS unit",
        "date_add(CAST(l_shipdate AS DATE), CAST(-340 - l_linenumber * 8 AS INT)) AS period_start", "CAST(l_shipdate AS DATE) AS period_end",
    )


# The same in DuckDB's SQL.
CTES = {
    "filings": """filings AS (
        SELECT o_orderkey AS accession, o_custkey AS cik,
               CASE o_orderstatus WHEN 'O' THEN '10-K' WHEN 'F' THEN '10-K/A' ELSE '8-K' END AS form,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INTEGER) AS filing_date,
               CASE WHEN o_orderkey % 11 <> 0 THEN make_date(year(o_orderdate) - 1, 12, 31) END AS report_date,
               CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate + to_hours(o_orderkey % 24 + (o_orderkey % 3 - 1) * 4) + to_minutes(o_orderkey % 60),
                 '%Y-%m-%dT%H:%M:%S.%gZ') END AS accepted_api_raw,
               CASE o_orderkey % 5 WHEN 0 THEN '1.03' WHEN 1 THEN '2.01,9.01' WHEN 2 THEN '4.01' WHEN 3 THEN '4.02,9.01' END AS items
        FROM orders)""",
    "headers": """filing_headers AS (
        SELECT o_orderkey AS accession, o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) AS accepted_at,
               CASE WHEN o_orderkey % 13 = 0 THEN make_date(year(o_orderdate) - 1, 6, 30) ELSE make_date(year(o_orderdate) - 1, 12, 31) END AS header_period
        FROM orders WHERE o_orderkey % 10 <> 9)""",
    "stored": """stored AS (
        SELECT o_orderkey AS accession, 'raw/' || o_orderkey AS stored_path,
               CAST(trunc(o_totalprice * 1000) AS BIGINT) AS bytes_raw, CAST(trunc(o_totalprice * 1000) AS BIGINT) // (3 + o_orderkey % 9) AS bytes_stored
        FROM orders WHERE o_orderkey % 8 <> 3)""",
    "reports": """annual AS (
        SELECT f.accession, f.cik, f.form, f.form LIKE '%/A' AS is_amendment, coalesce(h.header_period, f.report_date) AS fiscal_period_end,
               f.filing_date, h.accepted_at, timezone('America/New_York', h.accepted_at AT TIME ZONE 'UTC') AS accepted_at_et, d.stored_path, d.bytes_raw
        FROM filings f LEFT JOIN filing_headers h USING (accession) LEFT JOIN stored d USING (accession)
        WHERE f.form IN ('10-K', '10-K405', '10-KT', '10-KSB', '10-K/A', '10-K405/A', '10-KT/A', '10-KSB/A')),
    annual_reports AS (
        SELECT *, row_number() OVER w AS version_no, first_value(accession) OVER w AS original_accession,
               CAST(accepted_at_et AS DATE) < filing_date AS dated_next_business_day
        FROM annual WINDOW w AS (PARTITION BY cik, fiscal_period_end ORDER BY accepted_at NULLS LAST, accession))""",
    "clock": """clock AS (
        SELECT f.accession, f.cik, f.form, h.accepted_at, f.accepted_api_raw,
               round(date_diff('second', h.accepted_at, strptime(f.accepted_api_raw, '%Y-%m-%dT%H:%M:%S.%gZ')) / 3600.0, 2) AS api_minus_header_hours
        FROM filings f JOIN filing_headers h USING (accession) WHERE f.accepted_api_raw IS NOT NULL AND h.accepted_at IS NOT NULL)""",
    "filers": """filers AS (
        SELECT c_custkey AS cik, c_name AS name, c_mktsegment AS industry, CASE WHEN c_custkey % 6 = 5 THEN 'other' ELSE 'operating' END AS entity_type,
               CAST(CASE WHEN c_custkey % 10 = 3 THEN 6189 ELSE 1000 + c_nationkey END AS INTEGER) AS sic,
               CASE WHEN c_custkey % 4 <> 0 THEN 'S' || (c_custkey % 97) END AS current_tickers
        FROM customer)""",
    "yearly": """turns AS (SELECT DISTINCT conv_id AS cik, turn // 2 AS y FROM conversations),
    made AS (
        SELECT cik * 100 + y AS accession, cik, DATE '2000-12-31' + CAST(365 * y AS INTEGER) AS fiscal_period_end,
               CAST(DATE '2001-02-20' + CAST(365 * y + cik % 7 AS INTEGER) AS TIMESTAMP) AS accepted_at, CAST(1 AS BIGINT) AS version_no,
                 false AS is_amendment
        FROM turns),
    yearly_reports AS (
        SELECT * FROM made UNION ALL
        SELECT accession + 50, cik, fiscal_period_end, accepted_at + INTERVAL 20 DAY, 2, true FROM made WHERE cik % 5 = 0),
    texts AS (
        SELECT conv_id, turn // 2 AS y, CASE role WHEN 'user' THEN 'risk_factors' ELSE 'mdna' END AS section, string_agg(text, chr(10) ORDER BY turn,
          text) AS text
        FROM conversations GROUP BY ALL),
    yearly_sections AS (
        SELECT conv_id * 100 + y AS accession, section, CASE WHEN length(text) < 60 THEN 'too_short' ELSE 'found' END AS status, text FROM texts
          UNION ALL
        SELECT conv_id * 100 + y + 50, section, CASE WHEN length(text) < 60 THEN 'too_short' ELSE 'found' END, text || ' as amended later' FROM texts
          WHERE conv_id % 5 = 0)""",
    "prices": """daily AS (
        SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS day, floor(min(l_extendedprice / l_quantity) * 100) / CAST(100.0 AS DOUBLE) AS close
          FROM lineitem GROUP BY ALL),
    daily_prices AS (SELECT symbol, day, CASE WHEN day(day) % 9 <> 4 THEN close ELSE 0.0 END AS adj_close, close FROM daily)""",
    "facts": """facts AS (
        SELECT l_orderkey AS accession, CASE l_returnflag WHEN 'A' THEN 'Revenues' WHEN 'N' THEN 'SalesRevenueNet' ELSE 'EntityPublicFloat' END AS concept,
               l_extendedprice AS value, CASE WHEN l_linenumber % 5 = 4 THEN 'EUR' ELSE 'USD' END AS unit,
               CAST(l_shipdate AS DATE) + CAST(-340 - l_linenumber * 8 AS INTEGER) AS period_start, CAST(l_shipdate AS DATE) AS period_end
        FROM lineitem)""",
}


def with_(*names: str, more: str = "") -> str:
    """A WITH clause of stand-ins, and further CTEs."""
    return "WITH " + ",\n    ".join([*(CTES[n] for n in names), *([more] if more else [])]) + "\n"


def registrar() -> tuple[dict, dict, callable]:
    """Queries, their SQL, and a decorator that registers both.

    Dates and timestamps, to be named after the SQL, become text in both engines.
    """
    queries, sqls = {}, {}

    def register(sql: str | None = None, *texts: str, name: str | None = None):
        def add(f):
            key = name or f.__name__
            queries[key] = (lambda spark, sf: f(spark, sf).withColumns({c: F.col(c).cast("string") for c in texts})) if texts else f
            if sql:
                casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in texts)
                sqls[key] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if texts else sql
            return f

        return add

    return queries, sqls, register
