"""Sources, sinks and streams as they run: what is due, what has landed, and tables that grow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas, sinks
from ..functions import text
from ..session import checkpoint_folder
from ..sources import facts, filers, index, market, raw, urls
from ..streaming import incremental
from . import files
from . import standins as s

QUERIES, ORACLE_SQL, register = s.registrar()


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{checkpoint_folder(spark)}/landing-{uuid.uuid4().hex}"


@register("""WITH g AS (SELECT CAST(y AS INTEGER) AS year, CAST(q AS INTEGER) AS quarter, make_date(y, 3 * q - 2, 1) AS first FROM unnest(range(1994,
      2002)) AS a(y), unnest(range(1, 5)) AS b(q)),
  landed AS (SELECT DISTINCT year(o_orderdate) AS year, quarter(o_orderdate) AS quarter FROM orders WHERE o_orderkey % 3 <> 0)
  SELECT year, quarter FROM g LEFT JOIN landed l USING (year, quarter) WHERE first <= DATE '2001-05-15'
    AND (l.year IS NULL OR date_diff('day', CAST(first + INTERVAL 3 MONTH AS DATE) - 1, DATE '2001-05-15') < 120)""")
def quarters_due(spark: SparkSession, sf: str) -> DataFrame:
    landed = s.read(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"))
    return index.quarters_due((1994, 2001), F.lit("2001-05-15").cast("date"), landed, spark)


def _filer_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = s.read(spark, sf, "customer").selectExpr(
        "to_json(named_struct('cik', CAST(c_custkey AS STRING), 'name', c_name, "
        "'formerNames', CASE WHEN c_custkey % 3 = 0 THEN array(named_struct('name', concat('Old ', c_name), 'from', '1999-02-03T00:00:00.000Z', 'to', CASE WHEN c_custkey % 2 = 0 THEN '2000-04-05T00:00:00.000Z' END)) END, "
        "'filings', named_struct('files', array(named_struct('name', concat('p', c_custkey), 'filingTo', CASE c_custkey % 3 WHEN 0 THEN '1995-01-01' WHEN 1 THEN '1999-01-01' END))))) AS value"
    )
    return filers.from_text(docs)


@register("SELECT c_custkey AS cik, 'Old ' || c_name AS name, DATE '1999-02-03' AS valid_from, CASE WHEN c_custkey % 2 = 0 THEN DATE '2000-04-05' END AS valid_to FROM customer WHERE c_custkey % 3 = 0", "valid_from", "valid_to")
def former_names(spark: SparkSession, sf: str) -> DataFrame:
    return filers.former_names(_filer_docs(spark, sf))


@register("SELECT c_custkey AS cik, 'p' || c_custkey AS page FROM customer WHERE c_custkey % 3 <> 0")
def filer_pages(spark: SparkSession, sf: str) -> DataFrame:
    return filers.pages(_filer_docs(spark, sf), "1998-01-01")


@register("""SELECT c_custkey AS cik, 'https://data.sec.gov/api/xbrl/companyfacts/CIK' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') || '.json' AS url
      FROM customer WHERE c_custkey % 7 <> 0
  AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0)""")
def facts_missing(spark: SparkSession, sf: str) -> DataFrame:
    customers = s.read(spark, sf, "customer").select(F.col("c_custkey").alias("cik"))
    held = s.read(spark, sf, "orders").selectExpr("o_custkey AS cik", "CASE WHEN o_orderkey % 10 = 0 THEN 'Assets' ELSE 'Revenues' END AS concept")
    failed = customers.where("cik % 7 = 0").select(urls.facts(F.col("cik")).alias("url"))
    return facts.missing(customers, held, failed, urls.facts(F.col("cik")))


@register("SELECT o_orderkey AS accession FROM orders WHERE o_orderkey % 8 = 3")
def documents_to_fetch(spark: SparkSession, sf: str) -> DataFrame:
    wanted = s.read(spark, sf, "orders").select(F.col("o_orderkey").alias("accession"))
    return raw.not_landed(wanted, s.stored(spark, sf), ["accession"])


@register("""SELECT 'S' || s_suppkey AS ticker, CASE s_suppkey % 2 WHEN 0 THEN 'NYSE' ELSE 'NASDAQ' END AS exchange, 'Stock' AS asset_type,
      'USD' AS currency, DATE '1990-01-01' AS start_date, DATE '1996-01-01' + CAST(s_suppkey % 900 AS INTEGER) AS end_date
  FROM supplier WHERE s_suppkey % 5 <> 0""", "start_date", "end_date")
def symbol_list(spark: SparkSession, sf: str) -> DataFrame:
    """The list is one small file, as its publisher has it."""
    rows = s.read(spark, sf, "supplier").selectExpr(
        "concat_ws(',', concat('s', s_suppkey), CASE s_suppkey % 2 WHEN 0 THEN 'NYSE' ELSE 'NASDAQ' END, 'Stock', 'USD', '1990-01-01', "
        "CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE CAST(date_add(DATE '1996-01-01', CAST(s_suppkey % 900 AS INT)) AS STRING) END) AS line"
    )
    listed = rows.agg(F.array_join(F.sort_array(F.collect_list("line")), "\n")).first()[0]
    return market.symbol_list(spark, "ticker,exchange,assetType,priceCurrency,startDate,endDate\n" + listed)


_MONTHS = [(y, m) for y in range(1995, 2002) for m in range(1, 13)]


@register("""WITH m AS (SELECT y, q, (y - 1995) * 12 + q AS k FROM unnest(range(1995, 2002)) AS a(y), unnest(range(1, 13)) AS b(q))
  SELECT last_day(make_date(y, q, 1)) AS month, round(k % 13 / 100.0, 6) AS mkt, round(k % 7 / 100.0, 6) AS smb, round(k % 5 / 100.0, 6) AS hml,
    round(k % 3 / 100.0, 6) AS rmw, round(k % 2 / 100.0, 6) AS cma, 0.003 AS rf, round(-(k % 11) / 100.0, 6) AS mom FROM m""", "month")
def factor_files(spark: SparkSession, sf: str) -> DataFrame:
    """Both files with their captions, and the yearly block that is left out."""
    number = lambda y, m: (y - 1995) * 12 + m
    five = "\n".join(f"{y}{m:02d}, {', '.join(str(number(y, m) % d) for d in (13, 7, 5, 3, 2))}, 0.3" for y, m in _MONTHS)
    momentum = "\n".join(f"{y}{m:02d}, {-(number(y, m) % 11)}" for y, m in _MONTHS)
    yearly = "\n\n Annual\n1995, 9,9,9,9,9,9\n"
    out = market.factors(spark, f"words\n,Mkt-RF,SMB,HML,RMW,CMA,RF\n{five}{yearly}", f"words\n,Mom\n{momentum}{yearly}")
    return out.select("month", *(F.round(c, 6).alias(c) for c in out.columns if c != "month"))


@register("SELECT CAST(l_orderkey AS VARCHAR) AS accession, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def key_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = s.read(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("accession"))
    return schemas.key_violations(rows, "documents")


@register("""WITH p AS (SELECT doc_id, [substr(text, 1, CAST(floor(length(text) * pow(0.85, k)) AS INTEGER)) for k in range(0, 25)] AS p FROM documents)
  SELECT doc_id, length(coalesce(list_filter(p, lambda x: len(regexp_split_to_array(x, '\\s+')) <= 400)[1], '')) AS size FROM p""")
def fitted_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The longest of the shrinking prefixes that a budget allows: the operator's feature."""
    docs = s.read(spark, sf, "documents").select("doc_id", F.explode(F.array(text.fit_budget(F.col("text"), 400))).alias("t"))
    return docs.select("doc_id", F.length("t").cast("long").alias("size"))


@register(files.ORACLE_SQL["latest_per_key"])
def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Events that arrive as files, upserted batch by batch into a table."""
    folder = _folder(spark)
    events = s.read(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    incremental.upsert_stream(stream, f"{folder}/table", ["user_id"], f"{folder}/state", ["ts", "event_id"]).awaitTermination()
    return sinks.read_table(spark, f"{folder}/table").select("user_id", "event_id", "event_type", "value")


@register("""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS accession, doc_id % 5 = 0 AS bad FROM documents)
  SELECT accession, section, CASE WHEN accession::BIGINT % 2 = 0 THEN 'unterminated' ELSE 'not_found' END AS outcome FROM d,
    (SELECT unnest(['risk_factors']) AS section) WHERE NOT bad
  UNION ALL SELECT accession, 'mdna', 'not_found' FROM d WHERE NOT bad UNION ALL SELECT accession, NULL, 'empty' FROM d WHERE bad""")
def stream_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that land in two parts, parsed as they come; those without bytes are in the ledger of failures."""
    folder = _folder(spark)
    heading = F.when(F.col("doc_id") % 2 == 0, "<p>Item 1A. Risk Factors</p>").otherwise("")
    docs = s.read(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("accession"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("<html>"), heading, F.lit("<p>text</p></html>")).cast("binary")).alias("raw"))
    for part in ("doc_id % 3 = 0", "doc_id % 3 <> 0"):
        docs.where(part).drop("doc_id").write.mode("append").parquet(f"{folder}/landing")
        incremental.parse_landing(spark, f"{folder}/landing", f"{folder}/out", f"{folder}/state", f"{folder}/failures").awaitTermination()
    parsed = sinks.read_table(spark, f"{folder}/out").select("accession", "section", F.col("status").alias("outcome"))
    failed = sinks.read_table(spark, f"{folder}/failures").select("accession", F.lit(None).cast("string").alias("section"), F.col("error").alias("outcome"))
    return parsed.unionByName(failed)


@register("SELECT * FROM (VALUES ('ok', 1500), ('failed', 0)) t(status, requests)")
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    log = f"{_folder(spark)}/log"
    with sinks.logged_run(spark, log) as counters:
        counters["requests"] = 1500
    try:
        with sinks.logged_run(spark, log):
            raise KeyError("a run that fails")
    except KeyError:
        pass
    return sinks.read_table(spark, log).select("status", "requests")


@register(f"SELECT cik, reports FROM ({files.ORACLE_SQL['export_nested']}) JOIN (SELECT cik AS c, reports AS n FROM ({files.ORACLE_SQL['firm_index']})) ON cik = c".replace("SELECT cik, reports FROM", "SELECT cik, n AS originals FROM", 1))
def firm_files(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each firm, written and read again."""
    folder = f"{_folder(spark)}/firms"
    records = files._records(spark, sf)
    sinks.write_by_key(records, folder, "cik")
    back = sinks.read_by_key(spark, folder, records.schema)
    return back.select("cik", F.size(F.filter("reports", lambda r: r["version_no"] == 1)).cast("long").alias("originals"))
