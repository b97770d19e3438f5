"""Sources parsed from landed text, upserts, and the export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import export, labels, tickers
from ..operators.upsert import keep_last, upsert
from ..sources import facts, filers, headers, index, urls
from . import standins as s

QUERIES, ORACLE_SQL, register = s.registrar()


@register("""SELECT o_custkey AS cik, 'Firm ' || o_custkey AS company_name, CASE o_orderstatus WHEN 'O' THEN '10-K' ELSE '8-K' END AS form,
      CAST(o_orderdate AS DATE) AS date_filed,
    'edgar/data/' || o_custkey || '/' || o_orderkey || '.txt' AS path, CAST(o_orderkey AS VARCHAR) AS accession FROM orders""", "date_filed")
def index_parse(spark: SparkSession, sf: str) -> DataFrame:
    lines = s.read(spark, sf, "orders").selectExpr(
        "concat_ws('|', o_custkey, concat('Firm ', o_custkey), CASE o_orderstatus WHEN 'O' THEN '10-K' ELSE '8-K' END, CAST(o_orderdate AS DATE), concat('edgar/data/', o_custkey, '/', o_orderkey, '.txt')) AS value"
    )
    caption = spark.range(1).selectExpr("explode(array('Description: index', 'CIK|Company Name|Form Type|Date Filed|Filename', '--------', '')) AS value")
    return index.parse_lines(lines.unionByName(caption))


@register("""SELECT CAST(o_orderkey AS VARCHAR) AS accession, o_custkey AS cik, o_orderpriority AS form, CAST(o_orderdate AS DATE) AS filing_date,
      CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS report_date,
    CASE WHEN o_orderkey % 3 = 0 THEN 'raw' END AS accepted_api_raw, 'd.htm' AS primary_document, CAST(o_orderkey % 1000 AS BIGINT) AS size_bytes,
      CASE WHEN o_orderkey % 5 = 0 THEN '2.01' END AS items FROM orders""", "filing_date", "report_date")
def filing_arrays(spark: SparkSession, sf: str) -> DataFrame:
    rows = s.read(spark, sf, "orders").selectExpr(
        "o_custkey AS cik", "CAST(o_orderkey AS STRING) AS accessionNumber", "o_orderpriority AS form", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS filingDate",
        "CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) ELSE '' END AS reportDate", "CASE WHEN o_orderkey % 3 = 0 THEN 'raw' ELSE '' END AS acceptanceDateTime",
        "'d.htm' AS primaryDocument", "o_orderkey % 1000 AS size", "CASE WHEN o_orderkey % 5 = 0 THEN '2.01' ELSE '' END AS items",
    )
    names = [c for c in rows.columns if c != "cik"]
    grouped = rows.groupBy("cik").agg(F.collect_list(F.struct(*names)).alias("r"))
    block = F.struct(*(F.col(f"r.{c}").alias(c) for c in names))
    docs = grouped.select(F.to_json(F.struct(F.col("cik").cast("string").alias("cik"), F.struct(block.alias("recent")).alias("filings"))).alias("value"))
    return filers.filings(filers.from_text(docs), "filings.recent")


@register("""SELECT c_custkey AS cik, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS INTEGER) END AS sic, CASE
      WHEN c_custkey % 2 = 0 THEN 'DE' END AS state_of_incorporation,
    CASE WHEN c_custkey % 4 <> 0 THEN 'A' || c_custkey || ',B' END AS current_tickers FROM customer""")
def filer_attributes(spark: SparkSession, sf: str) -> DataFrame:
    docs = s.read(spark, sf, "customer").selectExpr(
        "to_json(named_struct('cik', CAST(c_custkey AS STRING), 'name', c_name, 'sic', CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS STRING) ELSE 'none' END, "
        "'stateOfIncorporation', CASE WHEN c_custkey % 2 = 0 THEN 'DE' ELSE '' END, 'tickers', CASE WHEN c_custkey % 4 <> 0 THEN array(concat('A', c_custkey), 'B') ELSE CAST(array() AS ARRAY<STRING>) END)) AS value"
    )
    return filers.attributes(filers.from_text(docs)).select("cik", "name", "sic", "state_of_incorporation", "current_tickers")


@register("""SELECT o_orderkey AS accession, timezone('UTC', timezone('America/New_York',
      o_orderdate + to_hours(8 + o_orderkey % 12))) AS accepted_at, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS period
      FROM orders""", "accepted_at", "period")
def header_parse(spark: SparkSession, sf: str) -> DataFrame:
    text_ = s.read(spark, sf, "orders").selectExpr(
        "o_orderkey AS accession",
        "concat('<SEC-HEADER>\\n<ACCEPTANCE-DATETIME>', date_format(o_orderdate + make_dt_interval(0, CAST(8 + o_orderkey % 12 AS INT)), 'yyyyMMddHHmmss'), '\\n', CASE o_orderkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN concat('<PERIOD>', date_format(o_orderdate, 'yyyyMMdd')) ELSE concat('CONFORMED PERIOD OF REPORT:   ', date_format(o_orderdate, 'yyyyMMdd')) END) AS t",
    )
    return text_.select("accession", headers.accepted_at(F.col("t")).cast("timestamp_ntz").alias("accepted_at"), headers.period(F.col("t")).alias("period"))


@register("""WITH f AS (SELECT p_partkey AS cik, p_retailprice AS v FROM part), r AS (
    SELECT cik, 'dei' AS taxonomy, 'EntityPublicFloat' AS concept, 'USD' AS unit, v * 2 AS value, NULL AS s, '2001-12-31' AS e,
      'a' || cik AS accession FROM f UNION ALL
    SELECT cik, 'us-gaap', 'Revenues', 'USD', v + 1, '2001-01-01', '2001-12-31', 'a' || cik FROM f)
  SELECT sha1(concat_ws('|', cik, taxonomy, concept, unit, coalesce(s, 'None'), e, accession)) AS fact_id, cik, taxonomy, concept, unit, round(value,
    2) AS value, s AS period_start, e AS period_end, accession FROM r""")
def fact_rows(spark: SparkSession, sf: str) -> DataFrame:
    value = "{\"val\": %s, \"end\": \"2001-12-31\", %s\"accn\": \"a%s\", \"fy\": 2001, \"fp\": \"FY\", \"form\": \"10-K\", \"filed\": \"2002-02-01\"}"
    one = lambda v, start: f"format_string('{value}', CAST({v} AS STRING), '{start}', CAST(p_partkey AS STRING))"
    begun = '"start": "2001-01-01", '
    docs = s.read(spark, sf, "part").selectExpr(
        "concat('{\"cik\": ', p_partkey, ', \"facts\": {\"dei\": {\"EntityPublicFloat\": {\"units\": {\"USD\": [', " + one("p_retailprice", "") + ", ',', " + one("p_retailprice * 2", "")
        + ", ']}}}, \"us-gaap\": {\"Other\": {\"units\": {\"USD\": [', " + one("p_retailprice", "") + ", ']}}, \"Revenues\": {\"units\": {\"USD\": [', " + one("p_retailprice + 1", begun) + ", ']}}}}}') AS value"
    )
    out = facts.rows(facts.from_text(docs))
    return out.select("fact_id", "cik", "taxonomy", "concept", "unit", F.round("value", 2).alias("value"), F.col("period_start").cast("string").alias("period_start"), F.col("period_end").cast("string").alias("period_end"), "accession")


@register("""SELECT o_orderkey, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || replace(a, '-', '') || '/' || CASE
      WHEN o_orderkey % 3 = 0 THEN a || '.txt' ELSE 'doc.htm' END AS document,
    'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || replace(a, '-', '') || '/' || a || '.hdr.sgml' AS header,
      'https://data.sec.gov/api/xbrl/companyfacts/CIK' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '.json' AS facts,
    'https://data.sec.gov/submissions/CIK' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '.json' AS submissions FROM (SELECT *,
      '000-01-' || o_orderkey AS a FROM orders)""")
def archive_urls(spark: SparkSession, sf: str) -> DataFrame:
    o = s.read(spark, sf, "orders").withColumn("a", F.concat(F.lit("000-01-"), F.col("o_orderkey").cast("string")))
    cik, a = F.col("o_custkey"), F.col("a")
    primary = F.when(F.col("o_orderkey") % 3 != 0, "doc.htm").otherwise("")
    return o.select("o_orderkey", urls.document(cik, a, primary).alias("document"), urls.header(cik, a).alias("header"), urls.facts(cik).alias("facts"), urls.submissions(cik).alias("submissions"))


@register("""SELECT o_orderkey AS accession, CASE o_orderkey % 4 WHEN 0 THEN 'ABC' WHEN 1 THEN 'XY.A' WHEN 2 THEN 'QQ' END AS ticker,
      CASE o_orderkey % 4 WHEN 0 THEN 'xbrl_tag' WHEN 1 THEN 'item5_text' WHEN 2 THEN 'item5_text' END AS source,
    CASE o_orderkey % 4 WHEN 1 THEN 'XY.A' WHEN 2 THEN 'ZZ,QQ' ELSE '' END AS candidates FROM orders""")
def ticker_map(spark: SparkSession, sf: str) -> DataFrame:
    raw = s.read(spark, sf, "orders").selectExpr(
        "o_orderkey AS accession",
        """encode(CASE o_orderkey % 4 WHEN 0 THEN '<ix:nonNumeric name="dei:TradingSymbol" id="a"><b> abc</b></ix:nonNumeric>' WHEN 1 THEN '<p>Our stock trades on the NYSE under the symbol &ldquo;XY.A&rdquo;.</p>'
        WHEN 2 THEN '<p>Ticker symbol: ZZ</p><p>trading symbol QQ</p><div>under the ticker symbol QQ</div><p>symbol NYSE</p>' ELSE '<p>no such thing</p>' END, 'UTF-8') AS raw""",
    )
    return tickers.ticker_map(raw).withColumn("candidates", F.array_join("candidates", ","))


@register("SELECT doc_id, md5(text) AS digest FROM documents")
def byte_decoding(spark: SparkSession, sf: str) -> DataFrame:
    docs = s.read(spark, sf, "documents")
    old = ~F.col("text").rlike("[^\\x{00}-\\x{7F}\\x{A0}-\\x{FF}]") & (F.col("doc_id") % 2 == 0)
    raw = F.when(old, F.encode(F.when(old, F.col("text")).otherwise(""), "ISO-8859-1")).otherwise(F.col("text").cast("binary"))
    return docs.select("doc_id", F.md5(text.decode_bytes(raw)).alias("digest"))


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN abs(x) < 10 THEN round_even(x, 4) ELSE round_even(x, 0) END AS cleaned
      FROM (SELECT o_orderkey, o_totalprice / (1 + o_orderkey % 7 * 20000) AS x FROM orders)""")
def number_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / (1 + F.col("o_orderkey") % 7 * 20000))
    return s.read(spark, sf, "orders").select("o_orderkey", text.clean_number(x).alias("cleaned"))


_OLD, _NEW = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0", "SELECT c_custkey, 'new ' || c_name AS c_name, c_acctbal FROM customer WHERE c_custkey % 5 = 0"


@register(f"SELECT * FROM ({_OLD}) o WHERE c_custkey NOT IN (SELECT c_custkey FROM ({_NEW})) UNION ALL SELECT * FROM ({_NEW})")
def upsert_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = s.read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 5 = 0").withColumn("c_name", F.concat(F.lit("new "), F.col("c_name")))
    return upsert(c.where("c_custkey % 3 <> 0"), new.select("c_acctbal", "c_custkey", "c_name"), ["c_custkey"])


@register("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return keep_last(s.read(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


_EXPORT_CTES = ("filings", "headers", "stored", "reports", "filers", "facts")
_EXPORT = """flt AS (SELECT accession, max(value) AS public_float FROM facts WHERE concept = 'EntityPublicFloat' AND unit = 'USD' AND value > 0
      GROUP BY 1),
  rev AS (SELECT accession, concept, value AS revenue_usd FROM facts WHERE concept IN ('Revenues', 'SalesRevenueNet') AND unit = 'USD'
    AND date_diff('day', period_start, period_end) BETWEEN 350 AND 380
    AND period_end = (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem l WHERE l.l_orderkey = facts.accession)
      QUALIFY row_number() OVER (PARTITION BY accession ORDER BY concept, value DESC) = 1),
  chg AS (SELECT o_orderkey AS accession, (o_orderkey % 97) / 97.0 AS sim_rf, CASE
    WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 89) / 89.0 END AS sim_mdna, o_orderkey % 1000 AS words_rf, CASE
    WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 900 END AS words_mdna FROM orders WHERE o_orderkey % 4 <> 0),
  clean AS (SELECT a.cik, a.accession, a.form, a.is_amendment, a.version_no, year(a.fiscal_period_end) AS fy,
    CAST(a.fiscal_period_end AS VARCHAR) AS period_end, strftime(a.accepted_at_et, '%Y-%m-%d %H:%M') AS accepted_et, a.dated_next_business_day,
    t.ticker, CASE WHEN abs(f.public_float) < 10 THEN round_even(f.public_float, 4) ELSE round_even(f.public_float, 0) END AS public_float, CASE
      WHEN abs(r.revenue_usd) < 10 THEN round_even(r.revenue_usd, 4) ELSE round_even(r.revenue_usd, 0) END AS revenue,
    round_even(CAST(c.sim_rf AS DOUBLE), 4) AS sim_rf, round_even(CAST(c.sim_mdna AS DOUBLE), 4) AS sim_mdna, c.words_rf, c.words_mdna
    FROM annual_reports a LEFT JOIN (SELECT o_orderkey AS accession, 'T' || (o_orderkey % 50) AS ticker FROM orders
      WHERE o_orderkey % 3 <> 0) t USING (accession) LEFT JOIN flt f USING (accession) LEFT JOIN rev r USING (accession) LEFT
      JOIN chg c USING (accession)
    WHERE a.stored_path IS NOT NULL),
  noted AS (SELECT cik, CAST(filing_date AS VARCHAR) AS date, items FROM filings WHERE form LIKE '8-K%' AND items IS NOT NULL AND (items LIKE '%1.03%'
    OR items LIKE '%2.01%' OR items LIKE '%4.01%' OR items LIKE '%4.02%'))"""


def _export_rows(spark: SparkSession, sf: str) -> DataFrame:
    orders = s.read(spark, sf, "orders")
    known = orders.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS accession", "concat('T', o_orderkey % 50) AS ticker")
    changed = orders.where("o_orderkey % 4 <> 0")
    rf = changed.selectExpr("o_orderkey AS accession", "'risk_factors' AS section", "(o_orderkey % 97) / 97.0D AS sim_tfidf_pit", "o_orderkey % 1000 AS words")
    mdna = changed.where("o_orderkey % 5 <> 0").selectExpr("o_orderkey AS accession", "'mdna' AS section", "(o_orderkey % 89) / 89.0D AS sim_tfidf_pit", "o_orderkey % 900 AS words")
    periods = s.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("accession")).agg(F.max("l_shipdate").cast("date").alias("fiscal_period_end"))
    f = s.facts(spark, sf)
    return export.report_rows(s.reports(spark, sf), known, labels.public_float(f), labels.stated_revenue(periods, f), rf.unionByName(mdna))


@register(s.with_(*_EXPORT_CTES, more=_EXPORT) + "SELECT * FROM clean")
def export_reports(spark: SparkSession, sf: str) -> DataFrame:
    return _export_rows(spark, sf)


@register(s.with_("filings") + """SELECT cik, CAST(filing_date AS VARCHAR) AS date, items, CASE WHEN items LIKE '%1.03%' THEN 'bankruptcy'
      WHEN items LIKE '%2.01%' THEN 'acquisition/disposition' WHEN items LIKE '%4.01%' THEN 'auditor change' ELSE 'restatement' END AS kinds
    FROM filings WHERE form LIKE '8-K%' AND items IS NOT NULL AND (items LIKE '%1.03%' OR items LIKE '%2.01%' OR items LIKE '%4.01%'
      OR items LIKE '%4.02%')""")
def export_events(spark: SparkSession, sf: str) -> DataFrame:
    return export.events(s.filings(spark, sf)).withColumn("kinds", F.array_join("kinds", ";"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return export.firms(s.filers(spark, sf), _export_rows(spark, sf), export.events(s.filings(spark, sf)))


_INDEX = _EXPORT + """,
  firm_index AS (SELECT f.cik, f.name, f.industry, r.ticker, r.first_fy, r.last_fy, r.reports, coalesce(e.events, 0) AS events, r.min_sim_rf,
    f.current_tickers IS NOT NULL AS has_current_ticker FROM filers f
    JOIN (SELECT cik, arg_max(ticker, (period_end, version_no, accession)) FILTER (version_no = 1 AND ticker IS NOT NULL) AS ticker,
      min(fy) FILTER (version_no = 1) AS first_fy, max(fy) FILTER (version_no = 1) AS last_fy,
      count(*) FILTER (version_no = 1) AS reports, min(sim_rf) FILTER (version_no = 1) AS min_sim_rf FROM clean GROUP BY 1) r USING (cik) LEFT
        JOIN (SELECT cik, count(*) AS events FROM noted GROUP BY 1) e USING (cik))"""


@register(s.with_(*_EXPORT_CTES, more=_INDEX) + "SELECT * FROM firm_index")
def firm_index(spark: SparkSession, sf: str) -> DataFrame:
    return export.firm_index(_records(spark, sf))


@register(s.with_(*_EXPORT_CTES, more=_INDEX) + "SELECT * FROM firm_index WHERE contains(lower(name), '00') OR contains(lower(industry), '00') OR lower(ticker) = '00' OR CAST(cik AS VARCHAR) = '00' ORDER BY min_sim_rf NULLS LAST, name, cik LIMIT 150")
def firm_search(spark: SparkSession, sf: str) -> DataFrame:
    """A limit is the feature: the viewer shows 150 firms."""
    return export.search(export.firm_index(_records(spark, sf)), "00")


_REPORT = ("accession", "form", "is_amendment", "version_no", "fy", "period_end", "accepted_et", "dated_next_business_day", "ticker", "public_float", "revenue", "sim_rf", "sim_mdna", "words_rf", "words_mdna")


@register(s.with_(*_EXPORT_CTES, more=_EXPORT + """,
  kinds AS (SELECT cik, date, items, list_filter([CASE WHEN items LIKE '%1.03%' THEN 'bankruptcy' END, CASE
    WHEN items LIKE '%2.01%' THEN 'acquisition/disposition' END,
    CASE WHEN items LIKE '%4.01%' THEN 'auditor change' END, CASE WHEN items LIKE '%4.02%' THEN 'restatement' END], lambda k: k IS NOT NULL) AS kinds
      FROM noted),
  of_firm AS (SELECT cik, list(concat_ws('|', """ + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" if c not in ("public_float", "revenue", "sim_rf", "sim_mdna") else f"coalesce(CAST(CAST(round({c} * 10000) AS BIGINT) AS VARCHAR), '-')" for c in _REPORT)
    + """) ORDER BY period_end NULLS LAST, version_no, accession) AS reports FROM clean GROUP BY 1),
  of_events AS (SELECT cik, list(concat_ws('|', date, items, array_to_string(kinds, ';')) ORDER BY date, items) AS events FROM kinds GROUP BY 1)""")
  + """SELECT f.cik, f.name, f.industry, f.current_tickers, array_to_string(r.reports, chr(10)) AS reports, coalesce(array_to_string(e.events, chr(10)), '') AS events
  FROM filers f JOIN of_firm r USING (cik) LEFT JOIN of_events e USING (cik)""")  # fmt: skip
def export_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Nested records, their lists written out field by field and in order."""
    scaled = lambda r, c: F.round(r[c] * 10000).cast("bigint") if c in ("public_float", "revenue", "sim_rf", "sim_mdna") else r[c]
    report = lambda r: F.concat_ws("|", *(F.coalesce(scaled(r, c).cast("string"), F.lit("-")) for c in _REPORT))
    event = lambda e: F.concat_ws("|", e["date"], e["items"], F.array_join(e["kinds"], ";"))
    lines = lambda c, f: F.array_join(F.transform(c, f), "\n").alias(c)
    return _records(spark, sf).select("cik", "name", "industry", "current_tickers", lines("reports", report), lines("events", event))


@register(s.with_(*_EXPORT_CTES) + """SELECT count(*) AS reports, count(DISTINCT cik) AS firms, count(*) FILTER (is_amendment) AS amendments,
      min(year(fiscal_period_end)) AS first_fy, max(year(fiscal_period_end)) AS last_fy,
    (SELECT count(*) FROM orders WHERE o_orderkey % 4 <> 0) AS section_pairs FROM annual_reports WHERE stored_path IS NOT NULL""")
def export_counts(spark: SparkSession, sf: str) -> DataFrame:
    return export.counts(s.reports(spark, sf), s.read(spark, sf, "orders").where("o_orderkey % 4 <> 0"))
