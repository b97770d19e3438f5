"""Versions of reports and the findings on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as findings
from ..operators import universe
from ..operators.versions import as_of, clock_check
from . import standins as s

QUERIES, ORACLE_SQL, register = s.registrar()
_REPORTS = ("filings", "headers", "stored", "reports")


_VERSION_COLUMNS = "accession, cik, form, is_amendment, fiscal_period_end, accepted_at, accepted_at_et, version_no, original_accession, dated_next_business_day"


@register(s.with_(*_REPORTS) + f"SELECT {_VERSION_COLUMNS} FROM annual_reports", "fiscal_period_end", "accepted_at", "accepted_at_et")
def report_versions(spark: SparkSession, sf: str) -> DataFrame:
    return s.reports(spark, sf).select(*_VERSION_COLUMNS.split(", "))


@register(s.with_(*_REPORTS) + f"""SELECT {_VERSION_COLUMNS} FROM annual_reports WHERE accepted_at <= TIMESTAMP '1998-06-30'
    QUALIFY row_number() OVER (PARTITION BY cik, fiscal_period_end ORDER BY accepted_at DESC, accession DESC) = 1""", "fiscal_period_end", "accepted_at", "accepted_at_et")
def as_of_read(spark: SparkSession, sf: str) -> DataFrame:
    return as_of(s.reports(spark, sf), F.expr("TIMESTAMP_NTZ '1998-06-30 00:00:00'")).select(*_VERSION_COLUMNS.split(", "))


@register(s.with_("filings", "headers", "clock") + "SELECT * FROM clock", "accepted_at")
def api_clock_check(spark: SparkSession, sf: str) -> DataFrame:
    return clock_check(s.filings(spark, sf), s.headers(spark, sf))


_DECIDED = """decided AS (
    SELECT *, sha256(concat('7:', cik)) AS draw_rank,
           CASE WHEN entity_type <> 'operating' OR entity_type IS NULL THEN 'entity_type=' || coalesce(entity_type, 'None')
                WHEN sic = 6189 THEN 'sic=6189 (asset-backed)' END AS reason
    FROM filers),
  counted AS (SELECT *, count(*) FILTER (reason IS NULL) OVER (ORDER BY draw_rank) AS included, reason IS NULL AS ok FROM decided),
  universe AS (
    SELECT cik, draw_rank, CAST(7 AS INTEGER) AS seed, CASE WHEN ok THEN 'included' ELSE 'excluded' END AS status, reason
    FROM counted WHERE included < 60 OR (included = 60 AND ok))"""


@register(s.with_("filers", more=_DECIDED) + "SELECT * FROM universe")
def universe_draw(spark: SparkSession, sf: str) -> DataFrame:
    return universe.draw(s.filers(spark, sf), seed=7, wanted=60)


@register(s.with_("filers", more=_DECIDED) + "SELECT status, coalesce(reason, '') AS reason, count(*) AS filers FROM universe GROUP BY ALL")
def universe_sample(spark: SparkSession, sf: str) -> DataFrame:
    return findings.sample(universe.draw(s.filers(spark, sf), seed=7, wanted=60))


@register(s.with_(*_REPORTS) + """SELECT year(filing_date) AS filing_year, count(*) AS reports, count(*) FILTER (is_amendment) AS amendments,
    count(stored_path) AS with_text, count(DISTINCT cik) AS firms FROM annual_reports WHERE accepted_at IS NOT NULL GROUP BY ALL""")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return findings.coverage(s.reports(spark, sf))


@register(s.with_(*_REPORTS) + """SELECT count(*) AS reports, round(100.0 * avg(dated_next_business_day::int), 1) AS pct_dated_next_business_day,
    round(100.0 * avg((hour(accepted_at_et) >= 16)::int), 1) AS pct_after_close,
    round(100.0 * avg((hour(accepted_at_et) * 60 + minute(accepted_at_et) < 570)::int), 1) AS pct_before_open
    FROM annual_reports WHERE accepted_at IS NOT NULL""")
def timing(spark: SparkSession, sf: str) -> DataFrame:
    return findings.timing(s.reports(spark, sf))


@register(s.with_("filings", "headers", "clock") + """SELECT api_minus_header_hours AS hours_off, count(*) AS filings,
    round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM clock GROUP BY ALL""")
def share_of_total(spark: SparkSession, sf: str) -> DataFrame:
    return findings.api_offsets(clock_check(s.filings(spark, sf), s.headers(spark, sf)))


@register(s.with_("filings", "headers", "clock", more="""local AS (
    SELECT timezone('America/New_York', accepted_at AT TIME ZONE 'UTC') AS h,
           timezone('America/New_York', strptime(accepted_api_raw, '%Y-%m-%dT%H:%M:%S.%gZ') AT TIME ZONE 'UTC') AS a FROM clock),
  labelled AS (
    SELECT h::date || ' ' || CASE WHEN h::time < TIME '09:30' THEN 'pre-open' WHEN h::time < TIME '16:00' THEN 'regular' ELSE 'after-close' END AS hs,
           a::date || ' ' || CASE WHEN a::time < TIME '09:30' THEN 'pre-open' WHEN a::time < TIME '16:00' THEN 'regular' ELSE 'after-close' END AS fs FROM local)""")
    + "SELECT count(*) AS filings, count(*) FILTER (hs <> fs) AS session_flips, round(100.0 * avg((hs <> fs)::int), 1) AS pct_flipped FROM labelled")
def session_flips(spark: SparkSession, sf: str) -> DataFrame:
    return findings.session_flips(clock_check(s.filings(spark, sf), s.headers(spark, sf)))


@register(s.with_(*_REPORTS, more="""periods AS (SELECT cik, fiscal_period_end, count(*) - 1 AS n, date_diff('day', min(accepted_at), max(accepted_at)) AS days
    FROM annual_reports WHERE accepted_at IS NOT NULL GROUP BY ALL)""")
    + """SELECT count(*) AS fiscal_periods, round(100.0 * avg((n > 0)::int), 1) AS pct_amended, max(n) AS max_amendments,
    CAST(median(days) FILTER (n > 0) AS DOUBLE) AS median_days_to_amendment FROM periods""")  # fmt: skip
def amendments(spark: SparkSession, sf: str) -> DataFrame:
    return findings.amendments(s.reports(spark, sf))


@register(s.with_("filings", "headers") + """SELECT count(*) AS reports, count(*) FILTER (f.report_date IS NULL) AS api_period_missing,
    count(*) FILTER (f.report_date <> h.header_period) AS disagree FROM filings f JOIN filing_headers h USING (accession)""")
def period_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    return findings.period_disagreement(s.filings(spark, sf), s.headers(spark, sf))


@register(s.with_("stored") + """SELECT count(*) AS documents, round(sum(bytes_raw) / 1e9, 2) AS raw_gb, round(sum(bytes_stored) / 1e9, 2) AS stored_gb,
    round(sum(bytes_raw) / sum(bytes_stored), 1) AS compression FROM stored""")
def storage(spark: SparkSession, sf: str) -> DataFrame:
    return findings.storage(s.stored(spark, sf))


@register(s.with_("yearly") + """SELECT section, status, count(*) AS reports, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY section), 1) AS pct
    FROM yearly_sections JOIN yearly_reports USING (accession) WHERE NOT is_amendment GROUP BY section, status""")
def outcome_share(spark: SparkSession, sf: str) -> DataFrame:
    return findings.section_outcomes(s.yearly_sections(spark, sf), s.yearly_reports(spark, sf))


@register(s.with_("filings", "headers", "stored", more="""annual AS (SELECT * FROM filings WHERE form IN ('10-K', '10-K/A')
    AND filing_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')""")
    + """SELECT a.accession, a.cik, h.accession IS NULL AS needs_header, d.accession IS NULL AS needs_document
    FROM annual a LEFT JOIN filing_headers h USING (accession) LEFT JOIN stored d USING (accession) WHERE h.accession IS NULL OR d.accession IS NULL""")  # fmt: skip
def fetch_plan(spark: SparkSession, sf: str) -> DataFrame:
    return universe.fetch_plan(s.filings(spark, sf), s.headers(spark, sf), s.stored(spark, sf), "1996-01-01", "1999-12-31")


@register(s.with_("filings", "headers", "stored", more="""missing AS (SELECT f.accession FROM filings f LEFT JOIN filing_headers h USING (accession)
    LEFT JOIN stored d USING (accession) WHERE h.accession IS NULL OR d.accession IS NULL)""")
    + """SELECT (SELECT count(*) FROM filings) AS filings, (SELECT count(DISTINCT cik) FROM filings) AS firms, (SELECT count(*) FROM stored) AS documents,
    (SELECT count(*) FROM missing) AS incomplete""")  # fmt: skip
def status_summary(spark: SparkSession, sf: str) -> DataFrame:
    return universe.status(s.filings(spark, sf), s.headers(spark, sf), s.stored(spark, sf))
