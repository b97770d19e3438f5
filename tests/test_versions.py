from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.times import api_instant, local_time, trading_session
from palimpsest.operators import reports as findings
from palimpsest.operators import universe
from palimpsest.operators.versions import as_of, clock_check, report_versions
from palimpsest.sources import headers

HEAD = "<SEC-HEADER>\n<ACCEPTANCE-DATETIME>{}\n<PERIOD>20141231\n"


@pytest.fixture(scope="module")
def tables(spark):
    filings = spark.createDataFrame(
        [
            ("0000000001-15-000001", 1, "10-K", date(2015, 3, 2), date(2014, 12, 31), "2015-02-28T07:05:00.000Z", None),
            ("0000000001-15-000002", 1, "10-K/A", date(2015, 3, 20), date(2014, 12, 31), "2015-03-20T14:00:00.000Z", None),
            ("0000000001-15-000003", 1, "8-K", date(2015, 4, 1), None, None, "2.01,9.01"),
            ("0000000004-15-000001", 4, "10-K", date(2015, 3, 5), None, "2015-03-05T21:00:00.000Z", None),
            ("0000000004-15-000009", 4, "10-K", date(2015, 3, 9), date(2014, 12, 31), None, None),
        ],
        "accession string, cik long, form string, filing_date date, report_date date, accepted_api_raw string, items string",
    )
    raw = [("0000000001-15-000001", "20150227180500"), ("0000000001-15-000002", "20150320100000"), ("0000000004-15-000001", "20150305160000")]
    heads = spark.createDataFrame([(a, HEAD.format(t)) for a, t in raw], "accession string, t string")
    heads = heads.select("accession", headers.accepted_at(F.col("t")).alias("accepted_at"), headers.period(F.col("t")).alias("header_period"))
    stored = spark.createDataFrame([("0000000001-15-000001", "x", 10, 5)], "accession string, stored_path string, bytes_raw long, bytes_stored long")
    return filings, heads, stored


def test_versions(tables):
    rows = {r.accession: r for r in report_versions(*tables).collect()}
    assert "0000000001-15-000003" not in rows
    assert [(rows[a].version_no, rows[a].original_accession, rows[a].is_amendment) for a in ("0000000001-15-000001", "0000000001-15-000002")] == [
        (1, "0000000001-15-000001", False), (2, "0000000001-15-000001", True),
    ]
    first = rows["0000000001-15-000001"]
    assert first.accepted_at == datetime(2015, 2, 27, 23, 5) and first.accepted_at_et == datetime(2015, 2, 27, 18, 5) and first.dated_next_business_day
    assert not rows["0000000004-15-000001"].dated_next_business_day
    late = rows["0000000004-15-000009"]  # never accepted: last, whatever its id
    assert late.version_no == 2 and late.dated_next_business_day is None and late.fiscal_period_end == date(2014, 12, 31)


@pytest.mark.parametrize(("at", "want"), [("2015-02-27 23:00:00", []), ("2015-03-01 00:00:00", ["0000000001-15-000001"]), ("2015-03-21 00:00:00", ["0000000001-15-000002", "0000000004-15-000001"])])
def test_as_of(tables, at, want):
    assert sorted(r.accession for r in as_of(report_versions(*tables), F.lit(at).cast("timestamp")).collect()) == want


def test_clock(tables):
    rows = {r.accession: r.api_minus_header_hours for r in clock_check(*tables[:2]).collect()}
    assert rows == {"0000000001-15-000001": 8.0, "0000000001-15-000002": 0.0, "0000000004-15-000001": 0.0}
    flips = findings.session_flips(clock_check(*tables[:2])).first()
    assert (flips.filings, flips.session_flips) == (3, 1)


def test_seasons_and_sessions(spark):
    heads = [("20150115093000", "2015-01-15 14:30:00", "regular"), ("20150715092900", "2015-07-15 13:29:00", "pre-open"), ("20150715160000", "2015-07-15 20:00:00", "after-close")]
    for digits, utc, part in heads:
        row = spark.range(1).select(headers.accepted_at(F.lit(HEAD.format(digits))).alias("t")).select("t", trading_session(local_time(F.col("t"))).alias("s")).first()
        assert str(row.t) == utc and row.s == f"{utc[:10]} {part}"
    assert spark.range(1).select(headers.accepted_at(F.lit("none")), headers.period(F.lit("CONFORMED PERIOD OF REPORT:\t20240928")), api_instant(F.lit("junk"))).first()[:] == (None, date(2024, 9, 28), None)


def test_findings(tables):
    reports = report_versions(*tables)
    assert findings.coverage(reports).first()[:] == (2015, 3, 1, 1, 2)
    assert findings.amendments(reports).first()[:] == (2, 50.0, 1, 21.0)
    assert findings.period_disagreement(*tables[:2]).first()[:] == (3, 1, 0)
    assert findings.storage(tables[2]).first()[:] == (1, 0.0, 0.0, 2.0)


def test_draw_stops_at_the_wanted_number(spark):
    filers = spark.createDataFrame([(i, "other" if i % 3 == 0 else "operating", 6189 if i % 7 == 0 else 1) for i in range(1, 200)], "cik long, entity_type string, sic int")
    rows = universe.draw(filers, 7, 20).orderBy("draw_rank").collect()
    assert sum(r.status == "included" for r in rows) == 20 and rows[-1].status == "included"
    assert {r.reason for r in rows} == {None, "entity_type=other", "sic=6189 (asset-backed)"}
    assert [r.cik for r in universe.draw(filers, 7, 20).orderBy("draw_rank").collect()] == [r.cik for r in rows]
    assert universe.draw(filers, 7, 10_000).count() == 199
