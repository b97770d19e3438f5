import gzip
import io
import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import facts, filers, headers, http, index, market, raw, urls

INDEX = "Description: x\nCIK|Company Name|Form Type|Date Filed|Filename\n----------\n1|A Co|10-K|2015-03-02|edgar/data/1/0000000001-15-000001.txt\n2|B|8-K|2015-01-02|edgar/data/2/b.txt\n\nbad|line\n"


def test_index_files_plain_and_gzipped(spark, tmp_path):
    for quarter, data in ((1, INDEX.encode()), (2, gzip.compress(INDEX.replace("2015-03", "2015-06").encode()))):
        folder = tmp_path / "2015" / f"QTR{quarter}"
        folder.mkdir(parents=True)
        (folder / ("master.idx" + ".gz" * (quarter == 2))).write_bytes(data)
    rows = sorted((r.index_quarter, r.cik, r.accession, r.date_filed) for r in index.read(spark, str(tmp_path)).collect())
    assert rows == [("2015Q1", 1, "0000000001-15-000001", date(2015, 3, 2)), ("2015Q2", 1, "0000000001-15-000001", date(2015, 6, 2))]
    landed = spark.createDataFrame([(2014, q) for q in range(1, 5)] + [(2015, 1)], "year int, quarter int")
    due = index.quarters_due((2014, 2015), F.lit("2015-05-01").cast("date"), landed, spark)
    assert {tuple(r) for r in due.collect()} == {(2015, 1), (2015, 2)}


FILER = {
    "cik": "0000000001", "name": "A", "entityType": "operating", "sic": "", "stateOfIncorporation": "", "tickers": ["X", "Y"],
    "formerNames": [{"name": "Old", "from": "2010-01-02T00:00:00.000Z", "to": None}],
    "filings": {"recent": {"accessionNumber": ["a", "b"], "form": ["10-K", "8-K"], "filingDate": ["2015-01-02", "2015-01-03"], "reportDate": ["", "2014-12-31"], "acceptanceDateTime": ["", "z"], "primaryDocument": ["d", ""], "size": [1, 2]}, "files": [{"name": "p1", "filingTo": "2009-01-01"}, {"name": "p2", "filingTo": "2012-01-01"}]},
}


def test_filer_documents(spark):
    docs = filers.from_text(spark.createDataFrame([(json.dumps(FILER),)], "value string"))
    row = filers.attributes(docs).first()
    assert (row.cik, row.sic, row.state_of_incorporation, row.current_tickers) == (1, None, None, "X,Y")
    assert filers.former_names(docs).first()[:] == (1, "Old", date(2010, 1, 2), None)
    assert [r.page for r in filers.pages(docs, "2010-01-01").collect()] == ["p2"]
    got = {r.accession: r for r in filers.filings(docs, "filings.recent").collect()}
    assert got["a"].report_date is None and got["a"].accepted_api_raw is None and got["a"].items is None and got["b"].primary_document is None
    assert got["b"].report_date == date(2014, 12, 31) and got["b"].size_bytes == 2


def test_facts_last_wins(spark):
    value = {"val": 1, "end": "2014-12-31", "accn": "a", "fy": 2014}
    doc = {"cik": 1, "facts": {"dei": {"EntityPublicFloat": {"units": {"USD": [value, value | {"val": 2}]}}, "Other": {"units": {"USD": [value]}}}, "us-gaap": {"Revenues": {"units": {"USD": [value | {"start": "2014-01-01"}]}}}}}
    rows = {r.concept: r for r in facts.rows(facts.from_text(spark.createDataFrame([(json.dumps(doc),)], "value string"))).collect()}
    assert set(rows) == {"EntityPublicFloat", "Revenues"} and rows["EntityPublicFloat"].value == 2.0 and rows["EntityPublicFloat"].period_start is None
    import hashlib

    assert rows["EntityPublicFloat"].fact_id == hashlib.sha1(b"1|dei|EntityPublicFloat|USD|None|2014-12-31|a").hexdigest()
    held = spark.createDataFrame([(1, "Assets"), (2, "Revenues")], "cik long, concept string")
    failed = spark.createDataFrame([(urls_of(spark, 3),)], "url string")
    todo = facts.missing(spark.createDataFrame([(1,), (2,), (3,)], "cik long"), held, failed, urls.facts(F.col("cik")))
    assert [r.cik for r in todo.collect()] == [2]


def urls_of(spark, cik):
    return spark.range(1).select(urls.facts(F.lit(cik))).first()[0]


def test_urls(spark):
    got = spark.range(1).select(urls.document(F.lit(7), F.lit("0-1-2"), F.lit("")), urls.header(F.lit(7), F.lit("0-1-2")), urls.submissions(F.lit(7)), urls.submissions(F.lit(7), F.lit("p.json")), urls.index(F.lit(2015), F.lit(2))).first()
    assert got[0].endswith("/data/7/012/0-1-2.txt") and got[1].endswith("/data/7/012/0-1-2.hdr.sgml") and got[2].endswith("/CIK0000000007.json") and got[3].endswith("/p.json") and got[4].endswith("/2015/QTR2/master.idx")


def test_prices_lists_and_factors(spark, tmp_path):
    (tmp_path / "ABC.json").write_text(json.dumps([{"date": "2015-01-02T00:00:00Z", "adjClose": 1.5, "close": 2.0, "volume": 3}]))
    (tmp_path / "EMPTY.json").write_text("[]")
    (tmp_path / "_state.json").write_text(json.dumps([{"date": "2015-01-02", "close": 1}]))
    assert [tuple(r) for r in market.prices(spark, str(tmp_path)).collect()] == [("ABC", date(2015, 1, 2), 1.5, 2.0, 3.0)]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("l.csv", "ticker,exchange,assetType,priceCurrency,startDate,endDate\nabc,NYSE,Stock,USD,2010-01-01,2020-01-01\nx,NYSE,Stock,USD,,\n")
    assert [r[:] for r in market.symbol_list(spark, market.unzipped(packed.getvalue())).collect()] == [("ABC", "NYSE", "Stock", "USD", date(2010, 1, 1), date(2020, 1, 1))]
    five = "text\n,Mkt,SMB\n201501, 1.0,2,3,4,5,6\n201502,-1.5,2,3,4,5,6\n\n Annual\n2015,9,9,9,9,9,9\n201503,7,7,7,7,7,7\n"
    got = market.factors(spark, five, "x\n201502, 10\n201503,11\n").collect()
    assert len(got) == 1 and got[0].month == date(2015, 2, 28) and got[0].mkt == pytest.approx(-0.015) and got[0].mom == pytest.approx(0.1)


def test_raw_files(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"hello"))
    (tmp_path / "b").write_bytes(b"plain")
    rows = raw.described(raw.read(spark, str(tmp_path))).collect()
    assert sorted(bytes(r.raw) for r in rows) == [b"hello", b"plain"] and {r.bytes_raw for r in rows} == {5}
    assert raw.not_landed(spark.range(3), spark.range(2), ["id"]).first().id == 2


def test_headers_of_both_styles(spark):
    row = spark.range(1).select(headers.accepted_at(F.lit("<ACCEPTANCE-DATETIME> 20240930170001")), headers.period(F.lit("<PERIOD>20240928"))).first()
    assert str(row[0]) == "2024-09-30 21:00:01" and row[1] == date(2024, 9, 28)


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def test_client_retries_and_limits():
    clock, answers = Clock(), [(503, {}, b""), (429, {"Retry-After": "7"}, b""), (200, {}, b"ok")]
    limiter = http.RateLimiter(2, lambda: clock.now, clock.sleep)
    client = http.Client("me", limiter, lambda url, headers: answers.pop(0), clock.sleep)
    assert client.get("u") == b"ok" and (client.requests, client.retries, client.bytes) == (3, 2, 2) and 7.0 in clock.slept and 1.0 in clock.slept
    for status, error in ((404, http.NotFound), (403, http.Refused)):
        with pytest.raises(error):
            http.Client("me", limiter, lambda u, h, s=status: (s, {}, b""), clock.sleep).get("u")
    with pytest.raises(OSError):
        http.Client("me", limiter, lambda u, h: (500, {}, b""), clock.sleep, tries=2).get("u")
    fresh = Clock()
    gaps = http.RateLimiter(2, lambda: fresh.now, fresh.sleep)
    for _ in range(5):
        gaps.wait()
    assert fresh.now == pytest.approx(2.0)


def test_budget(tmp_path):
    budget = http.Budget(tmp_path / "b.json", monthly=2, hourly=3)
    for symbol in ("A", "B"):
        assert budget.allows(symbol, "2015-01", 0)
        budget.spend(symbol, 0)
    assert not budget.allows("C", "2015-01", 1) and budget.allows("A", "2015-01", 1)
    budget.spend("A", 1)
    again = http.Budget(tmp_path / "b.json", monthly=2, hourly=3)
    assert not again.allows("A", "2015-01", 2) and again.allows("A", "2015-01", 3700) and again.allows("C", "2015-02", 3700)
