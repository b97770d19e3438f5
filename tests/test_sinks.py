import gzip
import hashlib
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from palimpsest import schemas, sinks
from palimpsest.operators import export
from palimpsest.operators.upsert import keep_last, upsert
from palimpsest.streaming import incremental


def test_upsert(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, x string, y double")
    new = spark.createDataFrame([("B", 2), ("C", 3)], "x string, k long")
    assert sorted(tuple(r) for r in upsert(old, new, ["k"]).collect()) == [(1, "a", 1.0), (2, "B", None), (3, "C", None)]
    path = str(tmp_path / "t")
    assert sinks.upsert_table(old, path, ["k"]) == 2
    assert sinks.upsert_table(new.withColumn("y", F.lit(9.0)), path, ["k"]) == 2
    assert sinks.upsert_table(old.limit(0), path, ["k"]) == 0
    assert sorted(tuple(r) for r in sinks.read_table(spark, path).collect()) == [(1, "a", 1.0), (2, "B", 9.0), (3, "C", 9.0)]
    folders = lambda: {p.parent.name for p in (tmp_path / "t").rglob("__part=*")}
    assert len(folders()) == 2 and len(list((tmp_path / "t/_manifests").glob("[0-9]*"))) == 2
    one = spark.createDataFrame([(2, "C", 1.0)], "k long, x string, y double")
    before = sinks._manifest(spark, path)[1]["folders"]
    assert sinks.upsert_table(one, path, ["k"]) == 1
    after = sinks._manifest(spark, path)[1]["folders"]
    assert sum(before[k] != after[k] for k in before) == 1  # only the part that it touches is written again
    with pytest.raises(OSError):
        sinks._publish(spark, path, 3, {})
    assert sinks.read_table(spark, path).count() == 3
    assert keep_last(spark.createDataFrame([(1, 1), (1, 2)], "k long, v long"), ["k"], ["v"]).first().v == 2


def test_run_once_and_log(spark, tmp_path):
    path, log = str(tmp_path / "r"), str(tmp_path / "log")
    sinks.write_once(spark.range(3), path)
    with pytest.raises(sinks.AlreadyRun):
        sinks.write_once(spark.range(4), path)
    sinks.write_once(spark.range(4), path, force=True)
    assert sinks.read_table(spark, path).count() == 4
    with sinks.logged_run(spark, log) as counters:
        counters["requests"] = 5
        assert sinks.read_table(spark, log).first().status == "running"
    with pytest.raises(KeyError), sinks.logged_run(spark, log):
        raise KeyError
    assert sorted((r.status, r.requests) for r in sinks.read_table(spark, log).collect()) == [("failed", 0), ("ok", 5)]


def test_schemas(spark):
    for table in schemas.TABLES:
        df = schemas.empty(spark, table)
        assert set(schemas.key(table)) <= set(df.columns) and df.count() == 0
    rows = spark.createDataFrame([("a", "u"), ("a", "v"), (None, "w")], "accession string, url string")
    assert {r.accession for r in schemas.key_violations(rows, "documents").collect()} == {"a", None}


def land(spark, path, rows):
    spark.createDataFrame(rows, "accession string, raw binary").write.mode("append").parquet(path)


def test_documents_are_parsed_once_as_they_land(spark, tmp_path):
    landing, out, bad, state = (str(tmp_path / n) for n in ("landing", "out", "bad", "state"))
    body = b"<p>Item 7. Management</p><p>" + b"words " * 300 + b"</p><p>Item 8.</p>"
    land(spark, landing, [("a", bytearray(body)), ("b", None)])
    incremental.parse_landing(spark, landing, out, state, bad).awaitTermination()
    assert {(r.accession, r.section, r.status) for r in sinks.read_table(spark, out).collect()} == {("a", "mdna", "found"), ("a", "risk_factors", "not_found")}
    assert [r.accession for r in sinks.read_table(spark, bad).collect()] == ["b"]
    land(spark, landing, [("c", bytearray(body)), ("a", bytearray(b"changed"))])
    incremental.parse_landing(spark, landing, out, state, bad).awaitTermination()
    rows = sinks.read_table(spark, out)
    assert rows.count() == 4 and rows.where("accession = 'a' and section = 'mdna'").first().status == "found"  # not parsed again
    incremental.parse_landing(spark, landing, out, state, bad, version=2).awaitTermination()
    assert sinks.read_table(spark, out).where("accession = 'a' and section = 'mdna'").count() == 1


def test_a_document_that_fails_does_not_stop_the_others(spark, tmp_path):
    landing, out, bad, state = (str(tmp_path / n) for n in ("landing", "out", "bad", "state"))
    land(spark, landing, [(f"d{i}", bytearray(b"text")) for i in range(9)] + [("broken", bytearray(b"x")), ("empty", None)])

    def parse(docs):
        worse = F.when(F.col("accession") == "broken", F.raise_error(F.lit("cannot be parsed"))).otherwise(F.lit("found"))
        return docs.select("accession", F.lit("mdna").alias("section"), worse.alias("status"), F.lit(1).alias("parser_version"))

    incremental.parse_landing(spark, landing, out, state, bad, parse=parse).awaitTermination()
    assert {r.accession for r in sinks.read_table(spark, out).collect()} == {f"d{i}" for i in range(9)}
    failed = {r.accession: r.error for r in sinks.read_table(spark, bad).collect()}
    assert set(failed) == {"broken", "empty"} and "cannot be parsed" in failed["broken"]


def test_packed_documents_and_files_by_key(spark, tmp_path):
    docs = spark.createDataFrame([(1, bytearray(b"a" * 1000), "x"), (2, None, "y"), (3, bytearray(b""), "z")], "id long, raw binary, packed string")
    rows = {r.id: r for r in sinks.pack(docs).collect()}
    assert gzip.decompress(rows[1].packed) == b"a" * 1000 and rows[1].bytes_raw == 1000 and rows[1].bytes_stored < 100
    assert rows[1].sha256 == hashlib.sha256(b"a" * 1000).hexdigest() and rows[2].packed is None and gzip.decompress(rows[3].packed) == b""
    sinks.write_by_key(docs.select("id"), str(tmp_path / "k"), "id")
    assert sorted(p.name for p in (tmp_path / "k").glob("key=*")) == ["key=1", "key=2", "key=3"]
    assert json.loads(next((tmp_path / "k/key=2").glob("*.json")).read_text()) == {"id": 2}


def test_files_by_key_without_a_committer(spark, tmp_path):
    """Keys to escape, none, or with several records; the folder's own writer makes the same, and nothing of before stays."""
    rows = [("a/b=c", 1), ("a/b=c", 2), ("", 3), (None, 4), ("é x\n", None), ("plain", 6)]
    docs = spark.createDataFrame(rows, "k string, v long")
    plain, path = str(tmp_path / "plain"), f"file://{tmp_path}/k"
    docs.withColumn("key", F.col("k")).repartition("key").write.partitionBy("key").json(plain)
    sinks.write_by_key(docs.where("v = 6").withColumn("k", F.lit("old")), path, "k")
    sinks.write_by_key(docs, path, "k")
    held = lambda top: {p.parent.name: sorted(x for x in p.read_text().split("\n") if x) for p in (tmp_path / top).glob("key=*/*.json")}
    assert held("k") == held("plain") and len(held("k")) == 4
    assert not list((tmp_path / "k").rglob("*.crc")) and (tmp_path / "k/_SUCCESS").exists()
    assert sorted(map(str, sinks.read_by_key(spark, path, docs.schema).collect())) == sorted(map(str, docs.collect()))


def test_upsert_stream(spark, tmp_path):
    landing, table = str(tmp_path / "l"), str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string").write.parquet(landing)
    stream = spark.readStream.schema("k long, v string").parquet(landing)
    incremental.upsert_stream(stream, table, ["k"], str(tmp_path / "c"), ["v"]).awaitTermination()
    assert [tuple(r) for r in sinks.read_table(spark, table).collect()] == [(1, "b")]


def test_export(spark, tmp_path):
    filers = spark.createDataFrame([(1, "A Co", "tools", "AA"), (2, "B", None, None), (3, "No reports", None, None)], "cik long, name string, industry string, current_tickers string")
    reports = spark.createDataFrame(
        [(1, "a1", 1, "10-K", False, date(2019, 12, 31), "T1", 0.987654321), (1, "a2", 1, "10-K", False, date(2020, 12, 31), None, float("nan")), (1, "a3", 2, "10-K/A", True, date(2020, 12, 31), "T9", 0.1), (2, "b1", 1, "10-K", False, None, None, 0.5)],
        "cik long, accession string, version_no long, form string, is_amendment boolean, fiscal_period_end date, ticker string, sim double",
    ).withColumns({"stored_path": F.lit("x"), "accepted_at_et": F.lit(None).cast("timestamp_ntz"), "dated_next_business_day": F.lit(False)})
    changes = reports.select("accession", F.lit("risk_factors").alias("section"), F.col("sim").alias("sim_tfidf_pit"), F.lit(5).alias("words"))
    amount = reports.select("accession", F.lit(68_636_146_000.4).alias("public_float"), F.lit(None).cast("double").alias("revenue_usd"))
    rows = export.report_rows(reports.drop("ticker", "sim"), reports.select("accession", "ticker"), amount, amount, changes)
    got = {r.accession: r for r in rows.collect()}
    assert got["a1"].sim_rf == 0.9877 and got["a2"].sim_rf is None and got["a1"].public_float == 68_636_146_000.0
    events = export.events(spark.createDataFrame([(1, "8-K", date(2020, 1, 1), "2.01,4.02"), (1, "8-K/A", date(2020, 2, 1), "9.01"), (1, "10-K", date(2020, 1, 1), "2.01")], "cik long, form string, filing_date date, items string"))
    assert events.first().kinds == ["acquisition/disposition", "restatement"] and events.count() == 1
    records = export.firms(filers, rows, events)
    index = {r.cik: r for r in export.firm_index(records).collect()}
    assert set(index) == {1, 2} and index[1].ticker == "T1" and (index[1].reports, index[1].events, index[1].min_sim_rf) == (2, 1, 0.9877) and not index[2].has_current_ticker
    listed = export.firm_index(records)
    assert [r.cik for r in export.search(listed).collect()] == [2, 1] and [r.cik for r in export.search(listed, " t1 ").collect()] == [1] and export.search(listed, "zz").count() == 0
    sinks.write_json(records, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
