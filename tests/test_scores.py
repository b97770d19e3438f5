import math

import duckdb
from pyspark.sql import functions as F

from palimpsest.functions import formats
from palimpsest.functions.ranks import medians, value_counts
from palimpsest.operators import scores


def test_windows(spark):
    rows = spark.createDataFrame([(1, list(range(1025))), (2, []), (3, list(range(510))), (4, list(range(40_000)))], "k long, ids array<long>")
    got = {r.k: r.w for r in rows.select("k", scores.windows(F.col("ids")).alias("w")).collect()}
    assert [len(w) for w in got[1]] == [510, 510, 5] and sum(got[1], []) == list(range(1025))
    assert got[2] == [[]] and [len(w) for w in got[3]] == [510] and len(got[4]) == 64
    assert rows.where("k = 4").select(F.size(scores.windows(F.col("ids"), most=None))).first()[0] == 79


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("doc"))
    one, other = ({r.k for r in scores.sample(rows.repartition(n), 100, "k").collect()} for n in (1, 5))
    assert one == other and len(one) == 100 and one != set(range(100)) and one != {r.k for r in scores.sample(rows, 100, "k", seed=8).collect()}
    by_doc = scores.sample_by(rows, "doc", 3, "k").groupBy("doc").count().collect()
    assert len(by_doc) == 7 and {r["count"] for r in by_doc} == {3}


def test_length_batches(spark):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate([5, 1, 1, 9, 5, 5, 2])], "k long, n long")
    got = sorted((r.batch, r.k, r.width) for r in scores.length_batches(rows, "n", 3, "k").collect())
    assert got == [(0, 1, 2), (0, 2, 2), (0, 6, 2), (1, 0, 5), (1, 4, 5), (1, 5, 5), (2, 3, 9)]
    assert scores.length_batches(rows.limit(0), "n", 3, "k").count() == 0


def test_outputs_of_either_model_alone(spark):
    risk = spark.createDataFrame([("a", True, 0.5), ("b", False, 0.1), ("c", False, 0.5)], "accession string, label boolean, score double")
    told = spark.createDataFrame([("c", True, "1.5 million", "unknown"), ("d", False, "unknown", "7")], "accession string, answerable boolean, qlora string, zero_shot string")
    assert scores.model_outputs(None, None) is None and scores.with_outputs(risk, None) is risk
    assert {r.accession: r.risk_pct for r in scores.model_outputs(risk, None).collect()} == {"a": 2.5 / 3, "b": 1 / 3, "c": 2.5 / 3}
    both = {r.accession: r for r in scores.model_outputs(risk, told).collect()}
    assert set(both) == set("abcd") and both["c"].qlora_usd == 1.5e6 and both["c"].zero_shot_usd is None and both["d"].risk_pct is None and both["d"].zero_shot_usd == 7
    joined = scores.with_outputs(spark.createDataFrame([("c",), ("x",)], "accession string"), scores.model_outputs(risk, told))
    assert {r.accession: r.answerable for r in joined.collect()} == {"c": True, "x": None}


def test_precision_without_answers(spark):
    rows = spark.createDataFrame([(10, 5, 0.0, 1.0, 0.0), (10, 5, 0.5, 0.8, 0.2)], "answerable_n long, unanswerable_n long, answered_answerable double, abstain_unanswerable double, accuracy_all double")
    a, b = (r.precision_when_answering for r in scores.precision_when_answering(rows).collect())
    assert math.isnan(a) and abs(b - 0.2 * 15 / (0.5 * 10 + 0.2 * 5)) < 1e-12


def test_formats(spark):
    x = [1.234e10, 9.994e9, 1.26e7, 1.26e6, 1500.0, 12.5, -2.5e6, 0.0, None, float("nan"), float("inf")]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select(formats.money(F.col("x")), formats.pct(F.col("x")), formats.num(F.col("x"), 1)).collect()
    assert [r[0] for r in rows] == ["$12.3B", "$9.99B", "$13M", "$1.3M", "$2K", "$13", "-$2.5M", "$0", "—", "—", "—"]
    assert rows[5][1] == "1250.0%" and rows[5][2] == "12.5" and rows[8][1] == rows[10][2] == "—"
    one = spark.range(1)
    assert one.select(formats.num(F.lit(-0.0001))).first()[0] == "-0.000"
    assert one.select(formats.interval(F.lit(-0.1), F.lit(0.25), 2), formats.interval(F.lit(None).cast("double"), F.lit(1.0))).first()[:] == ("[-0.10, 0.25]", "")
    assert one.select(formats.significant(F.lit(0.1), F.lit(0.2)), formats.significant(F.lit(-0.1), F.lit(0.2)), formats.significant(F.lit(None).cast("double"), F.lit(None).cast("double"))).first()[:] == (True, False, False)
    assert one.select(formats.revenue_matches(F.lit(1005.0), F.lit(1000.0)), formats.revenue_matches(F.lit(0.0), F.lit(0.0)), formats.revenue_matches(F.lit(None).cast("double"), F.lit(1.0))).first()[:] == (True, False, False)
    assert one.select(formats.escape_html(F.lit("<a href=\"x\">'&amp;'</a>"))).first()[0] == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;amp;&#39;&lt;/a&gt;"


def test_formats_round_as_the_sql_does(spark, tmp_path):
    """Prices whose billions lie at a half by their decimal form and below it as doubles, each under all kinds of keys."""
    from palimpsest.plans import outputs

    prices = [1005.0, 1015.0, 1255.0, 10050.0, 12550.0, 1125.0, 11250.0, 250.0, 500.0, 1500.0, 2500.0, 235450.0, 0.5]
    con = duckdb.connect()
    con.execute("create table orders as select CAST(row_number() over () AS BIGINT) AS o_orderkey, p AS o_totalprice FROM range(9), unnest(?::DOUBLE[]) AS t(p)", [prices])
    con.execute(f"copy orders to '{tmp_path}/orders.parquet' (format parquet)")
    want = con.execute(outputs.ORACLE_SQL["viewer_formats"]).fetchall()
    got = outputs.viewer_formats(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    money = spark.createDataFrame([(1.005e9,), (1.125e9,), (1.5,), (1e300,)], "x double").select(formats.money(F.col("x"))).collect()
    assert [r[0] for r in money[:3]] == ["$1.00B", "$1.13B", "$2"] and money[3][0].startswith("$1000")
    assert spark.range(1).select(formats.num(F.lit(1.7e308))).first()[0].startswith("17000")


def test_ranks_in_many_buckets(spark):
    values = [(k % 3 if k % 11 else None, float(k * k % 97) if k % 13 else float("nan")) for k in range(600)]
    df = spark.createDataFrame(values, "g long, x double")
    got = {(r.g, str(r.x)): (r.n, r.before) for r in value_counts(df, ["g"], "x", rows=5).collect()}
    order = lambda x: (math.isnan(x), x)
    for g in (0, 1, 2, None):
        own = sorted((x for k, x in values if k == g), key=order)
        for x in {str(v): v for v in own}.values():
            n = sum(str(v) == str(x) for v in own)
            assert got[g, str(x)] == (n, sum(order(v) < order(x) for v in own))
    known = df.where("not isnan(x)")
    found = {r.g: r.x for r in medians(known, ["g"], ["x"]).collect()}
    for g in (0, 1, 2, None):
        own = sorted(x for k, x in values if k == g and not math.isnan(x))
        assert found[g] == (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2
