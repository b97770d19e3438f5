import math
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import evaluation, labels, learn


def test_event_windows(spark):
    reports = spark.createDataFrame(
        [("k1", 1, date(2019, 12, 31), datetime(2020, 3, 1)), ("k2", 2, date(2019, 12, 31), datetime(2020, 3, 1)), ("k3", 3, date(2022, 12, 31), datetime(2023, 9, 1))],
        "accession string, cik long, fiscal_period_end date, accepted_at timestamp",
    )
    filings = spark.createDataFrame(
        [(1, "8-K", date(2020, 9, 17), "4.02"), (1, "8-K", date(2019, 6, 1), "4.01"), (2, "8-K", date(2020, 3, 1), "4.02"), (2, "8-K", date(2021, 3, 5), "1.03"), (1, "10-K", date(2020, 9, 17), "1.03")],
        "cik long, form string, filing_date date, items string",
    )
    facts = spark.createDataFrame([("k1", "EntityPublicFloat", 5e7, "USD"), ("k1", "EntityPublicFloat", -1.0, "USD")], "accession string, concept string, value double, unit string")
    rows = {r.accession: r for r in labels.event_labels(reports, filings, facts, F.lit(datetime(2024, 6, 1))).collect()}
    assert set(rows) == {"k1", "k2"} and rows["k1"].label and rows["k1"].restatement and rows["k1"].prior_event and not rows["k1"].bankruptcy
    assert not rows["k2"].label and rows["k2"].log_float == 0 and not rows["k2"].has_float and rows["k1"].log_float == pytest.approx(math.log(5e7 + 1)) and rows["k1"].split == "val"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("answer", "want"), [("68.6 billion", 68.6e9), ("unknown", None), (" Unknown 5", None), ("$1,250 thousand", 1.25e6), ("about 3 million billion", 3e6), ("none", None), ("12", 12.0), ("7 dollars and one million", 7.0)])
def test_answers(spark, answer, want):
    assert one(spark, text.parse_answer(F.lit(answer))) == pytest.approx(want)


def test_regex_extraction(spark):
    got = one(spark, text.extract_revenue(F.lit("(in thousands)\nTotal revenues were $1,250 for the year")))
    assert got == 1.25e6 and one(spark, text.extract_revenue(F.lit("net sales of 2.5 billion (in millions)"))) == 2.5e9 and one(spark, text.extract_revenue(F.lit("no figure"))) is None


def test_answerable(spark):
    usd = F.lit(68_636_146_000.0)
    for passage, want in (("68.6 billion", True), ("68,636", True), ("68,636,146", True), ("61,280", False), ("69", True), ("", False)):
        assert one(spark, text.is_answerable(F.lit(passage), usd)) is want


def test_passage(spark):
    lines = ["intro", "Total revenues 5"] + [f"line {i}" for i in range(9)] + ["prose " * 60, "net sales", "x" * 301, "y" * 299]
    got = one(spark, labels.passage(F.lit("\n".join(lines)))).split("\n")
    assert got == lines[1:8] + ["net sales", "y" * 299]
    cut = one(spark, labels.passage(F.lit("sales\n" + "1" * 50 + "\n" + "2" * 50 + "\nz"), most=80)).split("\n")
    assert cut == ["sales", "1" * 50]
    assert one(spark, labels.passage(F.lit("noregrets wholesales"))) == ""


def test_truth_scores_and_prompt(spark):
    reports = spark.createDataFrame([("a", date(2019, 12, 31))], "accession string, fiscal_period_end date")
    facts = spark.createDataFrame(
        [("a", c, v, "USD", s, date(2019, 12, 31)) for c, v, s in (("SalesRevenueNet", 9.0, date(2019, 1, 1)), ("Revenues", 1.0, date(2019, 10, 1)), ("Revenues", 3.0, date(2019, 1, 1)), ("Revenues", 4.0, date(2019, 1, 1)))],
        "accession string, concept string, value double, unit string, period_start date, period_end date",
    )
    assert labels.stated_revenue(reports, facts).first()[:] == ("a", "Revenues", 4.0)
    rows = spark.createDataFrame([(100.0, True, 100.4), (100.0, True, None), (100.0, False, None), (100.0, False, 7.0)], "revenue_usd double, answerable boolean, prediction double")
    assert labels.extraction_scores(rows).first()[:] == (2, 0.5, 0.5, 2, 0.5, 0.25)
    assert "2019-12-31" in one(spark, text.prompt(F.lit("P"), F.lit("2019-12-31")))
    assert one(spark, text.fit_budget(F.lit("a b c d e f g h"), 5)).split() == ["a", "b", "c", "d", "e"] and one(spark, text.fit_budget(F.lit("a b"), 5)) == "a b"


def plain_auc(y, s):
    pos, neg = [a for a, b in zip(s, y, strict=True) if b], [a for a, b in zip(s, y, strict=True) if not b]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_ranking_measures(spark):
    draw = np.random.default_rng(0)
    y, s = (draw.random(300) < 0.3).astype(int), np.round(draw.random(300), 1)
    df = spark.createDataFrame([(int(a), float(b), int(i % 20)) for i, (a, b) in enumerate(zip(y, s, strict=True))], "label int, score double, firm int")
    assert evaluation.roc_auc(df).first().auc == pytest.approx(plain_auc(y, s))
    order = sorted(set(s), reverse=True)
    ap, hits = 0.0, 0
    for t in order:
        new, got = int(y[s == t].sum()), int(y[s >= t].sum())
        ap += new / y.sum() * got / (s >= t).sum()
        hits = got
    assert hits == y.sum() and evaluation.average_precision(df).first().average_precision == pytest.approx(ap)
    band = evaluation.cluster_bootstrap(df, "firm", draws=100).first()
    assert band.low < plain_auc(y, s) < band.high and band.draws > 90
    same = evaluation.cluster_bootstrap(df.withColumn("other", F.col("score")), "firm", draws=20, other="other").first()
    assert same.low == same.high == 0


def test_poisson_draws_have_mean_and_variance_one(spark):
    got = spark.range(20_000).select(evaluation.multiplicity(F.lit(1), F.col("id")).alias("m")).agg(F.avg("m"), F.variance("m")).first()
    assert got[0] == pytest.approx(1, abs=0.03) and got[1] == pytest.approx(1, abs=0.05)


def test_moments(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    assert df.agg(*evaluation.moments(F.col("x"))).first()[:] == pytest.approx((1.3309377, 1.5 + 3), rel=1e-6)


def test_features_and_regression(spark):
    docs = spark.createDataFrame([(i, "good fine day" if i % 2 else "bad dull day", i % 2) for i in range(20)], "doc_id long, text string, label int")
    weights = learn.tfidf(docs, least=2, most=0.9)
    assert {r.term for r in weights.collect()} == {"good", "fine", "bad", "dull", "good fine", "fine day", "bad dull", "dull day"}
    assert all(r.s == pytest.approx(1) for r in weights.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect())
    rows = weights.where("term in ('good', 'bad')").groupBy("doc_id").pivot("term", ["good", "bad"]).sum("weight").na.fill(0).join(docs, "doc_id")
    assembler, scaler = learn.standardised(rows, ["good", "bad"])
    ready = learn.balanced(scaler.transform(assembler.transform(rows)))
    assert ready.agg(F.sum("weight")).first()[0] == pytest.approx(20)
    scored = learn.with_score(learn.best_of(ready, ready, (0.1, 1.0)), ready)
    assert evaluation.roc_auc(scored).first().auc == 1.0
