import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import ranks
from palimpsest.functions.ranks import percent_rank, quantile_bin, value_counts
from palimpsest.operators import inference, market
from palimpsest.plans import markets


def test_symbol_order(spark):
    reports = spark.createDataFrame([(r, datetime(2015, 3, 1), 1) for r in ("r1", "r2", "r3", "r4")] + [("r5", datetime(2015, 3, 1), 2)], "accession string, accepted_at timestamp, version_no long")
    tickers = spark.createDataFrame([("r1", 1, "AAA"), ("r2", 2, "BBB"), ("r3", 3, "OLD"), ("r4", 4, "BRK.A"), ("r5", 1, "AAA")], "accession string, cik long, ticker string")
    filers = spark.createDataFrame([(1, None), (2, None), (3, "NEWT,X"), (4, None)], "cik long, current_tickers string")
    listed = [("AAA", "Stock", "USD", date(2020, 1, 1)), ("BBB", "ETF", "USD", date(2020, 1, 1)), ("BBBQ", "Stock", "USD", date(2016, 1, 1)), ("OLD", "Stock", "USD", date(2014, 1, 1)), ("NEWT", "Stock", "USD", date(2020, 1, 1)), ("BRK-A", "Stock", "USD", date(2020, 1, 1)), ("BRK.A", "Stock", "EUR", date(2020, 1, 1))]
    catalogue = spark.createDataFrame([(t, "NYSE", k, c, e) for t, k, c, e in listed], "ticker string, exchange string, asset_type string, currency string, end_date date")
    got = {r.accession: (r.symbol, r.via_current_ticker) for r in market.resolve_symbols(tickers, reports, filers, catalogue).collect()}
    assert got == {"r1": ("AAA", False), "r2": ("BBBQ", False), "r3": ("NEWT", True), "r4": ("BRK-A", False)}


def test_nearest_close_and_validation(spark):
    prices = spark.createDataFrame([("A", date(2015, 3, d), p) for d, p in ((1, 10.0), (3, 30.0), (20, 99.0))], "symbol string, day date, close double")
    rows = spark.createDataFrame([("x", 1, "A", date(2015, 3, 2)), ("y", 1, "A", date(2015, 3, 12)), ("z", 1, "A", date(2015, 3, 13))], "accession string, cik long, symbol string, filed date")
    got = {r.accession: (r.close_near, r.gap_days) for r in market.nearest_close(rows, prices, "accession").collect()}
    assert got == {"x": (10.0, 1), "z": (99.0, 7)}
    facts = spark.createDataFrame([("x", "dei", "EntityPublicFloat", 100.0), ("x", "dei", "EntityCommonStockSharesOutstanding", 1000.0), ("z", "dei", "EntityPublicFloat", 5.0)], "accession string, taxonomy string, concept string, value double")
    checked = {r.accession: (r.has_price, r.size_ok) for r in market.validate_matches(rows, prices, facts).collect()}
    assert checked == {"x": (True, False), "y": (False, True), "z": (True, True)}


def test_nearest_close_over_spans(spark):
    """Against all pairs, also before 1970 and with other reaches."""
    rng = random.Random(5)
    days = [date(1969, 12, 1) + timedelta(k) for k in range(60)]
    prices = [(s, d, float(rng.randrange(1000))) for s in "AB" for d in rng.sample(days, 20)]
    rows = [(k, rng.choice("ABC"), rng.choice(days)) for k in range(150)]
    made = spark.createDataFrame(prices, "symbol string, day date, close double")
    asked = spark.createDataFrame(rows, "k long, symbol string, filed date")
    for within in (0, 1, 7):
        want = {}
        for k, symbol, filed in rows:
            near = [(abs((d - filed).days), d, c) for s, d, c in prices if s == symbol and abs((d - filed).days) <= within]
            if near:
                want[k] = (min(near)[2], min(near)[0])
        assert {r.k: (r.close_near, r.gap_days) for r in market.nearest_close(asked, made, "k", within=within).collect()} == want


@pytest.mark.parametrize("name", ["nearest_close", "match_validation"])
def test_rows_near_a_price_are_not_sent_to_the_driver(spark, name):
    """However small the files seem to the planner."""
    plan = markets.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_kept_rows_take_a_fraction_of_a_checkpoint(spark, tmp_path):
    from pathlib import Path

    from palimpsest import session

    rows = spark.range(50_000).selectExpr("id", "CAST(id % 7 AS STRING) AS section", "date_add(DATE '2001-01-31', CAST(id % 60 AS INT)) AS month", "IF(id % 3 = 0, NULL, id % 89 / 89.0D) AS sim")
    top = Path(session.checkpoint_folder(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in top.rglob("*") if p.is_file())
    sizes = [size()]
    for keep in (session.keep, session.keep_table):
        kept = keep(rows)
        sizes.append(size())
        assert kept.schema.simpleString() == rows.schema.simpleString() and kept.exceptAll(rows).count() == rows.exceptAll(kept).count() == 0
    assert (sizes[2] - sizes[1]) * 4 < sizes[1] - sizes[0]


def daily(symbol, points):
    return [(symbol, d, p, p) for d, p in points]


def test_months_and_formation(spark):
    live = [(date(2021, m, d), 100.0 * (1 + 0.1 * (m - 1))) for m in (1, 2, 3) for d in (5, 29 - (m == 2))]
    dead = [(date(2021, 1, 29), 10.0), (date(2021, 2, 10), 5.0)]
    gap = [(date(2021, 1, 5), 1.0), (date(2021, 3, 5), 2.0), (date(2021, 3, 6), 0.0)]
    prices = spark.createDataFrame(daily("LIVE", live) + daily("DEAD", dead) + daily("GAP", gap), "symbol string, day date, adj_close double, close double")
    returns = {(r.symbol, r.month): (round(r.ret, 6), r.delisted) for r in market.monthly_returns(prices).collect()}
    assert returns[("DEAD", date(2021, 2, 28))] == (-0.5, True) and returns[("LIVE", date(2021, 2, 28))] == (0.1, False) and not any(s == "GAP" for s, _ in returns)
    changes = spark.createDataFrame([(1, "f", datetime(2021, 1, 29, 21, 30), s, 0.5) for s in ("risk_factors", "mdna")] + [(2, "g", datetime(2021, 1, 4), "mdna", 0.2)], "cik long, accession string, accepted_at timestamp, section string, sim double")
    symbols = spark.createDataFrame([("f", "DEAD", 2e8), ("g", "LIVE", 1e9)], "accession string, symbol string, public_float double")
    formed = market.signals(changes, prices, symbols)
    months = {(r.cik, r.section): [] for r in formed.collect()}
    for r in formed.collect():
        months[(r.cik, r.section)].append(r.month)
    assert date(2021, 1, 31) not in months[(1, "mdna")] and min(months[(1, "mdna")]) == date(2021, 2, 28) and min(months[(2, "mdna")]) == date(2021, 1, 31)
    both = formed.where("section = 'both' and month = '2021-02-28'").first()
    assert both.cik == 1 and both.sim == pytest.approx((1.0 + 1.0) / 2)  # the highest of two in one section, alone in the other
    early = formed.withColumn("month", F.lit(date(2021, 1, 31)))
    bankrupt = spark.createDataFrame([(1, date(2020, 8, 1)), (2, date(2021, 2, 1))], "cik long, filing_date date")
    held = {(r.cik, r.section): (round(r.ret, 6), r.adjusted) for r in market.holding_returns(early, market.monthly_returns(prices), bankrupt).collect()}
    assert held[(1, "mdna")] == (round(0.5 * 0.7 - 1, 6), True) and held[(2, "mdna")] == (0.1, False)
    assert not market.holding_returns(early, market.monthly_returns(prices)).where("adjusted").count()


def test_portfolios(spark):
    rows = [("s", date(2021, 1, 31), i, f"a{i}", float(i), 0.0 if i < 8 else 0.05 if i == 8 else 0.07, 3.0 if i == 9 else 1.0) for i in range(10)]
    held = spark.createDataFrame(rows, "section string, hold date, cik long, accession string, sim double, ret double, public_float double")
    got = {r.weighting: r for r in market.portfolios(held, least=5).collect()}
    assert got["ew"].q5 == pytest.approx(0.06) and got["vw"].q5 == pytest.approx((0.05 + 3 * 0.07) / 4) and got["ew"].ls == pytest.approx(0.06)
    assert market.portfolios(held).count() == 0


def test_bins_are_cuts_of_ordinals(spark):
    for n in (50, 52, 97, 123):
        df = spark.range(1, n + 1).select(quantile_bin(F.col("id"), F.lit(n)).alias("q")).toPandas()
        assert df.q.tolist() == (pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False) + 1).tolist()


def test_distributed_ranks(spark):
    draw = random.Random(3)
    values = [(draw.choice("ab"), draw.choice([draw.random(), round(draw.random(), 1), None])) for _ in range(400)]
    df = spark.createDataFrame(values, "k string, x double")
    got = percent_rank(df, ["k"], "x", "p").toPandas().sort_values(["k", "x"])
    want = got.groupby("k").x.rank(pct=True)
    assert np.allclose(got.p.astype(float), want, equal_nan=True)
    assert value_counts(df.limit(0), ["k"], "x").count() == 0


def panel(spark, drift, seed):
    draw = np.random.default_rng(seed)
    rows = []
    for m in range(48):
        month = (date(2015, 1, 31) + timedelta(days=31 * m)).replace(day=28)
        sims = draw.random(60)
        for i, s in enumerate(sims):
            rows.append(("s", month, i, f"a{i}", float(s), float(draw.normal(0, 0.05) + drift * s), 1.0))
    return spark.createDataFrame(rows, "section string, hold date, cik long, accession string, sim double, ret double, public_float double")


def test_a_planted_drift_is_found_and_noise_is_not(spark):
    for drift, seed in ((0.04, 1), (0.0, 2)):
        series = market.portfolios(panel(spark, drift, seed)).where("weighting = 'ew'")
        row = inference.evaluate(series, ["section", "weighting"]).first()
        assert row.months == 48 and (row.t_mean > 3 if drift else abs(row.t_mean) < 2.5)


def test_newey_west_without_lags_is_the_mean_error():
    y = np.random.default_rng(0).normal(size=100)
    beta, se = inference.newey_west(y, np.ones((100, 1)), lags=0)
    assert beta[0] == pytest.approx(y.mean()) and se[0] == pytest.approx(y.std(ddof=1) / 10)
    x = np.column_stack([np.ones(100), np.arange(100.0)])
    beta, se = inference.newey_west(3 + 2 * x[:, 1], x)
    assert beta == pytest.approx([3, 2]) and np.all(se < 1e-8)


def test_deflated_sharpe_and_decision():
    draw = np.random.default_rng(1)
    trials = {k: list(draw.normal(0.02 if k == "a" else 0.0, 0.05, 120)) for k in "abcdef"}
    found = inference.deflated_sharpe(trials, "a")
    assert found["n_trials"] == 6 and 0 < found["expected_max_sharpe"] < 1 and 0.5 < found["dsr"] <= 1
    assert inference.deflated_sharpe({"a": trials["a"]}, "a")["expected_max_sharpe"] == 0
    assert inference.minimum_detectable_effect(trials["a"]) == pytest.approx(2.8016 * np.std(trials["a"], ddof=1) / math.sqrt(120), rel=1e-3)
    assert inference.confirmed(0.01, 2.5, 0.97) and not inference.confirmed(-0.01, 2.5, 0.97) and not inference.confirmed(0.01, 1.9, 0.97)


def test_large_groups_give_the_same(spark, monkeypatch):
    """Ranks and quintiles of groups that are not sorted in a task."""
    rows = [(s, date(2020, m, 28), k, f"a{k}", (k * k * m) % 37 / 10.0 if k % 9 else None, 0.01 * (k % 13), 1.0 + k % 4) for s in ("x", "y") for m in (1, 2) for k in range(70)]
    held = spark.createDataFrame(rows, "section string, hold date, cik long, accession string, sim double, ret double, public_float double")
    plain = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)
    want = plain(market.portfolios(held)), plain(percent_rank(held, ["section", "hold"], "sim", "p"))
    monkeypatch.setattr(market, "ROWS", 10)
    monkeypatch.setattr(ranks, "ROWS", 10)
    assert (plain(market.portfolios(held)), plain(percent_rank(held, ["section", "hold"], "sim", "p"))) == want
