"""Hand-made panels with known results, and ordered recursions against plain loops."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketweave.functions.series import cs_rank, div, ts_rank
from marketweave.operators import cross_section as xs
from marketweave.operators import filings as fl
from marketweave.operators import inference as inf
from marketweave.operators import joins as jn
from marketweave.operators import metrics as m
from marketweave.operators import portfolio as pf
from marketweave.operators import regimes as rg
from marketweave.operators import universe as un
from marketweave.operators import windows as win
from marketweave.operators.signals import compute, ewm, list_signals, register_signal
from marketweave.sources import io

CLOSE = {"A": [10, 11, 12, 13, 14, 15], "B": [11, 10.5, 10, 9.5, 9, 8.5], "C": [12, 12.5, 13, 13.5, 14, 14.5], "D": [13, 12, 11, 10, 9, 8]}
DAYS = [dt.date(2024, 1, d) for d in range(1, 7)]


@pytest.fixture(scope="module")
def bars(spark):
    rows = [
        (DAYS[i], i, t, c - 0.25, c + 0.5, c - 0.5, float(c), 1000.0, c * 1000.0, c * 100000.0) for t,
        cs in CLOSE.items() for i,
        c in enumerate(cs)
    ]
    return spark.createDataFrame(
        rows,
        "date date, pos int, ticker string, open double, high double, low double, close double, volume double, turnover double, mkt_cap double"
    )


def series(spark, values, key="k"):
    rows = [(key, dt.date(2024, 1, 1) + dt.timedelta(days=i), i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ticker string, date date, pos int, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_equity_curve(spark):
    got = column(series(spark, [0.10, None, -0.05]).withColumn("eq", win.equity("x")), "eq")
    assert got == pytest.approx([1.10, 1.10, 1.045])


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 2.0, 5.0, None)], "date int, x double")
    assert sorted(r.k for r in df.withColumn("k", cs_rank("x")).collect() if r.x is not None) == [0.25, 0.625, 0.625, 1.0]
    assert column(series(spark, [3, 1, 2, 2]).withColumn("k", ts_rank("x", 3)), "k")[2:] == pytest.approx([2 / 3, 2.5 / 3])


def test_division_is_null_safe(spark):
    row = spark.createDataFrame([(1.0, 0.0)], "a double, b double").select(div("a", "b").alias("r")).first()
    assert row.r is None


def test_ewm_gaps(spark):
    got = column(ewm(series(spark, [None, 1, None, 3]), "x", "e", alpha=0.5), "e")
    assert got[1:] == pytest.approx([1, 1, 2.3333333])


def test_rsi_matches_a_loop(spark):
    x = np.random.default_rng(0).normal(0, 1, 60).cumsum() + 50
    got = column(compute(series(spark, x).withColumnRenamed("x", "close"), "rsi", lookback=5), "value")
    gain = loss = None
    for i in range(1, 60):
        d = x[i] - x[i - 1]
        g, l = max(d, 0), max(-d, 0)
        gain, loss = (g, l) if gain is None else (gain * 0.8 + g * 0.2, loss * 0.8 + l * 0.2)
        if i >= 5:
            assert got[i] == pytest.approx(100 - 100 / (1 + gain / loss))


def test_registry_errors(bars):
    assert len(list_signals()) == 37 and list_signals() == sorted(list_signals())
    with pytest.raises(KeyError):
        compute(bars, "none")
    with pytest.raises(TypeError):
        compute(bars, "mom_ret", window=3)
    with pytest.raises(ValueError):
        compute(bars.drop("close"), "mom_ret")
    with pytest.raises(ValueError):
        register_signal("mom_ret", "again", ())


def test_eligible_buckets(spark, bars):
    score = spark.createDataFrame([("A", 4.0), ("B", 3.0), ("C", 2.0), ("D", 1.0)], "ticker string, s double")
    got = xs.buckets(bars.join(score, "ticker"), "s", 2, eligible=F.col("ticker") != "A").where("pos = 0").collect()
    labels = {r.ticker: r.bucket for r in got}
    assert labels["A"] is None and labels["B"] in (1, 2) and labels == {"A": None, "D": 1, "C": 2, "B": 2}


def test_wide_round_trip(bars):
    wide = io.to_wide(bars, "close", list(CLOSE)).join(io.to_wide(bars, "turnover", list(CLOSE)), "date")
    back = {(r.date, r.ticker): (r.close, r.turnover) for r in io.to_long(wide).collect()}
    assert back == {(r.date, r.ticker): (r.close, r.turnover) for r in bars.collect()}
    with pytest.raises(ValueError):
        io.to_long(wide.withColumnRenamed("close__A", "closeA"))


def test_incomplete_masks_are_an_error(bars):
    with pytest.raises(ValueError, match="exec_masks missing keys"):
        un.next_close_masks(bars.withColumn("tradeable", F.lit(True)))


def test_limit_masks(spark):
    rows = [(dt.date(2024, 1, d), "A", 10.0, 10.0, 10.0, 10.0, 10.0) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "date date, ticker string, open double, close double, volume double, high_limit double, low_limit double")
    assert column(un.execution_masks(df, 0.0, "block"), "limit_up_locked")[0] is True


def test_membership_next_day(spark):
    grid = spark.createDataFrame([(dt.date(2024, 1, d), "000001.XSHE") for d in (2, 3, 4)], "date date, ticker string")
    events = spark.createDataFrame([("000001.XSHE", dt.date(2024, 1, 2), 1)], "ticker string, d date, delta int")
    cal = grid.select("date").distinct()
    on = jn.next_trading_date(events, cal, "d", True).select("ticker", F.col("trade_date").alias("date"), "delta")
    assert column(jn.replay_delta(grid, on), "member") == [False, True, True]


def test_filing_titles(spark):
    titles = [
        "Annual Report 2024",
        "Interim Results for the six months ended 30 June 2024",
        "Notice of Annual General Meeting",
        "Annual Report 2024/06/30"
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string").select(
        "i",
        fl.doc_type(F.col("t")).alias("d"),
        fl.period_end(F.col("t")).alias("p")
    )
    rows = {r.i: (r.d, r.p) for r in df.collect()}
    assert rows[0][0] == "annual_report" and rows[1] == (
        "interim_results",
        dt.date(2024, 6, 30)
    ) and rows[2][0] is None and rows[3][1] == dt.date(2024, 6, 30)
    texts = spark.createDataFrame([("HK$ million", "Equity attributable to owners of the Company (1,234.5)")], "u string, l string")
    r = texts.select(
        fl.currency(F.col("u")).alias("c"),
        fl.unit_scale(F.col("u")).alias("s"),
        fl.line_item(F.col("l")).alias("i"),
        fl.last_number(F.col("l")).alias("n"),
        fl.hk_ticker(F.lit("16")).alias("t")
    ).first()
    assert tuple(r) == ("HKD", "millions", "equity_attributable_to_owners", -1234.5, "0016.HK")


def test_next_close_and_book_value(spark):
    prices = spark.createDataFrame(
        [("0016.HK", dt.date(2024, 6, 28), 80.0), ("0016.HK", dt.date(2024, 7, 1), 81.0), ("0016.HK", dt.date(2024, 7, 2), 82.0)],
        "ticker string, date date, close double"
    )
    filing = spark.createDataFrame([("0016.HK", dt.date(2024, 6, 30))], "ticker string, publish date")
    r = jn.asof(filing, prices, ["ticker"], "publish", "date", ["close"], "forward", False).first()
    assert (r.matched, r.close) == (dt.date(2024, 7, 1), 81.0)
    nav = spark.createDataFrame(
        [(1000.0, 100.0, 50.0, 150.0, 100.0, None, 12.0)],
        "equity double, cash double, borrowings_current double, borrowings_noncurrent double, shares double, weighted_shares double, price double"
    )
    r = fl.book_nav(nav).first()
    assert (r.nav_per_share, r.net_debt) == (10.0, 100.0) and r.discount == pytest.approx(0.2)


def test_lagged_weights_and_late_fee(spark):
    rows = [(dt.date(2024, 1, 1 + i), "A", w, r) for i, (w, r) in enumerate([(0.0, 0.1), (1.0, 0.2), (1.0, 0.3), (0.0, 0.1)])]
    got = pf.backtest(spark.createDataFrame(rows, "date date, ticker string, w double, ret double"), 0.01)
    assert column(got, "gross") == pytest.approx(
        [0, 0, 0.3, 0.1]
    ) and column(got, "turnover") == [0, 1, 0, 1] and column(got, "cost") == pytest.approx([0, 0, 0.01, 0])


def test_capped_weights(spark):
    df = spark.createDataFrame([(1, "L", 0.6, 1.0), (1, "L", 0.3, 1.0), (1, "L", 0.1, 1.0)], "date int, leg string, w double, budget double")
    assert sorted(r.w for r in pf.capped(df, "w", 0.4, ["date", "leg"], "budget").collect()) == pytest.approx([0.15, 0.4, 0.45])


def test_stateful_rules_match_loops(spark):
    x = [0, 1, 0, 0, 1, 1, 1, 1, 0, 0, 0]
    df = series(spark, x).withColumn("s", F.col("x").cast("int"))
    assert column(rg.minimum_duration(df, "s", 3), "steady") == [0, 0, 0, 0, 1, 1, 1, 1, 0, 0, 0]
    hits = series(spark, [1, 1, 0, 1, 1]).withColumn("h", F.col("x") > 0)
    assert column(rg.spaced_events(hits, "h", 3, ["ticker"]), "chosen") == [True, False, False, True, False]
    stop = series(spark, [10, 12, 9, 9, 9, 9]).withColumn("w", F.lit(1.0))
    stopped = rg.trailing_stop(stop, "w", "x", 0.2, 2, ["ticker"])
    assert column(stopped, "held") == [1, 1, 0, 0, 0, 1] and column(stopped, "exit_flag") == [False, False, True, False, False, False]
    assert column(stopped, "peak") == [10, 12, 12, None, None, 9] and column(stopped, "dd")[:3] == pytest.approx([0, 0, -0.25])
    assert column(rg.trailing_stop(stop, "w", "x", 0.2, 0, ["ticker"]), "held") == [1, 1, 0, 1, 1, 1]
    assert column(rg.kill_switch(series(spark, [0, -0.2, -0.2, 0, 0]), "x", 0.1, 2, "ticker"), "live") == [True, True, False, False, True]
    assert column(
        rg.kill_switch(series(spark, [0, -0.2, -0.2, -0.2, 0, 0, 0]), "x", 0.1, 2, "ticker"),
        "live"
    ) == [True, True, False, False, False, False, True]


def test_episodes_and_merging(spark):
    df = series(spark, [1, 1, 0, 1, 0, 0, 0, 1, 1, 1]).withColumn("f", F.col("x") > 0)
    found = rg.episodes(df, "f", 1)
    assert sorted((r["first"], r["last"], r.n) for r in found.collect()) == [(0, 1, 2), (3, 3, 1), (7, 9, 3)]
    assert sorted((r["first"], r["last"]) for r in rg.merge_episodes(found, 1).collect()) == [(0, 3), (7, 9)]


def test_ols_forecasts_match_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=50), rng.normal(size=50)
    y = 1 + 2 * a - b + rng.normal(0, 0.1, 50)
    rows = [("k", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(a[i]), float(b[i]), float(y[i])) for i in range(50)]
    got = column(
        inf.expanding_ols(spark.createDataFrame(rows, "ticker string, date date, a double, b double, y double"), "y", ["a", "b"], 20, ["ticker"]),
        "forecast"
    )
    x = np.column_stack([np.ones(50), a, b])
    for i in (20, 35, 49):
        assert got[i] == pytest.approx(x[i] @ np.linalg.lstsq(x[:i], y[:i], rcond=None)[0])


def test_logistic_fit_separates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 0.3, 400) > 0).astype(float)
    c = inf.logistic_fit(x, y)
    assert c[1] > 1 and c[2] < -1 and abs(c[0]) < 0.6


def test_fisher_and_auc(spark):
    r = spark.createDataFrame([(3, 1, 1, 3)], "a int, b int, c int, d int").select(m.fisher_greater(*map(F.col, "abcd")).alias("p")).first()
    assert r.p == pytest.approx(17 / 70)
    df = spark.createDataFrame([("k", p, y) for p, y in ((0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0))], "k string, p double, y int")
    assert m.auc(df, "p", "y", "k").first().auc == pytest.approx(0.75)


def test_no_look_ahead(bars):
    whole = {(r.date, r.ticker): r.value for r in compute(bars, "mom_ret", lookback=2).collect()}
    early = {(r.date, r.ticker): r.value for r in compute(bars.where("pos < 4"), "mom_ret", lookback=2).collect()}
    assert all(whole[k] == v for k, v in early.items())


def test_registry_of_datasets(spark, tmp_path):
    reg = io.DatasetRegistry(spark, f"file://{tmp_path}/registry")
    reg.write([{"dataset_name": "demo_panel", "path": "processed/demo/panel.parquet", "parameters": {"a": "1"}}])
    assert reg.resolve("demo_panel", "/root/x") == "/root/x/processed/demo/panel.parquet"
    with pytest.raises(KeyError):
        reg.resolve("other", "/")
    with pytest.raises(ValueError):
        io.load_any(spark, "x.xlsx")


def test_clean_bars_keeps_gaps_if_told(spark):
    rows = [(dt.date(2024, 1, d), "AAA", v) for d, v in ((1, 1.0), (2, None), (3, float("inf")))]
    df = spark.createDataFrame(rows, "date date, ticker string, close double")
    assert column(io.clean_bars(df, fill=False, drop_empty=False), "close") == [1.0, None, None]
    assert pd.Series(column(io.clean_bars(df), "close")).tolist() == [1.0]
