"""Walk-forward fits, resampling tests and order statistics against plain numpy."""

import datetime as dt
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketweave.functions import series as sr
from marketweave.operators import alerts as al
from marketweave.operators import cross_section as xs
from marketweave.operators import inference as inf
from marketweave.operators import joins as jn
from marketweave.operators import metrics as m
from marketweave.operators import portfolio as pf

DAY = dt.date(2024, 1, 1)


def days(i):
    return DAY + dt.timedelta(days=int(i))


@pytest.fixture(scope="module")
def panel(spark):
    """Three tickers, 90 rows, nulls and ties."""
    rng = np.random.default_rng(5)
    rows = []
    for t in "abc":
        for i in range(90):
            x, z = rng.normal(), float(rng.integers(0, 4))
            rows.append((t, days(i), i, float(x), z, float(x + rng.normal() > 0), float(rng.normal() + 0.3 * x) if i % 11 else None))
    return spark.createDataFrame(rows, "ticker string, date date, pos int, x double, z double, up double, r double")


def test_folds_fit_like_one_fit_each(spark, panel):
    folds = inf.make_folds(panel.select("date", "pos").distinct(), 40, 15, 2)
    got = {(r.fold, r.date, r.ticker): r.p for r in inf.walk_forward_logistic(panel, "up", ["x", "z"], folds, 2.0).collect()}
    rows = panel.toPandas()
    seen = 0
    for f in folds.collect():
        a, b = rows[rows.pos.between(f.train_start, f.train_end)], rows[rows.pos.between(f.test_start, f.test_end)]
        mean, std = a[["x", "z"]].mean(), a[["x", "z"]].std(ddof=0)
        coef = inf.logistic_fit(((a[["x", "z"]] - mean) / std).to_numpy(), a.up.to_numpy(), 2.0)
        score = 1 / (1 + np.exp(-(coef[0] + ((b[["x", "z"]] - mean) / std).to_numpy() @ coef[1:])))
        for date, ticker, p in zip(b.date, b.ticker, score, strict=True):
            assert got[f.fold, date, ticker] == pytest.approx(p, abs=1e-7)
            seen += 1
    assert seen == len(got) > 50


def test_folds_with_one_label_are_left_out(spark, panel):
    folds = inf.make_folds(panel.select("date", "pos").distinct(), 40, 15, 2)
    assert inf.walk_forward_logistic(panel.withColumn("up", F.lit(1.0)), "up", ["x"], folds).count() == 0
    assert inf.walk_forward_logistic(panel.where("false"), "up", ["x"], folds).count() == 0


def test_shift_test_equals_rolling_the_mask(spark, panel):
    got = {r.ticker: r for r in inf.shift_test(panel.withColumn("on", F.col("x") > 0.5), "on", "r", 300, "ticker").collect()}
    for t, part in panel.where("r is not null").orderBy("date").toPandas().groupby("ticker"):
        on, x = (part.x > 0.5).to_numpy(), part.r.to_numpy()
        offsets = inf._seed(0, t).integers(1, len(x), 300)
        means = np.array([x[np.roll(on, s)].mean() for s in offsets])
        assert got[t].observed == pytest.approx(x[on].mean()) and got[t].p == pytest.approx((1 + (means >= x[on].mean() - 1e-12).sum()) / 301)


def test_draw_test_tends_to_the_exact_chance(spark, panel):
    got = {
        r.ticker: r for r in inf.draw_test(
            panel.withColumn("on", F.col("z") == 2).withColumn("y", F.col("up") == 1),
            "on",
            "y",
            20_000,
            "ticker"
        ).collect()
    }
    for t, part in panel.toPandas().groupby("ticker"):
        on, y = part.z == 2, part.up == 1
        n, k, d, hits = len(part), int(y.sum()), int(on.sum()), int((on & y).sum())
        exact = sum(comb(k, i) * comb(n - k, d - i) for i in range(hits, min(k, d) + 1)) / comb(n, d)
        assert got[t].hits == hits and got[t].p == pytest.approx(exact, abs=0.02)


def test_principal_components_equal_numpy(spark, panel):
    wide = panel.select("date", "x", "z", "up")
    got = inf.principal_components(wide, ["x", "z", "up"], 2).collect()
    values, vectors = np.linalg.eigh(np.cov(wide.toPandas()[["x", "z", "up"]].to_numpy().T))
    for r in got:
        v = vectors[:, ::-1][:, r.component - 1]
        v = v * (1 if v[np.argmax(np.abs(v))] > 0 else -1)
        assert r.loading == pytest.approx(v[["x", "z", "up"].index(r.name)]) and r.share == pytest.approx(
            values[::-1][r.component - 1] / values.sum()
        )


@pytest.mark.parametrize(
    "values",
    [
        [1.0],
        [3.0, 3.0, 3.0],
        np.random.default_rng(1).integers(0, 40, 500).astype(float).tolist(),
        np.random.default_rng(2).normal(size=3001).tolist()
    ]
)
def test_pooled_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([("k", v) for v in values] + [("k", None), (None, 7.0), (None, 9.0)], "k string, v double")
    got = {r.k: r for r in sr.pooled_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).collect()}
    assert [got["k"].a, got["k"].b, got["k"].c] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.99])))
    assert got[None].b == 8.0
    order = {r.v: (r.n, r.less) for r in sr.pooled_order(df.where("k = 'k'"), ["k"], "v").collect()}
    assert all(order[v] == (values.count(v), sum(x < v for x in values)) for v in set(values[:200]))


def test_feature_signs_are_those_of_rank_correlation(spark):
    rng = np.random.default_rng(3)
    rows = []
    for f, sign in (("up", 1), ("down", -1)):
        for _ in range(400):
            x = float(rng.integers(0, 30))
            rows.append((f, x, float(sign * x + rng.normal(0, 4))))
    got = xs.flip_signs(spark.createDataFrame(rows, "feature string, value double, target double"), "target").collect()
    assert {r.feature: r.sign for r in got} == {"up": 1, "down": -1}


def test_next_trading_date_over_gaps(spark):
    cal = spark.createDataFrame([(days(i),) for i in (2, 3, 6, 9)], "date date")
    at = [
        dt.datetime(2023, 12, 1),
        dt.datetime(2024, 1, 3),
        dt.datetime(2024, 1, 3, 12),
        dt.datetime(2024, 1, 5),
        dt.datetime(2024, 1, 10),
        dt.datetime(2024, 1, 11),
        None
    ]
    events = spark.createDataFrame(list(enumerate(at)), "i int, at timestamp").withColumn("date", F.lit(1))
    for strict in (False, True):
        got = {r.i: r.trade_date for r in jn.next_trading_date(events, cal, "at", strict).collect()}
        for i, t in enumerate(at):
            later = [
                d for d in (days(k) for k in (2, 3, 6, 9)) if t and (
                    (dt.datetime(d.year, d.month, d.day) > t) if strict else (dt.datetime(d.year, d.month, d.day) >= t)
                )
            ]
            assert got[i] == (min(later) if later else None), (i, strict)
    plan = jn.next_trading_date(events, cal, "at", True)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_fisher_equals_the_sum_of_its_terms(spark):
    tables = [(3, 1, 1, 3), (0, 5, 5, 0), (40, 60, 30, 870), (500, 500, 500, 500), (0, 0, 0, 0), (2000, 1000, 900, 3000)]
    got = spark.createDataFrame(tables, "a int, b int, c int, d int").select("a", "b", m.fisher_greater(*map(F.col, "abcd")).alias("p")).collect()
    for (a, b, c, d), r in zip(tables, got, strict=True):
        n = a + b + c + d
        exact = sum(comb(a + b, k) * comb(c + d, a + c - k) for k in range(a, min(a + b, a + c) + 1)) / comb(n, a + c)
        assert r.p == pytest.approx(min(exact, 1.0), rel=1e-6)


def test_alert_scores(spark):
    on = [0, 3, 20, 21, 40, 80]
    rows = spark.createDataFrame([("k", days(i), i in on) for i in range(100)] + [("none", days(0), False)], "ticker string, date date, hit boolean")
    labels = spark.createDataFrame([("k", days(5)), ("k", days(25)), ("k", days(60))], "ticker string, date date")
    got = {r.ticker: r for r in al.score_alerts(rows, "hit", labels, 7, 7).collect()}
    k = got["k"]
    assert (
        k.n_alerts,
        k.n_events,
        k.tp,
        k.fn,
        k.fp
    ) == (4, 3, 2, 1, 2) and k.precision == 0.5 and k.recall == pytest.approx(2 / 3) and k.mean_delay == -5
    assert got["none"].n_alerts == 0 and got["none"].recall is None


def test_trend_episodes_need_a_start_flag(spark):
    px = [5, 6, 7, 8, 9, 4, 3, 9, 9, 9, 3, 2, 1, 1, 1]
    rows = [("k", days(i), float(p), i in (2, 3, 8)) for i, p in enumerate(px)]
    df = spark.createDataFrame(rows, "ticker string, date date, px double, up boolean")
    got = [(r.start, r.end, r.n) for r in al.trend_episodes(df, "up", "px", 3, 2, 1).orderBy("start").collect()]
    assert got == [(days(2), days(5), 3), (days(8), days(10), 2)]
    assert [r.start for r in al.trend_episodes(df, "up", "px", 3, 2, 3).collect()] == [days(2)]


def test_book_volatility_over_spans(spark):
    rng = np.random.default_rng(4)
    r = rng.normal(size=(30, 3))
    weights = np.array([[0.5, 0.5, 0.0]] * 8 + [[0.0, 0.0, 0.0]] * 3 + [[0.2, -0.3, 0.4]] * 9 + [[0.5, 0.5, 0.0]] * 10)
    rows = [(days(i), i, t, float(weights[i, k]), float(r[i, k])) for i in range(30) for k, t in enumerate("abc")]
    got = {x.date: x for x in pf.book_vol(spark.createDataFrame(rows, "date date, pos int, ticker string, w double, ret double"), 5, 12).collect()}
    want = [i for i in range(4, 30) if weights[i].any()]
    assert set(got) == {days(i) for i in want}
    for i in want:
        part = r[i - 4 : i + 1]
        assert got[days(i)].full == pytest.approx((part @ weights[i]).std() * 12**0.5)
        assert got[days(i)].diagonal == pytest.approx(np.sqrt((weights[i] ** 2 * part.var(axis=0)).sum()) * 12**0.5)
