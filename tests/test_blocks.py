"""Ordered rules over long keys cut into blocks: the same values as over whole keys, and as plain loops."""

import datetime

import numpy as np
import pandas as pd
import pytest

from marketweave.operators import alerts, blocks, regimes, signals, windows

DAY = datetime.date(2020, 1, 1)


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(9)
    rows = []
    for key, n in (("a", 300), ("b", 40), (None, 90), ("c", 1)):
        level = 100.0
        for i in range(n):
            level *= float(np.exp(rng.normal(0, 0.05)))
            x = None if rng.random() < 0.15 else float(rng.integers(0, 12))
            rows.append(
                (key, DAY + datetime.timedelta(days=int(i * 2 + rng.integers(0, 2))), x, level if rng.random() > 0.03 else None, int(rng.integers(0, 3) if rng.random() < 0.4 else 1),
                 bool(rng.random() < 0.5), float(-rng.random() * 0.3), float(rng.random() > 0.2), f"note {i}")
            )
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "ticker string, date date, x double, price double, state int, flag boolean, dd double, w double, note string")
    pandas = pd.DataFrame(rows, columns=table.columns)
    return table, {k: g.sort_values("date") for k, g in pandas.groupby("ticker", dropna=False)}


def values(df, name):
    return {(r.ticker, r.date): r[name] for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k] is None) == (b[k] is None or b[k] != b[k]) and (a[k] is None or abs(a[k] - b[k]) < 1e-9), (k, a[k], b[k])


def by_loop(groups, fn):
    return {(None if k != k or k is None else k, d): v for k, g in groups.items() for d, v in zip(g.date, fn(g), strict=True)}


@pytest.mark.parametrize("rows", [blocks.ROWS, 32])
def test_exponential_means(monkeypatch, made, rows):
    table, groups = made
    scan = blocks.scan
    monkeypatch.setattr(signals, "scan", lambda *a: scan(*a, rows=rows))
    for least, how in ((1, {"span": 10}), (7, {"halflife": 3.0})):
        want = by_loop(groups, lambda g, how=how, least=least: g.x.astype(float).ewm(**how, adjust=False, min_periods=least).mean())
        got = signals.ewm(table, "x", "e", least=least, **how)
        assert got.columns == [*table.columns, "e"]
        close(values(got, "e"), want)


@pytest.mark.parametrize("rows", [blocks.ROWS, 32])
def test_ranks(made, rows):
    table, groups = made

    def rolling(g):
        return [(g.x.iloc[i - 8 : i + 1].rank().iloc[-1] / 9 if i >= 8 and g.x.iloc[i - 8 : i + 1].notna().all() else None) for i in range(len(g))]

    def expanding(g):
        seen = [g.x.iloc[: i + 1].dropna() for i in range(len(g))]
        return [s.rank().iloc[-1] / len(s) if len(s) >= 5 and x == x else None for s, x in zip(seen, g.x.astype(float), strict=True)]

    close(values(windows.rolling_rank(table, "x", 9, "k", rows=rows), "k"), by_loop(groups, rolling))
    close(values(windows.expanding_rank(table, "x", 5, "k", rows=rows), "k"), by_loop(groups, expanding))


def test_rolling_rank_reaches_over_several_blocks(made):
    table, groups = made
    close(values(windows.rolling_rank(table, "price", 9, "k", rows=4), "k"), values(windows.rolling_rank(table, "price", 9, "k"), "k"))


@pytest.mark.parametrize("rows", [blocks.ROWS, 17])
def test_rules_equal_loops(made, rows):
    table, groups = made

    def steady(g):
        out, age = [], 0
        for s in g.state:
            if out and s != out[-1] and age < 5:
                s = out[-1]
            age = 1 if not out or s != out[-1] else age + 1
            out.append(s)
        return out

    def live(g):
        out, left = [], 0
        for d in g.dd:
            out.append(left == 0)
            left = max(left - 1, 0)
            if left == 0 and d <= -0.2:
                left = 6
        return out

    def chosen(gap):
        def run(g):
            out, last = [], None
            for hit, at in zip(g.flag, g.date, strict=True):
                hit = bool(hit) and (last is None or (at - last).days >= gap)
                last = at if hit else last
                out.append(hit)
            return out

        return run

    def held(g):
        out, inside, peak, until = [], False, float("nan"), -1
        for i, (w, px) in enumerate(zip(g.w, g.price.astype(float), strict=True)):
            wanted = w > 0
            if wanted and i <= until:
                w, wanted = 0.0, False
            if wanted and not inside:
                inside, peak = True, px
            elif not wanted:
                inside = False
            if inside:
                peak = px if px > peak else peak
                if px / peak - 1 <= -0.08:
                    w, inside, until = 0.0, False, i + 3
            out.append(w)
        return out

    close(values(regimes.minimum_duration(table, "state", 5, rows=rows), "steady"), by_loop(groups, steady))
    close(values(regimes.kill_switch(table, "dd", 0.2, 6, "ticker", rows=rows), "live"), by_loop(groups, live))
    close(values(regimes.spaced_events(table, "flag", 11, ["ticker"], rows=rows), "chosen"), by_loop(groups, chosen(11)))
    close(values(alerts.collapse_alerts(table, "flag", 11, ["ticker"], rows=rows), "kept"), by_loop(groups, chosen(12)))
    close(values(regimes.trailing_stop(table.drop("dd"), "w", "price", 0.08, 3, ["ticker"], rows=rows), "held"), by_loop(groups, held))


def test_long_keys_are_cut_evenly(made):
    table, _ = made
    cold, hot = blocks.in_blocks(table, ["ticker"], "date", 32)
    assert {r.ticker for r in cold.select("ticker").distinct().collect()} == {"c"}
    sizes = {(r.ticker, r._block): r["count"] for r in hot.groupBy("ticker", "_block").count().collect()}
    assert max(sizes.values()) == 32 and sum(sizes.values()) == 430 and len(sizes) == 10 + 2 + 3
