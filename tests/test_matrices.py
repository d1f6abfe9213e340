"""Correlations by blocks, principal components from sketches and expanding fits against numpy."""

import datetime

import numpy as np
import pytest

from marketweave.operators import blocks, inference, metrics

DAY = datetime.date(2022, 1, 3)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(12)
    factors = rng.normal(size=(90, 3)) * (3, 2, 1.5)
    x = factors @ rng.normal(size=(3, 40)) + rng.normal(size=(90, 40)) * 0.5 + 1000
    x[:, 7] = 5.0
    rows = [(DAY + datetime.timedelta(days=i), f"n{j:02d}", float(x[i, j])) for i in range(90) for j in range(40)]
    return spark.createDataFrame(rows, "date date, name string, x double"), x


@pytest.mark.parametrize(("names", "dates"), [(1024, 1024), (7, 20)])
def test_pairs_equal_numpy(spark, panel, names, dates):
    table, x = panel
    rng = np.random.default_rng(1)
    hole = rng.random(x.shape) < 0.5
    hole[:, 3] = np.arange(90) > 4  # few values
    holes = spark.createDataFrame([(DAY + datetime.timedelta(days=int(i)), f"n{j:02d}") for i, j in zip(*np.nonzero(hole), strict=True)], "date date, name string")
    got = metrics.pairwise_corr(table.join(holes, ["date", "name"], "left_anti"), "name", "x", "date", 10, names=names, dates=dates).collect()
    found = {(r.a, r.b): (r.corr, r.n) for r in got}
    assert len(found) == len(got)
    for i in range(40):
        for j in range(i + 1, 40):
            both = ~hole[:, i] & ~hole[:, j]
            pair = f"n{i:02d}", f"n{j:02d}"
            if not both.any():
                assert pair not in found
                continue
            corr, n = found[pair]
            assert n == both.sum()
            if n < 10 or 7 in (i, j):
                assert corr is None
            else:
                assert corr == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)


def test_top_pairs_are_those_of_all_pairs(monkeypatch, panel):
    table, _ = panel
    every = metrics.pairwise_corr(table, "name", "x", "date", 10).collect()
    want = sorted((r for r in every if r.corr is not None), key=lambda r: (-abs(r.corr), r.a, r.b))[:12]
    pairs = metrics.pairwise_corr
    monkeypatch.setattr(metrics, "pairwise_corr", lambda *a: pairs(*a, names=6, dates=11))
    got = metrics.top_pairs(table, "name", "x", "date", 10, 12).collect()
    assert [(r.a, r.b) for r in got] == [(r.a, r.b) for r in want]


@pytest.mark.parametrize("extra", [37, 8])
def test_components_equal_eigenvectors(spark, panel, extra):
    table, x = panel
    gap = spark.createDataFrame([(DAY + datetime.timedelta(days=300), "n00", 9.9)], table.schema)  # a date that lacks names
    got = inference.components_of(table.unionByName(gap), "date", "name", "x", 3, extra).collect()
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert len(got) == 120
    for r in got:
        v = vectors[:, -r.component]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        assert r.loading == pytest.approx(v[int(r.name[1:])], abs=1e-6)
        assert r.share == pytest.approx(values[-r.component] / values.sum(), abs=1e-9)


def test_components_of_nothing(spark, panel):
    table, _ = panel
    assert inference.components_of(table.limit(0), "date", "name", "x", 2).count() == 0


@pytest.mark.parametrize("rows", [blocks.ROWS, 23])
def test_expanding_fit_equals_loop(spark, rows):
    rng = np.random.default_rng(3)
    data = []
    for key, n in (("a", 150), ("b", 30)):
        x = rng.normal(size=(n, 2))
        y = 1 + x @ (2, -1) + rng.normal(size=n) * 0.1
        for i in range(n):
            data.append((key, i, None if rng.random() < 0.1 else float(x[i, 0]), float(x[i, 1]), None if rng.random() < 0.1 else float(y[i])))
    table = spark.createDataFrame(data, "ticker string, date int, u double, v double, y double")
    found = {(r.ticker, r.date): r.forecast for r in inference.expanding_ols(table, "y", ["u", "v"], 12, ["ticker"], rows=rows).collect()}
    for key, i, u, v, _ in data:
        past = [r for r in data if r[0] == key and r[1] < i and None not in r]
        if u is None or len(past) < 12:
            assert found[key, i] is None
        else:
            a = np.array([[1, r[2], r[3]] for r in past])
            beta = np.linalg.lstsq(a, np.array([r[4] for r in past]), rcond=None)[0]
            assert found[key, i] == pytest.approx(beta @ (1, u, v), abs=1e-8)
