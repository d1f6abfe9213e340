"""Loaders, curated filings, overlays, gates, rankers and the tilt study on small fixtures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketweave.operators import curation as cu
from marketweave.operators import inference as inf
from marketweave.operators import overlays as ov
from marketweave.operators import ranking as rk
from marketweave.operators import universe as un
from marketweave.sources import filing_sources as fs
from marketweave.sources import io

DAY = dt.date(2024, 1, 1)
FACTS = (
    "filing_id long, kind string, label string, code string, value double, page_no int, line_no int, confidence double, currency string, unit_scale "
    "string"
)


def days(i):
    return DAY + dt.timedelta(days=int(i))


def facts(spark, rows):
    return spark.createDataFrame([(f, k, label, c, v, 1, i, 0.2, None, None) for i, (f, k, label, c, v) in enumerate(rows)], FACTS)


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame(
        [(1, "00016", DAY, DAY), (2, "00012", DAY, days(60))],
        "filing_id long, stock_code string, period_end date, publish date"
    )


def test_first_numeric_goes_by_pattern_then_row(spark, index):
    rows = [
        (1, "table", "Issued shares 500", None, None),
        (1, "table", "shares in ISSUE none", None, None),
        (1, "table", "Shares in issue 1,200 and 7", None, None),
        (1, "table", "weighted average 3", None, 9.5),
        (3, "table", "issued shares 1", None, None)
    ]
    got = {r.filing_id: r for r in cu.capital_structure(index, facts(spark, rows)).collect()}
    assert (got[1].shares_outstanding_period_end, got[1].weighted_avg_shares_basic) == (7.0, 9.5)
    assert got[2].shares_outstanding_period_end is None and set(got) == {1, 2}


def test_curated_tables(spark, index):
    rows = [
        (1, "table", "Bank borrowings 5", "total_borrowings_current", 5.0),
        (3, "table", "other BORROWINGS", None, None),
        (2, "note", "a note", None, None),
        (1, "table", "x", "investment_properties_y", 2.0)
    ]
    f = facts(spark, rows)
    items = {r.fact_id: r for r in cu.statement_line_items(index, f).collect()}
    assert set(items) == {"fact_1_1", "fact_1_2", "fact_3_1"} and items["fact_3_1"].stock_code is None
    assert [(r.filing_id, r.amount) for r in cu.debt_schedule(index, f).collect()] == [(1, 5.0)]
    assert sorted((r.filing_id, r.value_num) for r in cu.property_notes(index, f).collect()) == [(1, 2.0), (2, None)]
    with pytest.raises(ValueError):
        cu.curate(index.where("false"), spark.createDataFrame([], "filing_id long, page_no int, text string"))


def test_overrides_need_their_columns(spark, index):
    f = facts(spark, [(1, "table", "Total equity 5", "total_equity", 5.0)])
    sheet = cu.core_review_sheet(cu.statement_line_items(index, f))
    assert sheet.first().target_key_json == '{"filing_id":1,"line_item_code":"total_equity"}'
    filled = sheet.withColumn("override_value_num", F.lit(8.0)).withColumn("status", F.lit("maybe"))
    assert cu.import_overrides(filled).first().status == "pending" and cu.import_overrides(filled.drop("field_name")).count() == 0
    items = cu.statement_line_items(index, f)
    assert cu.apply_overrides(items, cu.import_overrides(filled)).first().value == 5.0
    assert cu.apply_overrides(items, cu.import_overrides(filled.withColumn("status", F.lit("approved")))).first().value == 8.0


def test_property_lines_take_the_first_of_a_page(spark):
    pages = spark.createDataFrame(
        [(1, 1, "x\n  Investment PROPERTIES a\ninvestment property b"), (1, 2, "none"), (2, 1, None), (2, 2, "")],
        "filing_id long, page_no int, text string"
    )
    assert [(r.filing_id, r.page_no, r.label, r.value) for r in cu.property_lines(pages).collect()] == [(1, 1, "Investment PROPERTIES a", None)]


def test_share_tables(spark, tmp_path):
    rows = spark.createDataFrame([("A", 10.0)], "Ticker string, estimated_shares double")
    for name in ("s.csv", "s.parquet"):
        path = f"file://{tmp_path}/{name}"
        fs.save_shares(rows.withColumnRenamed("Ticker", "ticker"), path, "2024-01-31")
        assert [tuple(r) for r in fs.load_shares(spark, path).collect()] == [("A", 10.0)]
    rows.write.parquet(f"file://{tmp_path}/t.parquet")
    assert fs.load_shares(spark, f"file://{tmp_path}/t.parquet").columns == ["ticker", "estimated_shares"]
    with pytest.raises(ValueError):
        fs.save_shares(rows.withColumnRenamed("Ticker", "ticker"), f"file://{tmp_path}/s.xls")
    rows.drop("Ticker").write.parquet(f"file://{tmp_path}/u.parquet")
    with pytest.raises(ValueError):
        fs.load_shares(spark, f"file://{tmp_path}/u.parquet")


def test_manifest_keys_are_required(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"manual_inputs": [{"name": "a.csv", "owner": "x"}]}')
    with pytest.raises(ValueError, match="a.csv lacks"):
        fs.check_manifest(spark, f"file://{tmp_path}/m.json")


def test_price_window_metadata(spark, index):
    prices = spark.createDataFrame(
        [("0016.HK", days(i - 40), 80.0) for i in range(160)] + [("9.HK", DAY, 1.0)],
        "ticker string, date date, close double"
    )
    issuers = spark.createDataFrame([("00016", "0016.HK"), ("00099", "9.HK")], "stock_code string, ticker string")
    kept, said = fs.price_window(prices, index, issuers)
    assert {r.ticker for r in kept.collect()} == {"0016.HK"} and kept.agg(F.min("date"), F.max("date")).first()[:] == (days(-30), days(90))
    assert said.first().tickers == ["0016.HK"]


def test_limits_need_their_columns_and_single_rows(spark, tmp_path):
    grid = spark.createDataFrame([(DAY, "A"), (days(1), "A")], "date date, ticker string")
    rows = spark.createDataFrame(
        [("2024-01-01", " A ", 1.0, 1.0, 1.0, 2.0, 0.5)],
        "date string, code string, open double, close double, volume double, high_limit double, low_limit double"
    )
    rows.write.parquet(f"file://{tmp_path}/l")
    got = {r.date: r.high_limit for r in io.load_limits(spark, f"file://{tmp_path}/l", grid).collect()}
    assert got == {DAY: 2.0, days(1): None}
    rows.unionByName(rows).write.parquet(f"file://{tmp_path}/d")
    with pytest.raises(ValueError, match="duplicate"):
        io.load_limits(spark, f"file://{tmp_path}/d", grid)
    rows.drop("open").write.parquet(f"file://{tmp_path}/m")
    with pytest.raises(ValueError, match="open"):
        io.load_limits(spark, f"file://{tmp_path}/m", grid)


def test_registered_names_do_not_depend_on_the_working_folder(spark, tmp_path, monkeypatch):
    registry = io.DatasetRegistry(spark, f"file://{tmp_path}/registry")
    registry.write([{"dataset_name": "demo_panel", "path": "processed/demo.parquet", "source_system": "made"}])
    spark.range(3).write.parquet(f"file://{tmp_path}/processed/demo.parquet")
    monkeypatch.chdir("/tmp")
    assert io.load_panel(spark, "demo_panel", registry, f"file://{tmp_path}").count() == 3
    rows, entry = io.load_with_provenance(spark, f"file://{tmp_path}/processed/demo.parquet", registry)
    assert rows.count() == 3 and entry.first().source_system == "made"
    with pytest.raises(KeyError):
        io.load_panel(spark, "other", registry, "")


@pytest.fixture(scope="module")
def book(spark):
    rows = [(days(i), i, t, float(s), 1.0 / 3, float(10 + (i if t == "a" else -i))) for i in range(8) for t, s in (("a", 3), ("b", 2), ("c", 1))]
    return spark.createDataFrame(rows, "date date, pos int, ticker string, score double, w double, px double").withColumn("ret", F.lit(0.01))


def test_overlays_give_diagnostics(book):
    out, found = ov.apply_overlays(book, [ov.VolTarget(0.1, 2, 1.0), ov.TradeStop(0.2, 2)])
    assert set(found) == {"asset_vol_target", "trade_dd_stop"} and out.count() == book.count()
    assert {r.ticker for r in found["trade_dd_stop"]["exits"].where("exit_flag").collect()} == {"b", "c"}
    with pytest.raises(ValueError):
        ov.apply_overlays(book, [ov.TradeStop(0.2, 2), ov.TradeStop(0.3, 2)])
    assert ov.check_weights(book).count() == 0 and ov.check_weights(book.withColumn("w", F.col("w") * 2)).count() == 8


def test_books_with_filters(book):
    first = book.where("pos = 0")
    got = {(r.ticker, r.leg): r.w for r in ov.select_book(first, "score", 2, 1, lambda: F.col("ticker") != "a", None, 1.0, 0.4).collect()}
    assert got == {("b", "long"): 0.5, ("c", "long"): 0.5, ("c", "short"): -0.4}
    assert ov.select_book(first, "score", 2, 1, lambda: F.lit(False), None, 1.0, 0.4, both_sides=True).count() == 0


def test_gates_agree(spark, book):
    events = spark.createDataFrame([("b", days(2), 1)], "ticker string, date date, delta int")
    spans = spark.createDataFrame([("a", days(0), days(3)), ("b", days(0), days(9))], "ticker string, start date, end date")
    got = ov.gated(book, [ov.EventGate(events, ("a",)), ov.SpanGate(spans)]).where("member").collect()
    assert {(r.ticker, r.date) for r in got} == {("a", days(i)) for i in range(4)} | {("b", days(i)) for i in range(2, 8)}


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(6)
    rows = [
        (days(7 * i), i, f"t{k}", float(a), float(b), float(a - 0.5 * b + rng.normal(0, 0.3))) for i in range(60) for k in range(12) for a,
        b in [rng.normal(size=2)]
    ]
    return spark.createDataFrame(rows, "date date, pos int, ticker string, a double, b double, fwd double")


def test_linear_ranker_equals_least_squares(long):
    cfg = rk.RankConfig(features=("a", "b"), grades=None, preprocess=False, align_signs=False)
    folds = inf.make_folds(long.select("date", "pos").distinct(), 30, 20, 2)
    got = {(r.fold, r.date, r.ticker): r.score for r in rk.walk_forward_scores(long, folds, cfg).collect()}
    rows = long.toPandas()
    for f in folds.collect():
        a, b = rows[rows.pos.between(f.train_start, f.train_end)], rows[rows.pos.between(f.test_start, f.test_end)]
        coef = np.linalg.lstsq(np.column_stack([np.ones(len(a)), a[["a", "b"]]]), a.fwd, rcond=None)[0]
        for d, t, s in zip(b.date, b.ticker, coef[0] + b[["a", "b"]].to_numpy() @ coef[1:], strict=True):
            assert got[f.fold, d, t] == pytest.approx(s, abs=1e-6)
    assert len(got) > 100


def test_ranking_workflow(long):
    folds = inf.make_folds(long.select("date", "pos").distinct(), 30, 20, 2)
    for model, parameters in (("linear", {}), ("gbt", {"maxIter": 5})):
        cfg = rk.RankConfig(features=("a", "b"), model=model, parameters=parameters, least=5)
        scores = rk.walk_forward_scores(long, folds, cfg)
        assert all(r["mean"] > 0.5 and r.top_mean > 0 for r in rk.rank_metrics(scores, 3).collect())
    assert rk.wide_scores(scores, ["t0", "t1"]).columns == ["date", "t0", "t1"]
    turned = rk.prepare(long, rk.RankConfig(features=("a", "b"), least=5)).agg(F.corr("b", "target")).first()[0]
    assert turned > 0  # b points the other way
    with pytest.raises(KeyError):
        rk.walk_forward_scores(long, folds, rk.RankConfig(features=("a",), model="none"))
    with pytest.raises(ValueError):
        rk.register_ranker("linear")(lambda rows, parameters: None)
    with pytest.raises(ValueError):
        rk.walk_forward_scores(long.where("false"), folds, rk.RankConfig(features=("a", "b")))


def test_tilt_study_equals_a_loop(spark):
    rng = np.random.default_rng(9)
    x, r = rng.normal(size=120), []
    for i in range(120):
        r.append(0.02 * (x[i - 1] if i else 0) + rng.normal(0, 0.01))
    lag = np.append(np.nan, x[:-1])
    rows = [("k", days(i), None if i == 0 else float(lag[i]), float(r[i])) for i in range(120)]
    got = ov.tilt_study(
        spark.createDataFrame(rows, "ticker string, date date, l double, r double"),
        "r",
        ["l"],
        30,
        2,
        0.0,
        0.2,
        12,
        2.0,
        12,
        0.001
    ).orderBy("date").collect()
    pred = []
    for i in range(120):
        a, b = np.column_stack([np.ones(i), lag[:i]])[1:], np.array(r[1:i])
        pred.append(np.array([1, lag[i]]) @ np.linalg.lstsq(a, b, rcond=None)[0] if i - 1 >= 30 else np.nan)
    known = [i for i in range(120) if pred[i] == pred[i]]
    assert [g.pred for g in got] == pytest.approx([pred[i] for i in known])
    sign, pos, before, held = 0, [], None, 0.0
    for n, i in enumerate(known):
        s = np.sign(pred[i])
        if n and s == np.sign(pred[known[n - 1]]) and s != 0:
            sign = s
        vol = np.std([r[j] for j in known[n - 11 : n + 1]], ddof=1) * 12**0.5 if n >= 11 else None
        pos.append(sign * (before if before is not None else 0.0))
        before = None if vol is None else min(0.2 / vol, 2.0)
    pnl = []
    for n, i in enumerate(known):
        last = pos[n - 1] if n else 0.0
        pnl.append(last * r[i] - 0.001 * abs(pos[n] - last))
    assert [g.position for g in got] == pytest.approx(pos) and [g.pnl for g in got] == pytest.approx(pnl)
    found = ov.tilt_metrics(
        spark.createDataFrame([tuple(g) for g in got], "ticker string, date date, r double, pred double, position double, pnl double"),
        12
    ).first()
    assert found.sharpe == pytest.approx(np.mean(pnl) / np.std(pnl, ddof=1) * 12**0.5) and found.hit_rate == pytest.approx(
        np.mean([np.sign(pred[i]) == np.sign(r[i]) for i in known])
    )


def test_universe_defaults():
    cfg = un.UniverseConfig()
    assert (cfg.price_window, cfg.mcap_window, cfg.turnover_window, cfg.min_age) == (21, 21, 20, 63)
