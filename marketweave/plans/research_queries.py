"""Registered regime, portfolio and inference queries over the research panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.series import change, div, full, ma, pooled_quantiles, ref, staged
from ..operators import cross_section as xs
from ..operators import inference as inf
from ..operators import metrics as m
from ..operators import portfolio as pf
from ..operators import regimes as rg
from ..operators.signals import compute, ewm
from ..operators.windows import rebalance_dates_of, rebalance_every, zscore
from ..sources.panel import panel
from . import sqlkit as q

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(key: str, build, digits: dict[str, int], sql: str | None, plain: tuple[str, ...] = ()) -> None:
    """Registers build(panel); sql is a list of common table expressions after the panel's that ends in final."""
    QUERIES[key] = lambda spark, sf_dir: build(panel(spark, sf_dir)).select(*plain, *[F.round(c, d).alias(c) for c, d in digits.items()])
    if sql is not None:
        ORACLE_SQL[key] = q.recursive(
            f"WITH {q.PANEL},\n{sql.strip()}\nSELECT {', '.join([*plain, *[f'round({c}, {d}) + 0.0 AS {c}' for c, d in digits.items()]])} FROM final"
        )


_DT = ("date", "ticker")
_LAST = lambda x: f"last_value({x} IGNORE NULLS) {q.w()}"

# Regimes
_HYS = f"hy AS (SELECT *, coalesce({_LAST('CASE WHEN score > 0.2 THEN 1 WHEN score < -0.2 THEN 0 END')}, 0) AS state FROM panel)"
_hys = lambda d: d.withColumn("state", rg.hysteresis("score", 0.2, -0.2))
_add("reg01_hysteresis", _hys, {}, f"{_HYS}, final AS (SELECT * FROM hy)", (*_DT, "state"))
_UP = lambda c, k: f"(min(CASE WHEN {c} THEN 1 ELSE 0 END) {q.w(k)} = 1 AND count(*) {q.w(k)} = {k})"
_CONF = (
    f"cf0 AS (SELECT *, CASE WHEN {_UP('score >= 0.1', 2)} THEN 1 WHEN {_UP('score <= -0.1', 2)} THEN 0 END AS tr "
    f"FROM panel), cf AS (SELECT *, coalesce({_LAST('tr')}, 0) AS state FROM cf0)"
)
_conf = lambda d: rg.confirmed_hysteresis(d, "score", 0.1, -0.1, 2)
_add("reg02_confirmed", _conf, {}, f"{_CONF}, final AS (SELECT * FROM cf)", (*_DT, "state"))
_add(
    "reg03_tri_state",
    lambda d: rg.tri_state(d, "score", 0.1, 2),
    {},
    f"t0 AS (SELECT *, CASE WHEN score > 0.1 THEN 1 WHEN score < -0.1 THEN -1 ELSE 0 END AS sg FROM panel), t1 AS (SELECT *, "
    f"CASE WHEN min(sg) {q.w(2)} = max(sg) {q.w(2)} AND count(*) {q.w(2)} = 2 AND sg <> 0 THEN sg END AS tr "
    f"FROM t0), final AS (SELECT date, ticker, coalesce({_LAST('tr')}, 0) AS position FROM t1)",
    (*_DT, "position")
)
_add(
    "reg04_quick_confirm",
    lambda d: rg.quick_confirm(d, "score", 0.2, -0.2),
    {},
    f"t0 AS (SELECT *, CASE WHEN row_number() OVER ({q.TS}) > 2 THEN CASE WHEN score > 0.2 THEN 1 WHEN score < -0.2 THEN 0 END END AS tr "
    f"FROM panel), final AS (SELECT date, ticker, coalesce({_LAST('tr')}, 0) AS state FROM t0)",
    (*_DT, "state")
)
_add(
    "reg05_quadrants",
    lambda d: d.where("score is not null and ret is not null").withColumn("quad", rg.quadrant(F.col("score") > 0, F.col("ret") > 0)),
    {},
    "final AS (SELECT date, ticker, 2 * CAST(score > 0 AS INTEGER) + CAST(ret > 0 AS INTEGER) AS quad FROM panel "
    "WHERE score IS NOT NULL AND ret IS NOT NULL)",
    (*_DT, "quad")
)
_EARLY = "n.state <> s.steady AND s.age < 4"
_add(
    "reg06_minimum_duration",
    lambda d: rg.minimum_duration(_hys(d).select("date", "ticker", "state"), "state", 4),
    {},
    f"{_HYS}, h0 AS (SELECT date, ticker, state FROM hy), "
    f"{q.walk('st', 'h0', {'steady': 'n.state', 'age': '1'}, {'steady': f'CASE WHEN {_EARLY} THEN s.steady ELSE n.state END', 'age': f'CASE WHEN {_EARLY} OR n.state = s.steady THEN s.age + 1 ELSE 1 END'})}, "
    f"final AS (SELECT * FROM st)",
    (*_DT, "steady")
)
_RUN = (
    "r0 AS (SELECT *, coalesce(score > 0.1, false) AS up FROM panel), r1 AS (SELECT *, CASE WHEN up IS DISTINCT "
    "FROM lag(up) OVER (PARTITION BY ticker ORDER BY date) THEN 1 ELSE 0 END AS c FROM r0), r2 AS (SELECT *, sum(c) OVER (PARTITION BY ticker "
    "ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM r1), ep AS (SELECT ticker, g, bool_and(up) AS up, min(date) AS start, max(date) AS \"end\", "
    "min(pos) AS first, max(pos) AS last, count(*) AS n FROM r2 GROUP BY ticker, g)"
)
_up = lambda d: d.withColumn("up", F.coalesce(F.col("score") > 0.1, F.lit(False)))
_add(
    "reg07_episodes",
    lambda d: rg.episodes(_up(d), "up", 3).withColumnRenamed("end", "stop"),
    {},
    f"{_RUN}, final AS (SELECT ticker, start, \"end\" AS stop, n FROM ep WHERE up AND n >= 3)",
    ("ticker", "start", "stop", "n")
)
_add(
    "reg08_spans",
    lambda d: rg.spans(_hys(d), "state").withColumnRenamed("end", "stop"),
    {},
    f"{_HYS}, h1 AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER ({q.TS}) THEN 1 ELSE 0 END AS c "
    f"FROM hy), h2 AS (SELECT *, sum(c) {q.w()} AS g FROM h1), final AS (SELECT ticker, min(state) AS state, min(date) AS start, max(date) AS stop, "
    f"count(*) AS n FROM h2 GROUP BY ticker, g)",
    ("ticker", "state", "start", "stop", "n")
)
_CYC = (
    f"{_CONF}, c1 AS (SELECT *, CASE WHEN (state = 1) IS DISTINCT FROM (lag(state) OVER ({q.TS}) = 1) THEN 1 ELSE 0 END AS c "
    f"FROM cf), c2 AS (SELECT *, sum(c) {q.w()} AS g FROM c1), c3 AS (SELECT ticker, g, min(pos) AS first, max(pos) AS last FROM c2 WHERE state = 1 "
    f"GROUP BY ticker, g), c4 AS (SELECT *, CASE WHEN first - lag(last) OVER (PARTITION BY ticker ORDER BY first) - 1 <= 2 THEN 0 ELSE 1 END AS nw "
    f"FROM c3), c5 AS (SELECT *, sum(nw) OVER (PARTITION BY ticker ORDER BY first ROWS UNBOUNDED PRECEDING) AS gg "
    f"FROM c4), c6 AS (SELECT ticker, min(first) AS first, max(last) AS last FROM c5 "
    f"GROUP BY ticker, gg), cy AS (SELECT c6.ticker, c6.first, c6.last, c6.last - c6.first + 1 AS n, b.px / a.px - 1 AS gain FROM c6 "
    f"JOIN panel a ON a.ticker = c6.ticker AND a.pos = c6.first JOIN panel b ON b.ticker = c6.ticker AND b.pos = c6.last "
    f"WHERE c6.last - c6.first + 1 >= 4 AND b.px / a.px - 1 > 0)"
)
_cycles = lambda d: rg.bull_cycles(d, "score", 0.1, -0.1, 2, 4, 2, "px")
_add("reg09_bull_cycles", _cycles, {"gain": 5}, f"{_CYC}, final AS (SELECT * FROM cy)", ("ticker", "first", "last", "n"))
_add(
    "agg33_cycle_summary",
    lambda d: _cycles(d).groupBy("ticker").agg(F.count("*").alias("cycles"), F.avg("n").alias("rows"), F.avg("gain").alias("gain")),
    {"rows": 4, "gain": 5},
    f"{_CYC}, final AS (SELECT ticker, count(*) AS cycles, avg(n) AS rows, avg(gain) AS gain FROM cy GROUP BY ticker)",
    ("ticker", "cycles")
)
_FAR = "n.hit AND (s.spot IS NULL OR n.date - s.spot >= 60)"
_spaced = lambda name, rows, key="ticker": q.walk(
    name,
    rows,
    {"chosen": "n.hit", "spot": "CASE WHEN n.hit THEN n.date END"},
    {"chosen": _FAR, "spot": f"CASE WHEN {_FAR} THEN n.date ELSE s.spot END"},
    key
)
_add(
    "reg10_spaced_events",
    lambda d: rg.spaced_events(
        d.withColumn("hit", F.coalesce(F.col("ret") < -0.3, F.lit(False))).select("date", "ticker", "hit", "fwd"),
        "hit",
        60,
        ["ticker"]
    ).where("chosen"),
    {"fwd": 5},
    f"h0 AS (SELECT date, ticker, fwd, coalesce(ret < -0.3, false) AS hit FROM panel), {_spaced('sp', 'h0')}, final AS (SELECT * FROM sp "
    f"WHERE chosen)",
    _DT
)


def _grid_events(d):
    params = d.sparkSession.createDataFrame([(1, 0.2), (2, 0.3), (3, 0.4)], "param_id int, level double")
    rows = d.select("date", "ticker", "ret", "fwd").crossJoin(F.broadcast(params)).withColumn(
        "hit",
        F.coalesce(F.col("ret") < -F.col("level"), F.lit(False))
    )
    chosen = rg.spaced_events(rows, "hit", 60, ["param_id", "ticker"]).where("chosen and fwd is not null")
    return chosen.groupBy("param_id", "level").agg(
        F.count("*").alias("n"),
        F.avg("fwd").alias("mean"),
        F.avg((F.col("fwd") > 0).cast("double")).alias("hit_rate")
    ).where("n > 5")


_add(
    "agg29_threshold_grid",
    _grid_events,
    {"mean": 5, "hit_rate": 5},
    f"g(param_id, level) AS (VALUES (1, 0.2), (2, 0.3), (3, 0.4)), h0 AS (SELECT date, ticker, param_id, CAST(level AS DOUBLE) AS level, fwd, "
    f"coalesce(ret < -level, false) AS hit FROM panel CROSS JOIN g), {_spaced('sp', 'h0', 'ticker, param_id')}, final AS (SELECT param_id, level, "
    f"count(*) AS n, avg(fwd) AS mean, avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM sp WHERE chosen AND fwd IS NOT NULL "
    f"GROUP BY param_id, level HAVING count(*) > 5)",
    ("param_id", "level", "n")
)
_add(
    "reg12_acceleration",
    lambda d: rg.acceleration(d, "px", 4, 0.8),
    {"past": 5, "ahead": 5},
    f"a AS (SELECT *, ln(px / {q.ref('px', 4)}) AS past, ln({q.ref('px', -4)} / px) AS ahead "
    f"FROM panel), e AS (SELECT *, quantile_cont(past, 0.8) OVER (PARTITION BY ticker) AS edge FROM a), final AS (SELECT * FROM e "
    f"WHERE past >= edge)",
    _DT
)
_add(
    "reg14_event_paths",
    lambda d: rg.event_paths(
        d,
        d.where("ret < -0.45").select("ticker", "pos"),
        2,
        4,
        "px"
    ).where("level is not null").groupBy("step").agg(F.avg("level").alias("level"), F.count("*").alias("n")),
    {"level": 5},
    "ev AS (SELECT ticker, pos, px FROM panel WHERE ret < -0.45), final AS (SELECT p.pos - ev.pos AS step, avg(p.px / ev.px) AS level, count(p.px) "
    "AS n FROM ev JOIN panel p ON p.ticker = ev.ticker AND p.pos BETWEEN ev.pos - 2 AND ev.pos + 4 WHERE p.px IS NOT NULL GROUP BY 1)",
    ("step", "n")
)


def _conditions(d):
    d = staged(_hys(d), f2=ref("px", -2) / F.col("px") - 1, keeps=F.coalesce(ref("state", -2), F.lit(None)))
    conditions = {"all": F.lit(True), "on": F.col("state") == 1, "off": F.col("state") == 0, "on_up": (F.col("state") == 1) & (F.col("ret") > 0)}
    each = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()])))
    rows = d.where("pos % 2 = 0 and f2 is not null").withColumn("condition", each)
    sums = rows.groupBy("condition").agg(
        F.count("*").alias("n"),
        F.avg("f2").alias("mean"),
        F.avg((F.col("f2") > 0).cast("double")).alias("win"),
        F.avg((F.col("keeps") == F.col("state")).cast("double")).alias("remain")
    )
    return sums.join(pooled_quantiles(rows, ["condition"], "f2", {"median": 0.5}), "condition")


_add(
    "agg30_conditional_forward",
    _conditions,
    {"mean": 5, "median": 5, "win": 5, "remain": 5},
    f"{_HYS}, f AS (SELECT *, {q.ref('px', -2)} / px - 1 AS f2, {q.ref('state', -2)} AS keeps FROM hy), c AS (SELECT *, unnest(list_filter(['all', "
    f"CASE WHEN state = 1 THEN 'on' END, CASE WHEN state = 0 THEN 'off' END, CASE WHEN state = 1 AND ret > 0 THEN 'on_up' END], lambda x: x IS NOT "
    f"NULL)) AS condition FROM f WHERE pos % 2 = 0 AND f2 IS NOT NULL), final AS (SELECT condition, count(*) AS n, avg(f2) AS mean, "
    f"quantile_cont(f2, 0.5) AS median, avg(CASE WHEN f2 > 0 THEN 1.0 ELSE 0.0 END) AS win, avg(CASE WHEN keeps = state THEN 1.0 WHEN keeps <> "
    f"state THEN 0.0 END) AS remain FROM c GROUP BY condition)",
    ("condition", "n")
)
_add(
    "agg46_worst_days",
    lambda d: d.where("ret is not null").withColumn(
        "edge",
        F.percentile("ret", F.lit(0.05)).over(xs.Window.partitionBy("ticker"))
    ).where("ret <= edge").groupBy("ticker").agg(F.avg("ret").alias("mean"), F.count("*").alias("n")),
    {"mean": 5},
    "e AS (SELECT *, quantile_cont(ret, 0.05) OVER (PARTITION BY ticker) AS edge FROM panel "
    "WHERE ret IS NOT NULL), final AS (SELECT ticker, avg(ret) AS mean, count(*) AS n FROM e WHERE ret <= edge GROUP BY ticker)",
    ("ticker", "n")
)

# Portfolios
_W = (
    f"tk AS (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS place FROM panel "
    f"WHERE score IS NOT NULL AND pos % 2 = 0), w0 AS (SELECT p.*, CASE WHEN p.pos % 2 = 0 THEN "
    f"CASE WHEN tk.place <= 5 THEN 0.2 ELSE 0.0 END END AS wr FROM panel p LEFT JOIN tk ON tk.date = p.date AND tk.ticker = p.ticker), w1 AS "
    f"(SELECT *, coalesce(last_value(wr IGNORE NULLS) {q.w()}, 0) AS w FROM w0)"
)


def _weights(d):
    chosen = xs.top_k(d.where("pos % 2 = 0"), "score", 5).select("date", "ticker", F.lit(0.2).alias("w"))
    return pf.hold_weights(d, chosen, rebalance_every(d.select("date", "pos").distinct(), 2))


_BT = (
    f"b0 AS (SELECT *, coalesce({q.ref('w')}, 0) AS lw, coalesce(abs(w - {q.ref('w')}), 0) AS dw "
    f"FROM {{src}}), b1 AS (SELECT date, sum(lw * coalesce(ret, 0)) AS gross, sum(abs(lw)) AS exposure, sum(dw) AS turnover FROM b0 "
    f"GROUP BY date), b2 AS (SELECT *, coalesce(lag(turnover) OVER (ORDER BY date), 0) * 0.001 AS cost FROM b1)"
)
_add(
    "pf02_weights_backtest",
    lambda d: pf.backtest(_weights(d), 0.001),
    {"gross": 6, "cost": 7, "net": 6, "turnover": 5, "exposure": 5},
    f"{_W}, {_BT.format(src='w1')}, final AS (SELECT *, gross - cost AS net FROM b2)",
    ("date",)
)
_add(
    "pf01_return_grid",
    lambda d: d.withColumn("r", F.coalesce("ret", F.lit(0.0))),
    {"r": 5},
    "final AS (SELECT date, ticker, coalesce(ret, 0) AS r FROM panel)",
    _DT
)
_add(
    "pf03_benchmark_weights",
    lambda d: pf.backtest(d.withColumn("w", 1 / F.count("*").over(xs.by_date()))),
    {"gross": 6},
    f"w1 AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM panel), {_BT.format(src='w1')}, final AS (SELECT * FROM b2)",
    ("date",)
)
_add(
    "pf05_experiment_stats",
    lambda d: m.perf_summary(pf.backtest(_weights(d), 0.001).withColumn("k", F.lit("top5")).withColumn("net", F.col("net") / 10), "net", "k", 52),
    {"ann_return": 4, "ann_vol": 5, "sharpe": 4, "max_drawdown": 5},
    f"{_W}, {_BT.format(src='w1')}, s AS (SELECT date, (gross - cost) / 10 AS ret FROM b2), e AS (SELECT *, product(1 + ret) OVER (ORDER BY date "
    f"ROWS UNBOUNDED PRECEDING) AS eq FROM s), f AS (SELECT *, eq / max(eq) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd "
    f"FROM e), final AS (SELECT 'top5' AS k, pow(product(1 + ret), 52.0 / count(ret)) - 1 AS ann_return, stddev_pop(ret) * sqrt(52) AS ann_vol, "
    f"avg(ret) / stddev_pop(ret) * sqrt(52) AS sharpe, min(dd) AS max_drawdown FROM f)",
    ("k",)
)


def _legs(d):
    v = staged(d, vol=F.stddev_pop("ret").over(xs.Window.partitionBy("ticker").orderBy("date").rowsBetween(-11, 0))).where("pos % 4 = 0 and vol > 0")
    return xs.top_k(v, "score", 6).withColumn("leg", F.lit("long")).withColumn("budget", F.lit(1.0))


_LEGS = (
    f"v AS (SELECT *, stddev_pop(ret) {q.w(12)} AS vol FROM panel), t AS (SELECT *, row_number() OVER (PARTITION BY date "
    f"ORDER BY score DESC, ticker) AS place FROM v WHERE score IS NOT NULL AND pos % 4 = 0 AND vol > 0), lg AS (SELECT * FROM t WHERE place <= 6)"
)
_add(
    "pf06_allocation",
    lambda d: pf.allocate(_legs(d), "inv_vol"),
    {"w": 6},
    f"{_LEGS}, final AS (SELECT date, ticker, (1 / vol) / sum(1 / vol) OVER (PARTITION BY date) AS w FROM lg)",
    _DT
)
_add(
    "pf07_capped",
    lambda d: pf.allocate(_legs(d), "inv_vol", cap=0.2),
    {"w": 6},
    f"{_LEGS}, a AS (SELECT date, ticker, (1 / vol) / sum(1 / vol) OVER (PARTITION BY date) AS w FROM lg), b AS (SELECT *, least(w, 0.2) AS c, "
    f"CASE WHEN w < 0.2 THEN w ELSE 0 END AS fr FROM a), c AS (SELECT *, c + coalesce(sum(w - c) OVER (PARTITION BY date) * fr / nullif(sum(fr) "
    f"OVER (PARTITION BY date), 0), 0) AS cc FROM b), final AS (SELECT date, ticker, cc / sum(cc) OVER (PARTITION BY date) AS w FROM c)",
    _DT
)
_add(
    "pf08_asset_vol_target",
    lambda d: pf.asset_vol_target(_weights(d), 2.0, 8, 1.5, 52),
    {"w": 6},
    f"{_W}, a AS (SELECT *, w * coalesce(least(2.0 / nullif({q.full('stddev_pop', 'ret', 8)} * sqrt(52), 0), 1.5), 1) AS ws "
    f"FROM w1), g AS (SELECT *, sum(abs(ws)) OVER (PARTITION BY date) AS gr FROM a), x AS (SELECT max(gr) AS worst "
    f"FROM g), final AS (SELECT date, ticker, CASE WHEN worst > 1 AND gr > 0 THEN ws / gr ELSE ws END AS w FROM g, x)".replace(
        f"{q.full('stddev_pop', 'ret', 8)} * sqrt(52)",
        f"({q.full('stddev_pop', 'ret', 8)}) * sqrt(52)"
    ),
    _DT
)
_add(
    "pf09_book_vol",
    lambda d: pf.book_vol(_weights(d).withColumn("w", F.when(F.col("pos") % 8 == 0, F.col("w")).otherwise(0.0)), 8, 52),
    {"full": 5, "diagonal": 5},
    f"{_W}, ww AS (SELECT date, pos, ticker, w FROM w1 WHERE pos % 8 = 0 AND w <> 0), j AS (SELECT ww.date, p.pos AS att, ww.ticker, ww.w, "
    f"coalesce(p.ret, 0) AS r FROM ww JOIN panel p ON p.ticker = ww.ticker AND p.pos BETWEEN ww.pos - 7 AND ww.pos), x AS (SELECT date, att, sum(w "
    f"* r) AS x FROM j GROUP BY date, att), fu AS (SELECT date, stddev_pop(x) * sqrt(52) AS \"full\", count(*) AS n FROM x "
    f"GROUP BY date), dg AS (SELECT date, ticker, max(w) AS w, var_pop(r) AS v FROM j "
    f"GROUP BY date, ticker), di AS (SELECT date, sqrt(sum(w * w * v)) * sqrt(52) AS diagonal FROM dg "
    f"GROUP BY date), final AS (SELECT fu.date, \"full\", diagonal FROM fu JOIN di USING (date) WHERE n = 8)",
    ("date",)
)
ORACLE_SQL["pf09_book_vol"] = ORACLE_SQL["pf09_book_vol"].replace("round(full, 5) + 0.0 AS full", 'round("full", 5) + 0.0 AS "full"')
_add(
    "pf10_kill_switch",
    lambda d: rg.kill_switch(
        m.with_drawdown(d.where("ret is not null").withColumn("ret", F.col("ret") / 10), "ret", "ticker").select("date", "ticker", "dd"),
        "dd",
        0.1,
        5,
        "ticker"
    ).groupBy("ticker").agg(F.count("*").alias("n"), F.sum(F.col("live").cast("int")).alias("live")),
    {},
    f"k0 AS (SELECT date, ticker, ret / 10 AS ret FROM panel WHERE ret IS NOT NULL), k1 AS (SELECT *, product(1 + ret) {q.w()} AS eq "
    f"FROM k0), k2 AS (SELECT *, eq / max(eq) {q.w()} - 1 AS dd FROM k1), "
    f"{q.walk('ks', 'k2', {'live': 'true', 'rest': 'CASE WHEN n.dd <= -0.1 THEN 5 ELSE 0 END'}, {'live': 's.rest = 0', 'rest': 'CASE WHEN s.rest <= 1 AND n.dd <= -0.1 THEN 5 ELSE greatest(s.rest - 1, 0) END'})}, "
    f"final AS (SELECT ticker, count(*) AS n, sum(CAST(live AS INTEGER)) AS live FROM ks GROUP BY ticker)",
    ("ticker", "n", "live")
)
_WANT = "n.w > 1e-12 AND n.rn > s.until"
_PEAK = f"CASE WHEN {_WANT} THEN CASE WHEN s.inside THEN CASE WHEN n.px > s.peak THEN n.px ELSE s.peak END ELSE n.px END END"
_STOPPED = f"coalesce({_WANT} AND n.px / ({_PEAK}) - 1 <= -0.2, false)"
_STOP = q.walk(
    "ts",
    "t0",
    {
        "held": "n.w",
        "exit_flag": "false",
        "dd": "CASE WHEN n.w > 1e-12 THEN n.px / n.px - 1 END",
        "inside": "n.w > 1e-12",
        "peak": "CASE WHEN n.w > 1e-12 THEN n.px END",
        "until": "CAST(0 AS BIGINT)"
    },
    {
        "held": f"CASE WHEN {_STOPPED} OR (n.w > 1e-12 AND n.rn <= s.until) THEN 0.0 ELSE n.w END",
        "exit_flag": _STOPPED,
        "dd": f"n.px / ({_PEAK}) - 1",
        "inside": f"{_WANT} AND NOT {_STOPPED}",
        "peak": _PEAK,
        "until": f"CASE WHEN {_STOPPED} THEN n.rn + 3 ELSE s.until END"
    }
)
_add(
    "pf11_trailing_stop",
    lambda d: rg.trailing_stop(_weights(d).select("date", "ticker", "w", "px"), "w", "px", 0.2, 3, ["ticker"]),
    {"held": 4, "dd": 5},
    f"{_W}, t0 AS (SELECT date, ticker, CAST(w AS DOUBLE) AS w, px FROM w1), {_STOP}, final AS (SELECT * FROM ts)",
    (*_DT, "exit_flag")
)
_add(
    "pf12_series_vol_target",
    lambda d: pf.series_vol_target(d.where("ret is not null"), "ret", 1.0, 8, 2.0, "ticker", 52),
    {"scaled": 5},
    f"r AS (SELECT * FROM panel WHERE ret IS NOT NULL), l AS (SELECT *, least(1.0 / nullif(({q.full('stddev_samp', 'ret', 8)}) * sqrt(52), 0), 2.0) "
    f"AS lev FROM r), final AS (SELECT date, ticker, coalesce({q.ref('lev')}, 0) * ret AS scaled FROM l)",
    _DT
)
_add(
    "pf14_single_asset",
    lambda d: pf.single_asset(d, F.col("score") > 0, 0.001).groupBy("ticker").agg(F.sum("pnl").alias("pnl"), F.avg("position").alias("share")),
    {"pnl": 5, "share": 6},
    f"a AS (SELECT *, coalesce(lag(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END) OVER ({q.TS}), 0) AS ps "
    f"FROM panel), b AS (SELECT *, ps * coalesce(ret, 0) - 0.001 * abs(ps - coalesce({q.ref('ps')}, 0)) AS pnl "
    f"FROM a), final AS (SELECT ticker, sum(pnl) AS pnl, avg(ps) AS share FROM b GROUP BY ticker)",
    ("ticker",)
)


def _grid_backtest(d):
    params = d.sparkSession.createDataFrame([(1, 0.0), (2, 0.1), (3, 0.2), (4, 0.3)], "param_id int, level double")
    rows = d.crossJoin(F.broadcast(params)).withColumn("sig", F.coalesce((F.col("score") > F.col("level")).cast("double"), F.lit(0.0)))
    rows = rows.withColumn("pnl", F.coalesce(ref("sig", 1, ["param_id", "ticker"]), F.lit(0.0)) * F.coalesce("ret", F.lit(0.0)))
    return rows.groupBy("param_id").agg(
        F.avg("pnl").alias("mean"),
        F.stddev_pop("pnl").alias("std")
    ).withColumn("sharpe", div("mean", "std") * 52**0.5)  # a level that no score passes never trades


_add(
    "agg37_parameter_grid",
    _grid_backtest,
    {"mean": 6, "std": 6, "sharpe": 5},
    f"g(param_id, level) AS (VALUES (1, 0.0), (2, 0.1), (3, 0.2), (4, 0.3)), a AS (SELECT param_id, coalesce(lag(CASE WHEN score > level THEN 1.0 "
    f"ELSE 0.0 END) OVER (PARTITION BY param_id, ticker ORDER BY date), 0) * coalesce(ret, 0) AS pnl FROM panel CROSS "
    f"JOIN g), final AS (SELECT param_id, avg(pnl) AS mean, stddev_pop(pnl) AS std, avg(pnl) / stddev_pop(pnl) * sqrt(52) AS sharpe FROM a "
    f"GROUP BY param_id)",
    ("param_id",)
)
_add(
    "pf15_tilt_backtest",
    lambda d: staged(
        _hys(d),
        p=F.coalesce(ref("state"), F.lit(0)),
        r=F.col("p") * F.coalesce("ret", F.lit(0.0))
    ).groupBy("date").agg(F.avg("r").alias("ret"), F.avg("p").alias("share")),
    {"ret": 6, "share": 6},
    f"{_HYS}, a AS (SELECT *, coalesce({q.ref('state')}, 0) AS p FROM hy), final AS (SELECT date, avg(p * coalesce(ret, 0)) AS ret, avg(p) AS share "
    f"FROM a GROUP BY date)",
    ("date",)
)
_add(
    "pf16_matrix_backtest",
    lambda d: pf.backtest(_weights(d)).withColumn("half", F.col("turnover") / 2),
    {"gross": 6, "half": 5},
    f"{_W}, {_BT.format(src='w1')}, final AS (SELECT *, turnover / 2 AS half FROM b2)",
    ("date",)
)
_add(
    "pf17_smoothed_weights",
    lambda d: ewm(_hys(d).select("date", "ticker", F.col("state").cast("double").alias("s")), "s", "w", span=6),
    {"w": 5},
    f"{_HYS}, s0 AS (SELECT date, ticker, CAST(state AS DOUBLE) AS s FROM hy), {q.ewm('final', 's0', 's', 2 / 7, 1, 'w')}",
    _DT
)
_POLICIES = {0: (0.9, 0.1, 0.0), 1: (0.4, 0.4, 0.2), 2: (0.2, 0.7, 0.1)}


def _policy(d):
    d = staged(
        d.select("date", "ticker", "score", "ret"),
        p=F.when(F.col("score").isNotNull(), F.greatest(F.least(0.5 - F.col("score"), F.lit(1.0)), F.lit(0.0))).otherwise(0.5),
        regime=F.when(F.col("score") < -0.1, 2).when(F.col("score") < 0.1, 1).otherwise(0),
        mom=full(F.sum, "ret", 6),
    )
    return pf.policy_weights(d, "p", "regime", "mom", _POLICIES, 0.4, 0.6)


_BLEND = ", ".join(
    f"greatest(least(0.4 * {chance} + 0.6 * CASE regime {' '.join(f'WHEN {r} THEN {w[k]}' for r, w in _POLICIES.items())} END, 1.0), 0.0) AS {name}0"
    for k, (name, chance) in enumerate((("eq", "(1 - p)"), ("bo", "0.6 * p"), ("ca", "(1 - 0.6) * p")))
)
_HALF = 1 - 0.5 ** (1 / 2)
_MEANS = ", ".join(q.ewm(f"pw{i + 4}", f"pw{i + 3}", f"{n}1", _HALF, 1, f"{n}2") for i, n in enumerate(("eq", "bo", "ca")))
_add(
    "pf17_policy_weights",
    _policy,
    {"w_eq": 5, "w_bond": 5, "w_cash": 5},
    f"pw0 AS (SELECT date, ticker, coalesce(greatest(least(0.5 - score, 1.0), 0.0), 0.5) AS p0, score, {q.full('sum', 'ret', 6)} AS mom, "
    f"CASE WHEN score < -0.1 THEN 2 WHEN score < 0.1 THEN 1 ELSE 0 END AS regime FROM panel), "
    f"pw1 AS (SELECT *, CASE WHEN score IS NULL THEN 0.5 ELSE p0 END AS p FROM pw0), pw2 AS (SELECT *, {_BLEND} FROM pw1), "
    f"pw3 AS (SELECT *, eq0 AS eq1, CASE WHEN regime = 1 AND coalesce(mom < 0, false) THEN 0.0 ELSE bo0 END AS bo1, "
    f"CASE WHEN regime = 1 AND coalesce(mom < 0, false) THEN ca0 + bo0 ELSE ca0 END AS ca1 FROM pw2), {_MEANS}, "
    f"final AS (SELECT date, ticker, eq2 / (eq2 + bo2 + ca2) AS w_eq, bo2 / (eq2 + bo2 + ca2) AS w_bond, ca2 / (eq2 + bo2 + ca2) AS w_cash FROM pw6)",
    _DT,
)
_add(
    "pf18_risk_parity",
    lambda d: pf.risk_parity(d, 12).where("w is not null"),
    {"w": 6},
    f"v AS (SELECT *, 1 / nullif({q.std('ret', 12)}, 0) AS iv FROM panel), final AS (SELECT date, ticker, iv / sum(iv) OVER (PARTITION BY date) AS "
    f"w FROM v WHERE iv IS NOT NULL)".replace(f"nullif({q.std('ret', 12)}, 0)", f"nullif(({q.std('ret', 12)}), 0)"),
    _DT
)
_add(
    "pf19_position_pnl",
    lambda d: pf.single_asset(_hys(d), F.col("state") == 1, 0.002),
    {"pnl": 6, "position": 2},
    f"{_HYS}, a AS (SELECT *, coalesce(lag(CAST(state AS DOUBLE)) OVER ({q.TS}), 0) AS position "
    f"FROM hy), final AS (SELECT *, position * coalesce(ret, 0) - 0.002 * abs(position - coalesce({q.ref('position')}, 0)) AS pnl FROM a)",
    _DT
)
_add(
    "win18_rebalance_inference",
    lambda d: rebalance_dates_of(_weights(d)),
    {},
    f"{_W}, a AS (SELECT date, bool_or(abs(w - coalesce({q.ref('w')}, 0)) > 1e-12) AS h, bool_or(pos = 0) AS f FROM (SELECT *, {q.ref('w')} AS z "
    f"FROM w1) GROUP BY date), final AS (SELECT date FROM a WHERE h OR f)".replace(
        f"bool_or(abs(w - coalesce({q.ref('w')}, 0)) > 1e-12)",
        "bool_or(abs(w - coalesce(z, 0)) > 1e-12)"
    ),
    ("date",)
)

# Inference
_LNP = "ln(px) AS y, CAST(pos AS DOUBLE) AS x"
_B = f"OVER ({q.TS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_lnp = lambda d: d.withColumn("y", F.ln("px"))
_add(
    "ml01_expanding_trend",
    lambda d: inf.expanding_trend(_lnp(d), "y"),
    {"forecast": 5, "error": 5, "naive_error": 5},
    f"a AS (SELECT *, {_LNP} FROM panel), b AS (SELECT *, count(y) {_B} AS n, regr_slope(y, x) {_B} AS b, regr_intercept(y, x) {_B} AS a, "
    f"last_value(y IGNORE NULLS) {_B} AS ly FROM a), final AS (SELECT date, ticker, CASE WHEN n >= 10 THEN a + b * x END AS forecast, "
    f"CASE WHEN n >= 10 THEN y - a - b * x END AS error, CASE WHEN n >= 10 THEN y - ly END AS naive_error FROM b)",
    _DT
)
_R = f"OVER ({q.TS} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_add(
    "ml02_rolling_forecast",
    lambda d: inf.rolling_forecast(_lnp(d), "y", 20, 2.1),
    {"forecast": 5, "low": 5, "high": 5, "z": 4},
    f"a AS (SELECT *, {_LNP} FROM panel), b AS (SELECT *, count(y) {_R} AS n, regr_slope(y, x) {_R} AS b, regr_intercept(y, x) {_R} AS a, "
    f"regr_sxx(y, x) {_R} AS sxx, regr_syy(y, x) {_R} AS syy, avg(x) {_R} AS mx FROM a), c AS (SELECT *, "
    f"CASE WHEN n = 20 THEN a + b * x END AS forecast, sqrt(greatest(syy - b * b * sxx, 0) / 18 * (1 + 1 / 20.0 + pow(x - mx, 2) / sxx)) AS s "
    f"FROM b), final AS (SELECT date, ticker, forecast, forecast - 2.1 * s AS low, forecast + 2.1 * s AS high, (y - forecast) / nullif(s, 0) AS z "
    f"FROM c)",
    _DT
)
_add(
    "ml03_split_rmse",
    lambda d: inf.split_rmse(_lnp(d), "y", "pos", F.col("pos") < 250, "ticker"),
    {"train": 5, "test": 5, "naive": 5},
    f"a AS (SELECT *, {_LNP} FROM panel), f AS (SELECT ticker, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS m FROM a WHERE pos < 250 "
    f"GROUP BY ticker), e AS (SELECT a.ticker, pos, y - f.a - b * x AS e, y - m AS e0 FROM a "
    f"JOIN f USING (ticker)), final AS (SELECT ticker, sqrt(avg(CASE WHEN pos < 250 THEN e * e END)) AS train, sqrt(avg(CASE WHEN pos >= 250 THEN e "
    f"* e END)) AS test, sqrt(avg(CASE WHEN pos >= 250 THEN e0 * e0 END)) AS naive FROM e GROUP BY ticker)",
    ("ticker",)
)
_SSE = "({p}yy - {p}y * {p}y / {p}n) - pow({p}xy - {p}x * {p}y / {p}n, 2) / ({p}xx - {p}x * {p}x / {p}n)"
_TERMS = {"n": "1.0", "x": "x", "y": "y", "xx": "x * x", "xy": "x * y", "yy": "y * y"}
_add(
    "ml04_break_scan",
    lambda d: inf.break_scan(_lnp(d), "y", 30),
    {"sse": 4},
    f"a AS (SELECT *, {_LNP} FROM panel WHERE px IS NOT NULL), s AS (SELECT *, " + ", ".join(
        f"sum({t}) {q.w()} AS l_{k}, sum({t}) OVER (PARTITION BY ticker) - sum({t}) {q.w()} AS r_{k}" for k,
        t in _TERMS.items()
    ) + f" FROM a), z AS (SELECT ticker, pos, {_SSE.format(p='l_')} + {_SSE.format(p='r_')} AS sse FROM s "
    f"WHERE l_n >= 30 AND r_n >= 30), final AS (SELECT ticker, arg_min(pos, sse) AS break_at, min(sse) AS sse FROM z GROUP BY ticker)",
    ("ticker", "break_at")
)
_features = lambda d: staged(d, l1=ref("ret"), l2=ref("ret", 2), up=(F.col("fwd") > 0).cast("double"))
_PAST = "FILTER (WHERE y IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_OLS = (
    f"f AS (SELECT date, ticker, ret AS y, {q.ref('ret', 1)} AS l1, {q.ref('ret', 2)} AS l2 FROM panel), s AS (SELECT *, count(*) {_PAST} AS n, "
    + ", ".join(f"avg({a}) {_PAST} AS m_{a}" for a in ("y", "l1", "l2"))
    + ", " + ", ".join(f"avg({a} * {b}) {_PAST} AS m_{a}{b}" for a, b in (("l1", "l1"), ("l1", "l2"), ("l2", "l2"), ("l1", "y"), ("l2", "y")))
    + " FROM f), c AS (SELECT *, "
    + ", ".join(f"m_{a}{b} - m_{a} * m_{b} AS c_{a}{b}" for a, b in (("l1", "l1"), ("l1", "l2"), ("l2", "l2"), ("l1", "y"), ("l2", "y")))
    + " FROM s WHERE n >= 36 AND l1 IS NOT NULL AND l2 IS NOT NULL), final AS (SELECT date, ticker, m_y "
    "+ (c_l1y * c_l2l2 - c_l2y * c_l1l2) / (c_l1l1 * c_l2l2 - c_l1l2 * c_l1l2) * (l1 - m_l1) "
    "+ (c_l2y * c_l1l1 - c_l1y * c_l1l2) / (c_l1l1 * c_l2l2 - c_l1l2 * c_l1l2) * (l2 - m_l2) AS forecast FROM c)"
)
_add(
    "ml05_expanding_ols",
    lambda d: inf.expanding_ols(
        _features(d).select("date", "ticker", "ret", "l1", "l2"),
        "ret",
        ["l1", "l2"],
        36,
        ["ticker"]
    ).where("forecast is not null and not isnan(forecast)"),
    {"forecast": 5},
    _OLS,
    _DT
)
_add(
    "ml10_folds",
    lambda d: inf.make_folds(d.select("date", "pos").distinct(), 104, 13, 2),
    {},
    "mx AS (SELECT max(pos) AS last FROM panel), t AS (SELECT unnest(generate_series(106, last, 13)) AS test_start, last "
    "FROM mx), final AS (SELECT CAST((test_start - 106) / 13 AS INTEGER) AS fold, test_start - 106 AS train_start, test_start - 3 AS train_end, "
    "test_start, least(test_start + 12, last) AS test_end FROM t)",
    ("fold", "train_start", "train_end", "test_start", "test_end")
)
_folds = lambda d: inf.make_folds(d.select("date", "pos").distinct(), 104, 26, 2)
_add(
    "ml06_walk_forward_logistic",
    lambda d: inf.walk_forward_logistic(_features(d), "up", ["score", "l1", "l2"], _folds(d)),
    {"p": 5},
    None,
    ("fold", *_DT)
)


def _c_grid(d):
    out = None
    for i, ridge in enumerate((0.1, 1.0, 10.0)):
        part = m.auc(inf.walk_forward_logistic(_features(d), "up", ["score", "l1"], _folds(d), ridge), "p", "y", "fold").withColumn("grid", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


_add("ml07_penalty_grid", _c_grid, {"auc": 4}, None, ("grid", "fold"))
_TK = [f"Brand#{i}" for i in range(1, 26)]
_add(
    "ml08_principal_components",
    lambda d: inf.components_of(d, "date", "ticker", "ret", 3),
    {"loading": 4, "share": 5},
    None,
    ("component", "name")
)
_add(
    "ml09_hac_slope",
    lambda d: inf.hac_slope(d, "fwd", "score", 2, "ticker"),
    {"slope": 5, "t_value": 4},
    f"a AS (SELECT * FROM panel WHERE fwd IS NOT NULL AND score IS NOT NULL), f AS (SELECT ticker, regr_slope(fwd, score) AS slope, "
    f"regr_intercept(fwd, score) AS a, avg(score) AS mx, regr_sxx(fwd, score) AS sxx FROM a "
    f"GROUP BY ticker), u AS (SELECT a.ticker, a.date, slope, sxx, (score - mx) * (fwd - f.a - slope * score) AS u FROM a "
    f"JOIN f USING (ticker)), v AS (SELECT *, u * u + 2 * (1 - 1 / 3.0) * u * coalesce({q.ref('u', 1)}, 0) + 2 * (1 - 2 / 3.0) * u * "
    f"coalesce({q.ref('u', 2)}, 0) AS v FROM u), final AS (SELECT ticker, any_value(slope) AS slope, "
    f"CASE WHEN count(*) >= 10 THEN any_value(slope) * any_value(sxx) / sqrt(greatest(sum(v), 0)) END AS t_value FROM v GROUP BY ticker)",
    ("ticker",)
)
_add(
    "ml12_rank_ic_of_scores",
    lambda d: m.ic_stats(
        m.spearman_ic(
            inf.walk_forward_logistic(_features(d), "up", ["score", "l1", "l2"], _folds(d)).join(
                d.select("date", "ticker", "fwd"),
                ["date", "ticker"]
            ),
            "p",
            "fwd",
            5,
            ["date", "fold"]
        ),
        ["fold"]
    ),
    {"mean": 4, "icir": 4},
    None,
    ("fold", "n")
)
_add(
    "ml13_shift_test",
    lambda d: inf.shift_test(d.withColumn("on", F.coalesce(F.col("score") > 0.2, F.lit(False))), "on", "fwd", 200, "ticker"),
    {"observed": 5, "p": 5},
    None,
    ("ticker",)
)
_add(
    "ml14_draw_test",
    lambda d: inf.draw_test(
        d.where("score is not null and fwd is not null").withColumn("on", F.col("score") < -0.2).withColumn("y", F.col("fwd") > 0),
        "on",
        "y",
        200,
        "ticker"
    ),
    {"p": 5},
    None,
    ("ticker", "hits")
)
_random = lambda: F.md5(F.concat_ws("|", "ticker", F.date_format("date", "yyyy-MM-dd")).cast("binary"))
_add(
    "ml15_random_baseline",
    lambda d: d.where("fwd is not null").withColumn(
        "k",
        F.row_number().over(xs.Window.partitionBy("ticker").orderBy(_random()))
    ).where("k <= 20").groupBy("ticker").agg(F.avg("fwd").alias("mean")),
    {"mean": 5},
    "k0 AS (SELECT ticker, fwd, row_number() OVER (PARTITION BY ticker ORDER BY md5(ticker || '|' || strftime(date, '%Y-%m-%d'))) AS k FROM panel "
    "WHERE fwd IS NOT NULL), final AS (SELECT ticker, avg(fwd) AS mean FROM k0 WHERE k <= 20 GROUP BY ticker)",
    ("ticker",)
)
_add(
    "ml16_lag_features",
    lambda d: staged(_features(d), inter=F.col("l1") * F.col("score")).where("inter is not null"),
    {"l1": 5, "l2": 5, "inter": 5},
    f"a AS (SELECT *, {q.ref('ret')} AS l1, {q.ref('ret', 2)} AS l2 FROM panel), final AS (SELECT *, l1 * score AS inter FROM a "
    f"WHERE l1 * score IS NOT NULL)",
    _DT
)
_add(
    "ml18_enrichment_grid",
    lambda d: d.where("score is not null and fwd is not null").crossJoin(
        F.broadcast(d.sparkSession.createDataFrame([(1, -0.2), (2, -0.3), (3, -0.4)], "param_id int, level double"))
    ).groupBy("param_id").agg(
        F.sum(((F.col("score") < F.col("level")) & (F.col("fwd") > 0)).cast("long")).alias("a"),
        F.sum((F.col("score") < F.col("level")).cast("long")).alias("m"),
        F.sum((F.col("fwd") > 0).cast("long")).alias("y"),
        F.count("*").alias("n")
    ),
    {},
    "g(param_id, level) AS (VALUES (1, -0.2), (2, -0.3), (3, -0.4)), final AS (SELECT param_id, count(CASE WHEN score < level AND fwd > 0 THEN 1 "
    "END) AS a, count(CASE WHEN score < level THEN 1 END) AS m, count(CASE WHEN fwd > 0 THEN 1 END) AS y, count(*) AS n FROM panel CROSS JOIN g "
    "WHERE score IS NOT NULL AND fwd IS NOT NULL GROUP BY param_id)",
    ("param_id", "a", "m", "y", "n")
)
# Indicators with recursion
_ind = lambda d: d.withColumn("close", F.col("px"))


def _macd(d):
    d = ewm(
        ewm(d.select("date", "ticker", "px"), "px", "fast", span=12, least=12),
        "px",
        "slow",
        span=26,
        least=26
    ).withColumn("macd", F.col("fast") - F.col("slow"))
    return ewm(d, "macd", "signal", span=9, least=9).withColumn("hist", F.col("macd") - F.col("signal")).where("hist is not null and not isnan(hist)")


_EMAS = (
    f"{q.ewm('e1', 'b0', 'px', 2 / 13, 12, 'fast')}, {q.ewm('e2', 'e1', 'px', 2 / 27, 26, 'slow')}, e3 AS (SELECT *, fast - slow AS macd "
    f"FROM e2), {q.ewm('e4', 'e3', 'macd', 2 / 10, 9, 'signal')}"
)
_add(
    "ind02_macd",
    _macd,
    {"macd": 3, "signal": 3, "hist": 3},
    f"b0 AS (SELECT date, ticker, px FROM panel), {_EMAS}, final AS (SELECT *, macd - signal AS hist FROM e4 WHERE macd - signal IS NOT NULL)",
    _DT
)
_add(
    "ind09_spread_20",
    lambda d: staged(d, r=change("px", 20)).where("r is not null and ticker in ('Brand#1', 'Brand#2')").groupBy("date").agg(
        (F.max(F.when(F.col("ticker") == "Brand#1", F.col("r"))) - F.max(F.when(F.col("ticker") == "Brand#2", F.col("r")))).alias("spread")
    ),
    {"spread": 5},
    f"a AS (SELECT date, ticker, {q.change('px', 20)} AS r FROM panel), final AS (SELECT date, max(CASE WHEN ticker = 'Brand#1' THEN r END) - "
    f"max(CASE WHEN ticker = 'Brand#2' THEN r END) AS spread FROM a WHERE r IS NOT NULL AND ticker IN ('Brand#1', 'Brand#2') GROUP BY date)",
    ("date",)
)
_add(
    "ind11_monthly_bull",
    lambda d: staged(
        d.groupBy("ticker", F.last_day("date").alias("date")).agg(F.max_by("px", F.when(F.col("px").isNotNull(), F.col("date"))).alias("px")),
        ma12=ma("px", 12),
        bull=F.coalesce((F.col("px") > F.col("ma12")) & (F.col("ma12") > ref("ma12")) & (change("px", 12) > 0), F.lit(False))
    ),
    {},
    f"mo AS (SELECT ticker, last_day(date) AS date, max_by(px, CASE WHEN px IS NOT NULL THEN date END) AS px FROM panel "
    f"GROUP BY ticker, last_day(date)), a AS (SELECT *, {q.ma('px', 12)} AS m FROM mo), final AS (SELECT date, ticker, coalesce(px > m AND m > "
    f"{q.ref('m')} AND {q.change('px', 12)} > 0, false) AS bull FROM a)",
    (*_DT, "bull")
)
_add(
    "ind12_composite_features",
    lambda d: compute(_ind(d), "rsi", lookback=6).withColumnRenamed("value", "rsi").where("rsi is not null and not isnan(rsi)"),
    {"rsi": 3},
    f"b0 AS (SELECT date, ticker, px FROM panel), {q.rsi('r', 'b0', 'px', 6)}, final AS (SELECT * FROM r WHERE rsi IS NOT NULL)",
    _DT
)
_add(
    "ind14_bond_approximation",
    lambda d: staged(d, y=F.col("px") / 20000, dy=F.col("y") - ref("y"), r=ref("y") / 52 - 7 * F.col("dy")).where("r is not null"),
    {"r": 6},
    f"a AS (SELECT *, px / 20000 AS y FROM panel), b AS (SELECT date, ticker, {q.ref('y')} / 52 - 7 * (y - {q.ref('y')}) AS r "
    f"FROM a), final AS (SELECT * FROM b WHERE r IS NOT NULL)",
    _DT
)
_add(
    "ind15_month_end_features",
    lambda d: staged(
        d.where("px is not null").groupBy("ticker", F.last_day("date").alias("date")).agg(
            F.avg("px").alias("mean"),
            F.max_by("px", "date").alias("last")
        ),
        yoy=change("last", 12)
    ),
    {"mean": 8, "last": 6, "yoy": 5},
    f"mo AS (SELECT ticker, last_day(date) AS date, avg(px) AS mean, max_by(px, date) AS last FROM panel WHERE px IS NOT NULL "
    f"GROUP BY ticker, last_day(date)), final AS (SELECT *, {q.change('last', 12)} AS yoy FROM mo)",
    _DT
)
_add(
    "ind16_credit_score",
    lambda d: staged(d, z=-zscore("px", 26)).where("z is not null"),
    {"z": 4},
    f"a AS (SELECT *, -(px - ({q.ma('px', 26)})) / nullif(({q.std('px', 26)}), 0) AS z FROM panel), final AS (SELECT * FROM a WHERE z IS NOT NULL)",
    _DT
)
_add(
    "ind17_short_rsi",
    lambda d: compute(_ind(d), "rsi", lookback=1).where("value < 22").withColumnRenamed("value", "rsi"),
    {"rsi": 3},
    f"b0 AS (SELECT date, ticker, px FROM panel), {q.rsi('r', 'b0', 'px', 1)}, final AS (SELECT * FROM r WHERE rsi < 22)",
    _DT
)
_add(
    "agg40_subsample_regimes",
    lambda d: (lambda r: r.groupBy("year", "ticker").agg(F.avg("p").alias("share"), F.sum("pnl").alias("pnl")))(
        staged(
            d.withColumn("year", F.year("date")),
            state=rg.hysteresis("score", 0.2, -0.2, ["year", "ticker"]),
            p=F.coalesce(ref("state", 1, ["year", "ticker"]), F.lit(0)),
            pnl=F.col("p") * F.coalesce("ret", F.lit(0.0))
        )
    ),
    {"share": 5, "pnl": 5},
    "a AS (SELECT *, year(date) AS year FROM panel), b AS (SELECT *, coalesce(last_value(CASE WHEN score > 0.2 THEN 1 WHEN score < -0.2 THEN 0 END "
    "IGNORE NULLS) OVER (PARTITION BY year, ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS state "
    "FROM a), c AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY year, ticker ORDER BY date), 0) AS p "
    "FROM b), final AS (SELECT year, ticker, avg(p) AS share, sum(p * coalesce(ret, 0)) AS pnl FROM c GROUP BY year, ticker)",
    ("year", "ticker")
)
_add(
    "agg43_alpha_vs_static",
    lambda d: staged(_hys(d), p=F.coalesce(ref("state"), F.lit(0)).cast("double"), r=F.coalesce("ret", F.lit(0.0))).groupBy("ticker").agg(
        (F.avg(F.col("p") * F.col("r")) - F.avg("p") * F.avg("r")).alias("alpha"),
        m.corr_of("p", "r").alias("ic")
    ),
    {"alpha": 6, "ic": 5},
    f"{_HYS}, a AS (SELECT ticker, CAST(coalesce({q.ref('state')}, 0) AS DOUBLE) AS p, coalesce(ret, 0) AS r "
    f"FROM hy), final AS (SELECT ticker, avg(p * r) - avg(p) * avg(r) AS alpha, covar_samp(p, r) / nullif(stddev_samp(p) * stddev_samp(r), 0) AS ic "
    f"FROM a GROUP BY ticker)",
    ("ticker",)
)
_add(
    "agg44_days_to_target",
    lambda d: staged(
        d,
        drift=F.ln(F.col("px") / ref("px", 8)) / 8,
        days=F.when(F.col("drift") > 1e-4, F.ln(F.lit(1.2)) / F.col("drift"))
    ).where("days is not null").groupBy("ticker").agg(
        *[F.percentile("days", F.lit(p)).alias(n) for p, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))],
        F.min("days").alias("low")
    ),
    {"p25": 4, "median": 4, "p75": 4, "low": 4},
    f"a AS (SELECT *, ln(px / {q.ref('px', 8)}) / 8 AS dr FROM panel), b AS (SELECT ticker, ln(1.2) / dr AS days FROM a "
    f"WHERE dr > 1e-4), final AS (SELECT ticker, quantile_cont(days, 0.25) AS p25, quantile_cont(days, 0.5) AS median, quantile_cont(days, 0.75) AS "
    f"p75, min(days) AS low FROM b GROUP BY ticker)",
    ("ticker",)
)
_add(
    "fn11_safe_division",
    lambda d: d.withColumn("v", F.try_divide("volume", F.when(F.abs("ret") > 1e-3, F.col("ret")))),
    {"v": 3},
    "final AS (SELECT date, ticker, volume / CASE WHEN abs(ret) > 1e-3 THEN ret END AS v FROM panel)",
    _DT
)
_add(
    "fn13_math",
    lambda d: d.where("ret is not null").select(
        "date",
        "ticker",
        F.log1p(F.abs("ret")).alias("a"),
        F.degrees(F.atan("ret")).alias("b"),
        (1 / (1 + F.exp(-F.col("ret")))).alias("c")
    ),
    {"a": 6, "b": 5, "c": 6},
    "final AS (SELECT date, ticker, ln(1 + abs(ret)) AS a, degrees(atan(ret)) AS b, 1 / (1 + exp(-ret)) AS c FROM panel WHERE ret IS NOT NULL)",
    _DT
)
_add(
    "fn18_cycle_labels",
    lambda d: d.select(F.year("date").alias("y")).distinct().select(
        "y",
        F.element_at(F.array(*[F.lit(x) for x in "abcdefghij"]), F.col("y") % 10 + 1).alias("stem"),
        (F.col("y") % 12).alias("branch")
    ),
    {},
    "final AS (SELECT DISTINCT year(date) AS y, substr('abcdefghij', CAST(year(date) % 10 + 1 AS INTEGER), 1) AS stem, year(date) % 12 AS branch "
    "FROM panel)",
    ("y", "stem", "branch")
)
