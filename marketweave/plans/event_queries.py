"""Registered universe, join, set, scalar and filing queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import ffill, ma, ref, staged
from ..operators import filings as fl
from ..operators import joins as jn
from ..operators import universe as un
from ..sources.bars import bars, calendar, densify, member_events, sectors, sparse_bars, table
from ..sources.panel import panel
from . import sqlkit as q

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(key: str, run, digits: dict[str, int], sql: str | None, plain: tuple[str, ...] = ()) -> None:
    """Registers run(spark, sf_dir); sql is a list of common table expressions that ends in final."""
    QUERIES[key] = lambda spark, sf_dir: run(spark, sf_dir).select(*plain, *[F.round(c, d).alias(c) for c, d in digits.items()])
    if sql is not None:
        ORACLE_SQL[key] = q.recursive(
            f"WITH {sql.strip()}\nSELECT {', '.join([*plain, *[f'round({c}, {d}) + 0.0 AS {c}' for c, d in digits.items()]])} FROM final"
        )


_DT = ("date", "ticker")
_nat = lambda s, d: bars(s, d, "nation")
_YES = lambda c: f"coalesce({c}, false)"

# Universe
_add(
    "flt01_date_slice",
    lambda s, d: panel(s, d).where("date between date'1996-01-01' and date'1996-12-31' and px is not null"),
    {"px": 6},
    f"{q.PANEL}, final AS (SELECT * FROM panel WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND px IS NOT NULL)",
    _DT
)
_add(
    "flt02_align_mask",
    lambda s, d: densify(
        sparse_bars(s, d, "nation").select("date", "ticker", (F.col("volume") > 30).alias("m"))
    ).withColumn("m", F.coalesce("m", F.lit(False))),
    {},
    f"{q.NATION}, final AS (SELECT date, ticker, coalesce(volume > 30, false) AS m FROM bars)",
    (*_DT, "m")
)
_add(
    "flt03_price_floor",
    lambda s, d: bars(s, d).withColumn("ok", un.price_floor(8, 900.0)),
    {},
    f"{q.BRAND}, final AS (SELECT *, {_YES(f'({q.ma("close", 8)}) >= 900')} AS ok FROM bars)",
    (*_DT, "ok")
)
_add(
    "flt04_mcap_bounds",
    lambda s, d: bars(s, d).withColumn("ok", un.mean_between("mkt_cap", 8, 5e7, 2e8)),
    {},
    f"{q.BRAND}, m AS (SELECT *, {q.ma('mkt_cap', 8)} AS m FROM bars), final AS (SELECT *, coalesce(m >= 5e7 AND m <= 2e8, false) AS ok FROM m)",
    (*_DT, "ok")
)
_add(
    "flt05_turnover_floor",
    lambda s, d: bars(s, d).withColumn("ok", un.mean_between("turnover", 8, 1.5e5, None)),
    {},
    f"{q.BRAND}, final AS (SELECT *, {_YES(f'({q.ma("turnover", 8)}) >= 1.5e5')} AS ok FROM bars)",
    (*_DT, "ok")
)
_add(
    "flt06_seasoning",
    lambda s, d: _nat(s, d).withColumn("ok", un.seasoned(60)),
    {},
    f"{q.NATION}, final AS (SELECT *, count(close) {q.w()} >= 60 AS ok FROM bars)",
    (*_DT, "ok")
)
_SPANS = (
    "spans AS (SELECT n_name AS ticker, DATE '1995-06-01' + CAST(n_nationkey * 30 AS INTEGER) AS start, DATE '1999-01-01' + CAST(n_nationkey * 20 "
    "AS INTEGER) AS \"end\" FROM nation WHERE n_nationkey < 20)"
)
_spans = lambda s, d: table(s, d, "nation").where("n_nationkey < 20").select(
    F.col("n_name").alias("ticker"),
    F.date_add(F.lit("1995-06-01").cast("date"), F.col("n_nationkey") * 30).alias("start"),
    F.date_add(F.lit("1999-01-01").cast("date"), F.col("n_nationkey") * 20).alias("end")
)
_ALIVE = (
    f"{q.NATION}, {_SPANS}, final AS (SELECT b.date, b.ticker, s.ticker IS NOT NULL AS alive FROM bars b LEFT "
    f"JOIN spans s ON s.ticker = b.ticker AND b.date BETWEEN s.start AND s.\"end\")"
)
_add("flt07_life_span", lambda s, d: jn.within_span(_nat(s, d).select("date", "ticker"), _spans(s, d), "ticker", "date"), {}, _ALIVE, (*_DT, "alive"))
_add(
    "jon07_interval_join",
    lambda s, d: jn.within_span(_nat(s, d).where("volume > 10").select("date", "ticker"), _spans(s, d), "ticker", "date").where("alive"),
    {},
    f"{q.NATION}, {_SPANS}, final AS (SELECT b.date, b.ticker, true AS alive FROM bars b "
    f"JOIN spans s ON s.ticker = b.ticker AND b.date BETWEEN s.start AND s.\"end\" WHERE b.volume > 10)",
    (*_DT, "alive")
)
_CFG = un.UniverseConfig(price_window=8, min_price=700.0, mcap_window=8, min_mcap=3e7, turnover_window=8, min_turnover=1e5, min_age=20)
_INV = (
    f"({_YES(f'({q.ma("close", 8)}) >= 700')} AND {_YES(f'({q.ma("mkt_cap", 8)}) >= 3e7')} AND {_YES(f'({q.ma("turnover", 8)}) >= 1e5')} AND "
    f"count(close) {q.w()} >= 20)"
)
_add(
    "flt08_combined_filters",
    lambda s, d: (lambda b: b.withColumn("ok", un.investable(b, _CFG)))(bars(s, d)),
    {},
    f"{q.BRAND}, final AS (SELECT *, {_INV} AS ok FROM bars)",
    (*_DT, "ok")
)


def _events(s, d, strict=True):
    """Membership events on trading dates: ticker, date, delta."""
    ev = member_events(s, d).withColumn("delta", F.when(F.col("direction") == "in", 1).otherwise(-1))
    on = jn.next_trading_date(ev.select("code", "change_date", "delta"), calendar(sparse_bars(s, d)), "change_date", strict)
    return on.where("trade_date is not null").select(F.col("code").alias("ticker"), F.col("trade_date").alias("date"), "delta")


_EV = (
    "ev AS (SELECT 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS d, "
    "CASE o_orderstatus WHEN 'O' THEN 1 ELSE -1 END AS delta FROM orders WHERE o_orderstatus IN ('O', 'F')), ed AS (SELECT ev.ticker, dates.date, "
    "delta FROM ev ASOF JOIN dates ON ev.d < dates.date)"
)
_DELTA = (
    f"{q.BRAND}, {_EV}, sm AS (SELECT date, ticker, sum(delta) AS delta FROM ed GROUP BY date, ticker), mem AS (SELECT b.*, sum(coalesce(delta, 0)) "
    f"OVER (PARTITION BY b.ticker ORDER BY b.date ROWS UNBOUNDED PRECEDING) + CASE WHEN b.ticker IN ('Brand#1', 'Brand#2') THEN 1 ELSE 0 END > 0 AS "
    f"member FROM bars b LEFT JOIN sm ON sm.date = b.date AND sm.ticker = b.ticker)"
)
_member = lambda s, d: jn.replay_delta(bars(s, d), _events(s, d), ["Brand#1", "Brand#2"])
_add(
    "jon08_next_trading_date",
    lambda s, d: jn.next_trading_date(
        member_events(s, d).select("event_id", "change_date"),
        calendar(sparse_bars(s, d, "nation")),
        "change_date",
        False
    ),
    {},
    f"{q.NATION}, e AS (SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS change_date FROM orders "
    f"WHERE o_orderstatus IN ('O', 'F')), final AS (SELECT event_id, change_date, dates.date AS trade_date FROM e ASOF LEFT "
    f"JOIN dates ON e.change_date <= dates.date)",
    ("event_id", "change_date", "trade_date")
)
_add("jon13_replay_delta", _member, {}, f"{_DELTA}, final AS (SELECT * FROM mem)", (*_DT, "member"))
_add(
    "jon14_replay_last",
    lambda s, d: jn.replay_last(bars(s, d), _events(s, d), ["Brand#3"]),
    {},
    f"{q.BRAND}, {_EV}, la AS (SELECT date, ticker, min(delta) AS delta FROM ed GROUP BY date, ticker), final AS (SELECT b.date, b.ticker, "
    f"coalesce(last_value(delta IGNORE NULLS) OVER (PARTITION BY b.ticker ORDER BY b.date ROWS UNBOUNDED PRECEDING) > 0, b.ticker = 'Brand#3') AS "
    f"member FROM bars b LEFT JOIN la ON la.date = b.date AND la.ticker = b.ticker)",
    (*_DT, "member")
)
_add(
    "flt09_final_universe",
    lambda s, d: un.universe_bundle(_member(s, d), _CFG),
    {},
    f"{_DELTA}, final AS (SELECT date, ticker, member AND close IS NOT NULL AND {_INV} AS eligible FROM mem)",
    (*_DT, "eligible")
)
_add(
    "flt10_universe_bundle",
    lambda s, d: un.universe_bundle(_member(s, d), _CFG, F.lit("1996-01-01").cast("date")),
    {},
    f"{_DELTA}, final AS (SELECT date, ticker, member AND date >= DATE '1996-01-01' AS member, close IS NOT NULL AS \"exists\", {_INV} AS "
    f"investable, member AND date >= DATE '1996-01-01' AND close IS NOT NULL AND {_INV} AS eligible FROM mem)",
    (*_DT, "member", "exists", "investable", "eligible")
)
ORACLE_SQL["flt10_universe_bundle"] = ORACLE_SQL["flt10_universe_bundle"].replace("member, exists, investable", 'member, "exists", investable')
_limits = lambda b: staged(b, _p=ref("close"), high_limit=F.round(F.col("_p") * 1.4, 2), low_limit=F.round(F.col("_p") * 0.6, 2))
_LIM = (
    f"lim AS (SELECT *, round({q.ref('close')} * 1.4, 2) AS hl, round({q.ref('close')} * 0.6, 2) AS ll "
    f"FROM bars), mk AS (SELECT *, open IS NOT NULL AND close IS NOT NULL AND volume > 0 AS tradeable, coalesce(abs(close - hl) <= 200, false) AS "
    f"up, coalesce(abs(close - ll) <= 200, false) AS down, coalesce(abs(open - hl) <= 200, false) AS oup, coalesce(abs(open - ll) <= 200, false) AS "
    f"odown FROM lim), m2 AS (SELECT *, coalesce({q.ref('tradeable', -1)}, false) AND NOT coalesce({q.ref('oup', -1)}, true) AS can_buy_next_open, "
    f"coalesce({q.ref('tradeable', -1)}, false) AND NOT coalesce({q.ref('odown', -1)}, true) AS can_sell_next_open, "
    f"coalesce({q.ref('tradeable', -1)}, false) AND NOT coalesce({q.ref('up', -1)}, true) AS can_buy_next_close, coalesce({q.ref('tradeable', -1)}, "
    f"false) AND NOT coalesce({q.ref('down', -1)}, true) AS can_sell_next_close FROM mk)"
)
_masks = lambda s, d: un.next_close_masks(un.execution_masks(_limits(_nat(s, d)), 200.0))
_add(
    "flt11_execution_masks",
    _masks,
    {},
    f"{q.NATION}, {_LIM}, final AS (SELECT *, up AS limit_up_locked, down AS limit_down_locked FROM m2)",
    (*_DT, *un.MASKS)
)
_add("flt12_next_close_masks", _masks, {}, f"{q.NATION}, {_LIM}, final AS (SELECT * FROM m2)", (*_DT, "can_buy_next_close", "can_sell_next_close"))
_add(
    "flt13_feasible",
    lambda s, d: _masks(s, d).withColumn("ok", un.feasible(5)),
    {},
    f"{q.NATION}, {_LIM}, final AS (SELECT *, can_buy_next_open AND coalesce({q.ref('can_sell_next_open', -5)}, false) AS ok FROM m2)",
    (*_DT, "ok")
)
_add(
    "flt14_score_bounds",
    lambda s, d: panel(s, d).where(un.score_between("score", -0.1, 0.3)),
    {"score": 6},
    f"{q.PANEL}, final AS (SELECT * FROM panel WHERE score IS NULL OR (score >= -0.1 AND score <= 0.3))",
    _DT
)
_add(
    "flt15_tight_stack",
    lambda s, d: un.tight_stack(panel(s, d).withColumnRenamed("px", "close"), 0.2, 0.8, 20, 2),
    {},
    f"{q.PANEL}, t AS (SELECT *, {q.ma('px', 5)} AS a, {q.ma('px', 10)} AS b, {q.ma('px', 20)} AS c, {q.div('volume', f'({q.ma("volume", 20)})')} "
    f"AS vr FROM panel), final AS (SELECT date, ticker, {_YES('a > b AND b > c')} AND "
    f"{_YES('(greatest(a, b, c) - least(a, b, c)) / px <= 0.2 AND c IS NOT NULL')} AND {_YES(f'({q.full("min", "vr", 2)}) >= 0.8')} AS setup FROM t)",
    (*_DT, "setup")
)
_FLAG = (
    f"l AS (SELECT *, {q.ma('px', 10)} AS f, {q.ma('px', 20)} AS m, {q.ma('px', 40)} AS w FROM panel), fl AS (SELECT *, "
    f"CASE WHEN {_YES('px < f')} AND ({_YES(f'f < {q.ref("f", 4)}')} OR {_YES(f'm < {q.ref("m", 4)}')} OR {_YES('f < m')}) THEN -1 WHEN "
    f"{_YES('px > f AND f > m AND m > w')} AND {_YES(f'f > {q.ref("f", 4)}')} AND {_YES(f'm > {q.ref("m", 4)}')} THEN 1 ELSE 0 END AS flag FROM l)"
)
_flag = lambda s, d: un.structure_flag(panel(s, d).withColumnRenamed("px", "close"), 10, 20, 40, 4)
_add("flt16_structure_flag", _flag, {}, f"{q.PANEL}, {_FLAG}, final AS (SELECT * FROM fl)", (*_DT, "flag"))
_add(
    "flt17_regime_filter",
    lambda s, d: _flag(s, d).withColumn("s", F.when(F.col("flag") == 1, F.col("score"))).where("s is not null"),
    {"s": 6},
    f"{q.PANEL}, {_FLAG}, final AS (SELECT *, score AS s FROM fl WHERE flag = 1 AND score IS NOT NULL)",
    _DT
)
_add(
    "flt18_event_precondition",
    lambda s, d: staged(panel(s, d), ok=un.after_move("px", 5, 0.1)).where("ret < -0.3 and ok"),
    {"ret": 5},
    f"{q.PANEL}, p AS (SELECT *, {_YES(f'{q.div(q.ref("px", 1), q.ref("px", 5))} - 1 > 0.1')} AS ok FROM panel), final AS (SELECT * FROM p "
    f"WHERE ret < -0.3 AND ok)",
    _DT
)
_PERIODS = (("a", "1995-01-01", "1996-12-31"), ("b", "1996-06-01", "1999-12-31"), ("c", "2000-01-01", "2001-12-31"))


def _periods(s, d):
    p = s.createDataFrame(_PERIODS, "name string, start string, end string").select(
        "name",
        F.col("start").cast("date").alias("start"),
        F.col("end").cast("date").alias("end")
    )
    return panel(s, d).where("ret is not null").join(F.broadcast(p), F.col("date").between(F.col("start"), F.col("end"))).groupBy("name").agg(
        F.count("*").alias("n"),
        F.avg("ret").alias("mean"),
        F.stddev_pop("ret").alias("std")
    )


_PER = (
    f"{q.PANEL}, pd(name, lo, hi) AS (VALUES {', '.join(f'({a!r}, DATE {b!r}, DATE {c!r})' for a, b, c in _PERIODS)}), final AS (SELECT name, "
    f"count(*) AS n, avg(ret) AS mean, stddev_pop(ret) AS std FROM panel JOIN pd ON date BETWEEN lo AND hi WHERE ret IS NOT NULL GROUP BY name)"
)
_add("flt19_period_cuts", _periods, {"mean": 5, "std": 5}, _PER, ("name", "n"))
_add("agg39_period_stats", _periods, {"mean": 5}, _PER, ("name", "n"))

# Joins
_add(
    "jon01_align_left",
    lambda s, d: densify(
        sparse_bars(s, d, "nation").where("volume > 40").select("date", "ticker", "volume")
    ).withColumn("w", F.coalesce("volume", F.lit(0.0))),
    {"w": 4},
    f"{q.NATION}, sp AS (SELECT * FROM sparse WHERE volume > 40), final AS (SELECT d.date, t.ticker, coalesce(s.volume, 0) AS w "
    f"FROM (SELECT DISTINCT date FROM sp) d CROSS JOIN (SELECT DISTINCT ticker FROM sp) t LEFT JOIN sp s ON s.date = d.date AND s.ticker = t.ticker)",
    _DT
)
_add(
    "jon02_densify",
    lambda s, d: _nat(s, d).groupBy("ticker").agg(F.count("*").alias("cells"), F.count("close").alias("filled")),
    {},
    f"{q.NATION}, final AS (SELECT ticker, count(*) AS cells, count(close) AS filled FROM bars GROUP BY ticker)",
    ("ticker", "cells", "filled")
)
_one = lambda s, d, n, c: sparse_bars(s, d, "nation").where(F.col("ticker") == n).select("date", F.col("close").alias(c))
_ONE = "a AS (SELECT date, close AS x FROM sparse WHERE ticker = 'NATION_1'), b AS (SELECT date, close AS y FROM sparse WHERE ticker = 'NATION_2')"
_add(
    "jon03_inner",
    lambda s, d: _one(s, d, "NATION_1", "x").join(_one(s, d, "NATION_2", "y"), "date"),
    {"x": 9, "y": 9},
    f"{q.NATION}, {_ONE}, final AS (SELECT a.date, x, y FROM a JOIN b ON a.date = b.date)",
    ("date",)
)
_add(
    "jon04_outer",
    lambda s, d: _one(s, d, "NATION_1", "x").join(_one(s, d, "NATION_2", "y"), "date", "full"),
    {"x": 9, "y": 9},
    f"{q.NATION}, {_ONE}, final AS (SELECT coalesce(a.date, b.date) AS date, x, y FROM a FULL JOIN b ON a.date = b.date)",
    ("date",)
)
_filings = lambda s, d: table(s, d, "orders").select(
    "o_orderkey",
    F.concat(F.lit("NATION_"), (F.col("o_custkey") % 25).cast("string")).alias("ticker"),
    F.to_date("o_orderdate").alias("publish")
)
_FIL = "fil AS (SELECT o_orderkey, 'NATION_' || CAST(o_custkey % 25 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS publish FROM orders)"
_add(
    "jon06_next_close_after",
    lambda s, d: jn.asof(
        _filings(s, d),
        sparse_bars(s, d, "nation").select("ticker", "date", "close"),
        ["ticker"],
        "publish",
        "date",
        ["close"],
        "forward",
        False
    ),
    {"close": 9},
    f"{q.NATION}, {_FIL}, final AS (SELECT o_orderkey, f.ticker, publish, s.date AS matched, s.close FROM fil f ASOF LEFT "
    f"JOIN sparse s ON f.ticker = s.ticker AND f.publish < s.date)",
    ("o_orderkey", "ticker", "publish", "matched")
)
_add(
    "jon09_last_known",
    lambda s, d: jn.asof(
        _filings(s, d),
        sparse_bars(s, d, "nation").select("ticker", "date", "close"),
        ["ticker"],
        "publish",
        "date",
        ["close"],
        "backward",
        True
    ),
    {"close": 9},
    f"{q.NATION}, {_FIL}, final AS (SELECT o_orderkey, f.ticker, publish, s.date AS matched, s.close FROM fil f ASOF LEFT "
    f"JOIN sparse s ON f.ticker = s.ticker AND f.publish >= s.date)",
    ("o_orderkey", "ticker", "publish", "matched")
)


def _converted(s, d):
    """Closes of nations in a common currency: the region's rate is the last known close of its first nation."""
    b = sparse_bars(s, d, "nation").select("ticker", "date", "close")
    region = table(s, d, "nation").select(F.col("n_name").alias("ticker"), F.col("n_regionkey").alias("ccy"))
    fx = b.join(F.broadcast(region), "ticker").where(
        F.col("ticker") == F.concat(F.lit("NATION_"), F.col("ccy").cast("string"))
    ).select("ccy", F.col("date").alias("fx_date"), F.col("close").alias("rate"))
    return jn.asof(b.join(F.broadcast(region), "ticker"), fx, ["ccy"], "date", "fx_date", ["rate"]).withColumn(
        "usd",
        F.when(F.col("ccy") == 0, F.col("close")).otherwise(F.try_divide("close", "rate"))
    )


_add(
    "jon10_currency",
    _converted,
    {"usd": 9},
    f"{q.NATION}, bx AS (SELECT s.ticker, s.date, s.close, n_regionkey AS ccy FROM sparse s "
    f"JOIN nation ON n_name = s.ticker), fx AS (SELECT ccy, date, close AS rate FROM bx "
    f"WHERE ticker = 'NATION_' || CAST(ccy AS VARCHAR)), final AS (SELECT bx.date, bx.ticker, "
    f"CASE WHEN bx.ccy = 0 THEN close ELSE close / rate END AS usd FROM bx ASOF LEFT JOIN fx ON bx.ccy = fx.ccy AND bx.date >= fx.date)",
    _DT
)
_add(
    "jon11_sector_label",
    lambda s, d: sparse_bars(s, d, "nation").join(sectors(s, d), "ticker").groupBy("date", "sector").agg(
        F.sum("volume").alias("volume"),
        F.count("*").alias("n")
    ),
    {"volume": 2},
    f"{q.NATION}, final AS (SELECT date, sector, sum(volume) AS volume, count(*) AS n FROM sparse JOIN sectors USING (ticker) GROUP BY date, sector)",
    ("date", "sector", "n")
)
_add(
    "jon12_shares_to_mcap",
    lambda s, d: bars(s, d).where("mkt_cap is not null").withColumn("mkt_cap", F.col("mkt_cap") / 1e6),
    {"mkt_cap": 5},
    f"{q.BRAND}, final AS (SELECT date, ticker, mkt_cap / 1e6 AS mkt_cap FROM bars WHERE mkt_cap IS NOT NULL)",
    _DT
)
_add(
    "jon15_semi_join",
    lambda s, d: sparse_bars(s, d, "nation").join(
        sectors(s, d).where("sector like '%A%'"),
        "ticker",
        "left_semi"
    ).groupBy("ticker").agg(F.count("*").alias("n")),
    {},
    f"{q.NATION}, final AS (SELECT ticker, count(*) AS n FROM sparse WHERE ticker IN (SELECT ticker FROM sectors WHERE sector LIKE '%A%') "
    f"GROUP BY ticker)",
    ("ticker", "n")
)
_add(
    "jon17_first_within",
    lambda s, d: jn.first_within(
        panel(s, d).where("ret < -0.4").select("ticker", "date", "pos"),
        panel(s, d).where("ret > 0.4").select("ticker", "pos"),
        ["ticker"],
        "pos",
        6
    ),
    {},
    f"{q.PANEL}, e AS (SELECT ticker, date, pos FROM panel WHERE ret < -0.4), st AS (SELECT ticker, pos FROM panel "
    f"WHERE ret > 0.4), final AS (SELECT e.ticker, e.date, CASE WHEN st.pos - e.pos <= 6 THEN st.pos - e.pos END AS delay FROM e ASOF LEFT "
    f"JOIN st ON e.ticker = st.ticker AND e.pos <= st.pos)",
    (*_DT, "delay")
)
_DEL = (
    f"{q.PANEL}, e AS (SELECT ticker, date, pos FROM panel WHERE ret < -0.4), st AS (SELECT ticker, pos FROM panel "
    f"WHERE ret > 0.4), dl AS (SELECT e.ticker, CASE WHEN st.pos - e.pos <= 6 THEN st.pos - e.pos END AS delay FROM e ASOF LEFT "
    f"JOIN st ON e.ticker = st.ticker AND e.pos <= st.pos)"
)
_delays = lambda s, d: jn.first_within(
    panel(s, d).where("ret < -0.4").select("ticker", "date", "pos"),
    panel(s, d).where("ret > 0.4").select("ticker", "pos"),
    ["ticker"],
    "pos",
    6
)
_add(
    "agg31_incidence",
    lambda s, d: _delays(s, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6)))).groupBy("k").agg(
        F.avg(F.coalesce((F.col("delay") <= F.col("k")).cast("double"), F.lit(0.0))).alias("p")
    ),
    {"p": 6},
    f"{_DEL}, final AS (SELECT CAST(k AS INTEGER) AS k, avg(CASE WHEN delay <= k THEN 1.0 ELSE 0.0 END) AS p FROM dl, range(0, 7) r(k) GROUP BY k)",
    ("k",)
)
_add(
    "agg32_delay_quantiles",
    lambda s, d: _delays(s, d).groupBy("ticker").agg(
        F.percentile("delay", F.lit(0.5)).alias("p50"),
        F.percentile("delay", F.lit(0.9)).alias("p90"),
        F.avg(F.col("delay").isNotNull().cast("double")).alias("hit")
    ),
    {"p50": 4, "p90": 4, "hit": 6},
    f"{_DEL}, final AS (SELECT ticker, quantile_cont(delay, 0.5) AS p50, quantile_cont(delay, 0.9) AS p90, avg(CASE WHEN delay IS NOT NULL THEN 1.0 "
    f"ELSE 0.0 END) AS hit FROM dl GROUP BY ticker)",
    ("ticker",)
)
_add(
    "jon20_benchmark",
    lambda s, d: panel(s, d).where("pos % 2 = 0 and fwd is not null").join(
        panel(s, d).where("ticker = 'Brand#1'").select("date", F.col("fwd").alias("bench")),
        "date"
    ).groupBy("ticker").agg(F.avg(F.col("fwd") - F.col("bench")).alias("excess"), F.count("bench").alias("n")),
    {"excess": 5},
    f"{q.PANEL}, bn AS (SELECT date, fwd AS bench FROM panel WHERE ticker = 'Brand#1'), final AS (SELECT ticker, avg(fwd - bench) AS excess, "
    f"count(bench) AS n FROM panel JOIN bn USING (date) WHERE pos % 2 = 0 AND fwd IS NOT NULL GROUP BY ticker)",
    ("ticker", "n")
)
_add(
    "jon21_unknown_codes",
    lambda s, d: member_events(s, d).join(
        sparse_bars(s, d).where("volume > 420").select(F.col("ticker").alias("code")).distinct(),
        "code",
        "left_anti"
    ).groupBy("code").agg(F.count("*").alias("n")),
    {},
    f"{q.BRAND}, final AS (SELECT 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS code, count(*) AS n FROM orders "
    f"WHERE o_orderstatus IN ('O', 'F') AND 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) NOT IN (SELECT ticker FROM sparse WHERE volume > 420) "
    f"GROUP BY 1)",
    ("code", "n")
)

# Sets
_add(
    "set01_ticker_master",
    lambda s, d: (
        lambda a, b: a.withColumn("src", F.lit("customers")).unionByName(b.withColumn("src", F.lit("suppliers"))).groupBy("code").agg(
            F.max(F.col("src") == "customers").alias("in_customers"),
            F.max(F.col("src") == "suppliers").alias("in_suppliers")
        )
    )(
        table(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("code")),
        table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").cast("string").alias("code"))
    ),
    {},
    "u AS (SELECT CAST(c_nationkey AS VARCHAR) AS code, true AS c, false AS s FROM customer UNION ALL "
    "SELECT CAST(s_nationkey AS VARCHAR), false, true FROM supplier WHERE s_acctbal > 5000), final AS (SELECT code, bool_or(c) AS in_customers, "
    "bool_or(s) AS in_suppliers FROM u GROUP BY code)",
    ("code", "in_customers", "in_suppliers")
)
_add(
    "set02_union_all",
    lambda s, d: sparse_bars(s, d).select("ticker", "volume").unionByName(
        sparse_bars(s, d, "nation").select("ticker", "volume")
    ).groupBy("ticker").agg(F.sum("volume").alias("v"), F.count("*").alias("n")),
    {"v": 2},
    f"{q.BRAND}, tn AS (SELECT n_name AS ticker, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS volume FROM lineitem "
    f"JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2), u AS (SELECT ticker, volume FROM sparse "
    f"UNION ALL SELECT ticker, volume FROM tn), final AS (SELECT ticker, sum(volume) AS v, count(*) AS n FROM u GROUP BY ticker)",
    ("ticker", "n")
)
_days = lambda s, d, n: sparse_bars(s, d, "nation").where(F.col("ticker") == n).select("date")
_add(
    "set03_calendar_intersection",
    lambda s, d: _days(s, d, "NATION_1").intersect(_days(s, d, "NATION_2")),
    {},
    f"{q.NATION}, final AS (SELECT date FROM sparse WHERE ticker = 'NATION_1' INTERSECT SELECT date FROM sparse WHERE ticker = 'NATION_2')",
    ("date",)
)
_add(
    "set04_calendar_difference",
    lambda s, d: _days(s, d, "NATION_1").exceptAll(_days(s, d, "NATION_2")),
    {},
    f"{q.NATION}, final AS (SELECT date FROM sparse WHERE ticker = 'NATION_1' EXCEPT SELECT date FROM sparse WHERE ticker = 'NATION_2')",
    ("date",)
)
_add(
    "set05_span_months",
    lambda s, d: _spans(s, d).select(
        "ticker",
        F.explode(F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))).alias("month")
    ).groupBy("month").agg(F.count("*").alias("n")),
    {},
    f"{_SPANS}, m AS (SELECT ticker, CAST(unnest(generate_series(date_trunc('month', start), date_trunc('month', \"end\"), INTERVAL 1 MONTH)) AS "
    f"DATE) AS month FROM spans), final AS (SELECT month, count(*) AS n FROM m GROUP BY month)",
    ("month", "n")
)

# Scalars and filings
_KINDS = (
    "Annual Report {y}/12/31",
    "Interim Results for the six months ended 30 June {y}",
    "Notice of Annual General Meeting",
    "Final Results for the year ended 31 December {y}",
    "Interim Report {y}/06/30"
)


def _seed(s, d):
    o = table(s, d, "orders")
    y = F.year("o_orderdate").cast("string")
    title = F.element_at(
        F.array(*[F.concat(*[F.lit(k.split("{y}")[0]), y, F.lit(k.split("{y}")[1])]) if "{y}" in k else F.lit(k) for k in _KINDS]),
        (F.col("o_orderkey") % 5 + 1).cast("int")
    )
    return o.select(
        "o_orderkey",
        F.lpad((F.col("o_custkey") % 50).cast("string"), 5, "0").alias("stock_code"),
        title.alias("title"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("publish_datetime_hk"),
        F.col("o_totalprice").alias("amount")
    )


_SEED = "seed AS (SELECT o_orderkey, lpad(CAST(o_custkey % 50 AS VARCHAR), 5, '0') AS stock_code, CASE o_orderkey % 5 " + " ".join(
    f"WHEN {i} THEN '" + k.replace("{y}", "' || CAST(year(o_orderdate) AS VARCHAR) || '") + "'" for i,
    k in enumerate(_KINDS)
) + " END AS title, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS publish_datetime_hk, o_totalprice AS amount FROM orders)"
_IDX = (
    f"{_SEED}, idx0 AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'annual_report' WHEN 1 THEN 'interim_results' WHEN 3 THEN 'annual_results' WHEN 4 "
    f"THEN 'interim_report' END AS doc_type, CASE o_orderkey % 5 WHEN 0 THEN make_date(CAST(substr(publish_datetime_hk, 1, 4) AS INTEGER), 12, 31) "
    f"WHEN 1 THEN make_date(CAST(substr(publish_datetime_hk, 1, 4) AS INTEGER), 6, 30) WHEN 3 THEN make_date(CAST(substr(publish_datetime_hk, 1, 4) "
    f"AS INTEGER), 12, 31) WHEN 4 THEN make_date(CAST(substr(publish_datetime_hk, 1, 4) AS INTEGER), 6, 30) END AS period_end "
    f"FROM seed), idx AS (SELECT DISTINCT stock_code, doc_type, publish_datetime_hk, title, period_end, stock_code || '_' || substr(sha1(stock_code "
    f"|| '|' || publish_datetime_hk || '|' || title), 1, 16) AS filing_id, year(period_end) AS fiscal_year, "
    f"CASE WHEN month(period_end) = 6 THEN 'H1' ELSE 'FY' END AS fiscal_half FROM idx0 WHERE doc_type IS NOT NULL)"
)
_index = lambda s, d: fl.index_filings(_seed(s, d).drop("o_orderkey", "amount"))


def _given_seeds(spark, sf_dir):
    """Seed rows of which some give a type, a period, an id or an issuer, and some lack a time."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    when = lambda n, x: F.when(k % n == 0, x)
    return _seed(spark, sf_dir).drop("amount").join(o.select("o_orderkey", "o_orderdate", "o_custkey", "o_orderstatus"), "o_orderkey").select(
        "o_orderkey", F.concat(F.lit("  "), "title", F.lit(" ")).alias("title"), (F.col("o_custkey") % 50).alias("stock_code"),
        F.coalesce(when(7, F.lit("circular")), when(3, F.lit(""))).alias("doc_type"),
        F.when(k % 4 != 0, F.col("publish_datetime_hk")).alias("publish_datetime_hk"), when(8, F.lit("2001-02-03T04:05:06")).alias("publish_datetime"),
        when(12, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("publish_date"), when(9, F.lit("1999-06-30")).alias("period_end"),
        when(10, F.concat(F.lit("id-"), k.cast("string"))).alias("filing_id"), when(14, F.lit("doc")).alias("doc_id"), when(15, F.lit("Own Name")).alias("issuer_name"),
    )


_issuers = lambda s, d: table(s, d, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("stock_code"), F.col("n_name").alias("issuer_name"))
_add(
    "nav01_seed_rows",
    lambda s, d: fl.normalize_seeds(_given_seeds(s, d), "run", _issuers(s, d), "Default Ltd"),
    {},
    f"{_SEED}, g AS (SELECT *, CAST(lpad(stock_code, 5, '0') AS VARCHAR) AS code, CASE WHEN o_orderkey % 7 = 0 THEN 'circular' WHEN o_orderkey % 5 = 0 THEN 'annual_report' "
    f"WHEN o_orderkey % 5 = 1 THEN 'interim_results' WHEN o_orderkey % 5 = 3 THEN 'annual_results' WHEN o_orderkey % 5 = 4 THEN 'interim_report' END AS dt, "
    f"CASE WHEN o_orderkey % 4 <> 0 THEN publish_datetime_hk WHEN o_orderkey % 8 = 0 THEN '2001-02-03T04:05:06' WHEN o_orderkey % 12 = 0 "
    f"THEN substr(publish_datetime_hk, 1, 10) || 'T00:00:00' END AS pub, trim(title) AS t FROM seed), "
    f"p AS (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN DATE '1999-06-30' WHEN o_orderkey % 5 IN (0, 3) THEN make_date(CAST(substr(publish_datetime_hk, 1, 4) AS INTEGER), 12, 31) "
    f"WHEN o_orderkey % 5 IN (1, 4) THEN make_date(CAST(substr(publish_datetime_hk, 1, 4) AS INTEGER), 6, 30) END AS pe FROM g WHERE dt IS NOT NULL AND pub IS NOT NULL), "
    f"i AS (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN 'id-' || o_orderkey ELSE code || '_' || substr(sha1(code || '|' || pub || '|' || t), 1, 16) END AS id FROM p), "
    f"final AS (SELECT id AS filing_id, code AS stock_code, CASE WHEN o_orderkey % 15 = 0 THEN 'Own Name' ELSE coalesce(n_name, 'Default Ltd') END AS issuer_name, "
    f"CASE WHEN o_orderkey % 14 = 0 THEN 'doc' ELSE id END AS doc_id, dt AS doc_type, pe AS period_end, year(pe) AS fiscal_year, "
    f"CASE WHEN pe IS NOT NULL THEN CASE WHEN month(pe) = 6 THEN 'H1' ELSE 'FY' END END AS fiscal_half, pub AS publish_datetime_hk, t AS title "
    f"FROM i LEFT JOIN nation ON lpad(CAST(n_nationkey AS VARCHAR), 5, '0') = code)",
    ("filing_id", "stock_code", "issuer_name", "doc_id", "doc_type", "period_end", "fiscal_year", "fiscal_half", "publish_datetime_hk", "title"),
)
_add(
    "fn01_hk_ticker",
    lambda s, d: table(s, d, "customer").select("c_custkey", fl.hk_ticker(F.col("c_name")).alias("t")),
    {},
    "final AS (SELECT c_custkey, CASE WHEN regexp_replace(c_name, '[^0-9]+', '', 'g') <> '' THEN "
    "CASE WHEN length(regexp_replace(c_name, '[^0-9]+', '', 'g')) >= 4 THEN regexp_replace(c_name, '[^0-9]+', '', 'g') ELSE "
    "lpad(regexp_replace(c_name, '[^0-9]+', '', 'g'), 4, '0') END || '.HK' END AS t FROM customer)",
    ("c_custkey", "t")
)
_add(
    "fn02_doc_type",
    lambda s, d: _seed(s, d).select("o_orderkey", fl.doc_type(F.col("title")).alias("doc_type")),
    {},
    f"{_IDX}, final AS (SELECT o_orderkey, doc_type FROM idx0)",
    ("o_orderkey", "doc_type")
)
_add(
    "fn03_period_end",
    lambda s, d: _seed(s, d).select("o_orderkey", fl.period_end(F.col("title")).alias("period_end")),
    {},
    f"{_IDX}, final AS (SELECT o_orderkey, period_end FROM idx0)",
    ("o_orderkey", "period_end")
)
_add(
    "fn07_filing_id",
    lambda s, d: _seed(s, d).select("o_orderkey", fl.filing_id(F.col("stock_code"), F.col("publish_datetime_hk"), F.col("title")).alias("id")),
    {},
    f"{_SEED}, final AS (SELECT o_orderkey, stock_code || '_' || substr(sha1(stock_code || '|' || publish_datetime_hk || '|' || title), 1, 16) AS "
    f"id FROM seed)",
    ("o_orderkey", "id")
)
_add(
    "flt21_filing_types",
    lambda s, d: _seed(s, d).withColumn("t", fl.doc_type(F.col("title"))).where("t is not null").groupBy("t").agg(F.count("*").alias("n")),
    {},
    f"{_IDX}, final AS (SELECT doc_type AS t, count(*) AS n FROM idx0 WHERE doc_type IS NOT NULL GROUP BY doc_type)",
    ("t", "n")
)
_add(
    "nav02_filing_index",
    _index,
    {},
    f"{_IDX}, final AS (SELECT * FROM idx)",
    ("filing_id", "stock_code", "doc_type", "period_end", "fiscal_year", "fiscal_half")
)


def _pages(s, d):
    """Pages of figures: four lines of amounts per filing."""
    amount = F.format_number(F.round("amount", 0).cast("long"), 0)
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Equity attributable to owners of the Company  "), amount),
        F.concat(F.lit("Cash and bank balances 12 ("), amount, F.lit(")")),
        F.concat(F.lit("Investment properties at fair value "), amount),
        F.lit("Other matters")
    )
    return _seed(s, d).select(F.col("o_orderkey").alias("filing_id"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("page_no"), lines.alias("text"))


_ROUNDED = "floor(amount + 0.5)"
_add(
    "nav03_line_facts",
    lambda s, d: fl.line_facts(_pages(s, d)),
    {"value": 2, "confidence": 2},
    f"{_SEED}, final AS (SELECT o_orderkey AS filing_id, 'equity_attributable_to_owners' AS code, 0 AS line_no, CAST({_ROUNDED} AS DOUBLE) AS "
    f"value, 0.45 AS confidence FROM seed UNION ALL SELECT o_orderkey, 'cash_and_bank_balances', 1, -CAST({_ROUNDED} AS DOUBLE), 0.45 FROM seed)",
    ("filing_id", "code", "line_no")
)
_add(
    "nav04_note_anchors",
    lambda s, d: fl.note_anchors(_pages(s, d)),
    {"confidence": 2},
    f"{_SEED}, final AS (SELECT o_orderkey AS filing_id, g AS note_group, 0.8 AS confidence "
    f"FROM seed, (VALUES ('investment_properties'), ('fair_value')) v(g))",
    ("filing_id", "note_group")
)
_add(
    "nav04_note_facts",
    lambda s, d: fl.note_facts(_pages(s, d)),
    {"value": 2, "confidence": 2},
    f"{_SEED}, final AS (SELECT o_orderkey AS filing_id, 'investment_properties_fair_value_total' AS code, CAST({_ROUNDED} AS DOUBLE) AS value, "
    f"0.35 AS confidence FROM seed)",
    ("filing_id", "code")
)
_add(
    "agg17_fact_pivot",
    lambda s, d: fl.pivot_facts(fl.line_facts(_pages(s, d)), ["equity_attributable_to_owners", "cash_and_bank_balances"]),
    {"equity_attributable_to_owners": 2, "cash_and_bank_balances": 2},
    f"{_SEED}, final AS (SELECT o_orderkey AS filing_id, CAST({_ROUNDED} AS DOUBLE) AS equity_attributable_to_owners, -CAST({_ROUNDED} AS DOUBLE) "
    f"AS cash_and_bank_balances FROM seed)",
    ("filing_id",)
)


def _nav_input(s, d):
    facts = fl.pivot_facts(fl.line_facts(_pages(s, d)), ["equity_attributable_to_owners", "cash_and_bank_balances"])
    o = table(s, d, "orders").select(
        F.col("o_orderkey").alias("filing_id"),
        F.concat(F.lit("NATION_"), (F.col("o_custkey") % 25).cast("string")).alias("ticker"),
        F.to_date("o_orderdate").alias("publish"),
        F.when(F.col("o_custkey") % 3 > 0, (F.col("o_custkey") % 90 + 10).cast("double")).alias("shares")
    )
    priced = jn.asof(o, sparse_bars(s, d, "nation").select("ticker", "date", "close"), ["ticker"], "publish", "date", ["close"], "forward", False)
    return priced.join(facts, "filing_id").select(
        "filing_id",
        "ticker",
        F.col("equity_attributable_to_owners").alias("equity"),
        (-F.col("cash_and_bank_balances") / 10).alias("cash"),
        (F.col("equity_attributable_to_owners") / 4).alias("borrowings_current"),
        F.lit(None).cast("double").alias("borrowings_noncurrent"),
        "shares",
        F.lit(50.0).alias("weighted_shares"),
        F.col("close").alias("price"),
        (F.col("equity_attributable_to_owners") / 2).alias("investment_properties"),
        F.lit(100.0).alias("deferred_tax"),
        F.lit(25.0).alias("nci")
    )


_NAV = (
    f"{q.NATION}, {_FIL}, pr AS (SELECT o_orderkey, s.close AS price FROM fil f ASOF LEFT "
    f"JOIN sparse s ON f.ticker = s.ticker AND f.publish < s.date), nv AS (SELECT o.o_orderkey AS filing_id, floor(o_totalprice + 0.5) AS equity, "
    f"coalesce(CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey % 90 + 10 AS DOUBLE) END, 50) AS shares_used, price FROM orders o "
    f"JOIN pr USING (o_orderkey)), bk AS (SELECT *, equity / shares_used AS nav_per_share, equity / 4 - equity / 10 AS net_debt, price / (equity / "
    f"shares_used) - 1 AS discount FROM nv)"
)
_add(
    "nav11_book_nav",
    lambda s, d: fl.book_nav(_nav_input(s, d)),
    {"nav_per_share": 4, "net_debt": 2, "discount": 6},
    f"{_NAV}, final AS (SELECT * FROM bk)",
    ("filing_id",)
)
_add(
    "nav12_revalued_nav",
    lambda s, d: fl.revalued_nav(fl.book_nav(_nav_input(s, d))),
    {"rnav_equity": 6, "rnav_discount": 6},
    f"{_NAV}, sc(scenario, u, r) AS (VALUES ('rnav_base', 0.0, 0.05), ('rnav_bull', 0.05, 0.10), ('rnav_bear', -0.05, 0.0)), rv AS (SELECT *, "
    f"equity / 2 * u + equity * r AS adj FROM bk CROSS JOIN sc), rq AS (SELECT *, equity + adj - greatest(100.0, adj) * 0.25 - 25 AS rnav_equity "
    f"FROM rv), final AS (SELECT *, rnav_equity / shares_used AS rnav_per_share, price / (rnav_equity / shares_used) - 1 AS rnav_discount FROM rq)",
    ("filing_id", "scenario")
)
_add(
    "nav10_assumptions",
    lambda s, d: fl.assumptions(_index(s, d).select("filing_id")).groupBy("scenario").agg(F.count("*").alias("n"), F.max("dev_reserve").alias("dev")),
    {"dev": 4},
    f"{_IDX}, sc(scenario, dev) AS (VALUES ('rnav_base', 0.05), ('rnav_bull', 0.10), ('rnav_bear', 0.0)), final AS (SELECT scenario, count(*) AS n, "
    f"max(dev) AS dev FROM idx CROSS JOIN sc GROUP BY scenario)",
    ("scenario", "n")
)
_add(
    "jon16_scenarios",
    lambda s, d: fl.assumptions(_index(s, d).select("filing_id", "stock_code")).groupBy("stock_code", "scenario").agg(F.count("*").alias("n")),
    {},
    f"{_IDX}, final AS (SELECT stock_code, scenario, count(*) AS n FROM idx CROSS JOIN (VALUES ('rnav_base'), ('rnav_bull'), ('rnav_bear')) "
    f"v(scenario) GROUP BY stock_code, scenario)",
    ("stock_code", "scenario", "n")
)
_add(
    "fn14_dates",
    lambda s, d: table(s, d, "orders").select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("d"),
        F.last_day("o_orderdate").alias("month_end"),
        F.next_day(F.date_sub(F.to_date("o_orderdate"), 1), "FRI").alias("friday"),
        F.year("o_orderdate").alias("y")
    ),
    {},
    "final AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(CAST(o_orderdate AS DATE) "
    "+ CAST((12 - isodow(o_orderdate)) % 7 AS INTEGER) AS DATE) AS friday, year(o_orderdate) AS y FROM orders)",
    ("o_orderkey", "d", "month_end", "friday", "y")
)
_add(
    "fn15_direction",
    lambda s, d: member_events(s, d).groupBy("code").agg(F.sum(F.when(F.lower(F.trim("direction")).isin("in", "add"), 1).otherwise(-1)).alias("net")),
    {},
    "final AS (SELECT 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS code, CAST(sum(CASE o_orderstatus WHEN 'O' THEN 1 ELSE -1 END) AS BIGINT) "
    "AS net FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1)",
    ("code", "net")
)
