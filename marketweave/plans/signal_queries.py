"""Registered price and volume signals over weekly bars by brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.signals import compute
from ..sources.bars import bars
from . import sqlkit as q

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(number: int, name: str, steps: list[str] | None, value: str = "", digits: int = 4, scale: float = 1.0, **parameters) -> None:
    key = f"sig{number:02d}_{name.lower()}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = compute(bars(spark, sf_dir), name, **parameters)
        return out.where("value is not null").select("date", "ticker", F.round(F.col("value") * scale, digits).alias("value"))

    QUERIES[key] = run
    if steps is not None:
        ORACLE_SQL[key] = q.value_query(steps, value, digits)


_TP = "(high + low + close) / 3"
_PAD = [f"{q.ffill('close')} AS p", f"{q.change('p')} AS r"]
_AMOUNT = f"{_TP} * volume AS amt"
_SAFE = lambda a, b: f"(CAST({a} AS DOUBLE) / CASE WHEN abs({b}) > 1e-12 THEN {b} END)"
_VWAP = lambda n: [f"{_TP} * volume AS pv", f"{_SAFE(q.full('sum', 'pv', n), q.full('sum', 'volume', n))} AS vw"]
_YES = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"

_add(1, "size", [], "-ln(CASE WHEN mkt_cap > 0 THEN mkt_cap END)")
_add(
    2,
    "on_minus_id",
    [f"ln({q.div('open', q.ref('close'))}) AS o, ln({q.div('close', 'open')}) AS i"],
    f"-((exp({q.full('sum', 'o', 4)}) - 1) - (exp({q.full('sum', 'i', 4)}) - 1))",
    3,
    lookback=4
)
_add(3, "rsi", None)
ORACLE_SQL["sig03_rsi"] = q.rsi_query(14)
_add(4, "overnight_mom", [f"{q.div('open', q.ref('close'))} AS x"], f"-({q.full('product', 'x', 21)} - 1)")
_add(5, "intraday_mom", [f"{q.div('close', 'open')} AS x"], f"-({q.full('product', 'x', 21)} - 1)")
_add(
    6,
    "trend_annret_r2",
    [f"{q.ffill('close')} AS p", f"ln({q.ref('p', 21)}) AS y, CAST(pos AS DOUBLE) AS t"],
    f"CASE WHEN count(y) {q.w(63)} = 63 THEN (exp(regr_slope(y, t) {q.w(63)} * 52) - 1) * regr_r2(y, t) {q.w(63)} END",
    lookback=63,
    ann_factor=52
)
_add(7, "mom_ret", [], f"{q.div('close', q.ref('close', 21))} - 1")
_add(8, "mom_12_1", [], f"{q.div(q.ref('close', 21), q.ref('close', 252))} - 1")
_add(9, "ma_diff", [], f"-1 * {q.div('close', q.ref('close', 20))} - 1", sign=-1)
_add(10, "ma_angle", [f"{q.ma('close', 20)} AS m"], f"degrees(atan(m - {q.ref('m')}))")
_add(
    11,
    "vol_price_rank_cov",
    [f"{q.ts_rank('close', 10)} AS c, {q.ts_rank('volume', 10)} AS v", f"{q.cov('c', 'v', 10)} AS k"],
    "-k",
    outer_rank=False
)
_add(12, "vol_price_corr", [], f"-({q.corr('close', 'volume', 20)})")
_add(
    13,
    "first_order_divergence",
    [f"volume - {q.ref('volume')} AS dv, {q.div('close', 'open')} - 1 AS r", f"{q.ts_rank('dv', 10)} AS a, {q.ts_rank('r', 10)} AS b"],
    f"-({q.corr('a', 'b', 10)})"
)
_add(
    14,
    "vol_amp_comove",
    [f"volume - {q.ref('volume')} AS dv, {q.div('high', 'low')} - 1 AS r", f"{q.ts_rank('dv', 10)} AS a, {q.ts_rank('r', 10)} AS b"],
    q.corr("a", "b", 10)
)
_add(15, "mom_second_order", None)
_value = lambda: "SELECT date, ticker, round(value, 4) + 0.0 AS value FROM final WHERE value IS NOT NULL"
_DIST = (
    f"x0 AS (SELECT date, ticker, close, {q.ma('close', 20)} AS m FROM bars), x1 AS (SELECT *, (close - m) / nullif(m, 0) AS x "
    f"FROM x0), x2 AS (SELECT *, x - {q.ref('x', 5)} AS d FROM x1)"
)
ORACLE_SQL["sig15_mom_second_order"] = f"WITH RECURSIVE {q.BRAND}, {_DIST}, {q.ewm('final', 'x2', 'd', 2 / 11, 1, 'value')} {_value()}"
_add(16, "mom_term_spread", [], f"{q.change('close', 20)} - {q.change('close', 60)}")
_add(17, "amount_std", [_AMOUNT], f"-({q.std('amt', 20)})", 1)
_add(18, "volume_std", [], f"-({q.std('volume', 20)})")
_add(19, "turnover_change", [f"{_SAFE('volume', 'shares_outstanding')} AS t"], _SAFE(f"({q.ma('t', 20)})", f"({q.ma('t', 60)})"))
_add(20, "bull_bear_total", [f"{_SAFE('close - low', '(high - close)')} AS z"], f"-({q.full('sum', 'z', 20)})", 2)
_add(21, "bull_bear_change", None)
_FLOW = f"z0 AS (SELECT date, ticker, volume * {_SAFE('(2 * close - high - low)', '(high - low)')} AS z FROM bars)"
_TWO = f"{q.ewm('za', 'z0', 'z', 2 / 11, 1, 'a')}, {q.ewm('zb', 'za', 'z', 2 / 31, 1, 'b')}, final AS (SELECT date, ticker, a - b AS value FROM zb)"
ORACLE_SQL["sig21_bull_bear_change"] = f"WITH RECURSIVE {q.BRAND}, {_FLOW}, {_TWO} {_value()}"
_add(22, "liq_turn_avg_3M", [f"{_SAFE('volume', 'shares_outstanding')} AS t"], q.ma("t", 63), 7)
_add(23, "liq_turn_std_3M", [f"{_SAFE('volume', 'shares_outstanding')} AS t"], q.std("t", 63), 7)
_add(24, "liq_vstd_3M", [*_PAD, _AMOUNT], _SAFE(f"({q.ma('amt', 63)})", f"({q.std('r', 63)})"), 1)
_add(25, "liq_amihud_avg_3M", [*_PAD, _AMOUNT, f"{_SAFE('abs(r)', 'amt')} AS i"], f"1e6 * ({q.ma('i', 63)})", 5, 1e6)
_add(26, "liq_amihud_std_3M", [f"{q.change('close')} AS r, {_AMOUNT}", f"{_SAFE('abs(r)', 'amt')} AS i"], f"1e6 * ({q.std('i', 63)})", 5, 1e6)
_add(
    27,
    "fourline_open_score",
    [
        ", ".join(f"{q.ma('close', n)} AS m{n}" for n in (5, 10, 20, 30, 50, 120, 250)) + f", {q.ma('volume', 5)} AS vm, {q.ref('close')} AS c1",
        f"CASE WHEN m30 IS NOT NULL THEN {q.div('(greatest(m5, m10, m20, m30) - least(m5, m10, m20, m30))', 'close')} END AS spread, " + " + ".join(
            _YES(f"m{n} > {q.ref(f'm{n}', 5)}") for n in (5, 10, 20, 30)
        ) + f" AS ups, {_YES('m5 > m10 AND m10 > m20 AND m20 > m30')} AS bull, {q.div('volume', q.ref('vm'))} AS vr, {q.full('max', 'c1', 20)} AS prior, " + ", ".join(
            f"{_YES(f'm{n} > {q.ref(f"m{n}", 20)}')} AS up{n}, {_YES(f'm{n} < {q.ref(f"m{n}", 20)}')} AS dn{n}" for n in (50, 120)
        ),
        f"{_YES(f'spread <= 0.3 AND ups >= 3 AND {q.ref("spread", 10)} - spread >= 0.003')} AS knot",
        f"max(knot) {q.w(10)} AS knotted, min(bull) {q.w(5)} AS fresh, CASE WHEN close < m50 AND (dn50 = 1 OR dn120 = 1 OR m50 < m120) THEN -10.0 "
        f"WHEN close > m50 AND m50 > m120 AND m120 > m250 AND up50 = 1 AND up120 = 1 THEN 25.0 ELSE 10.0 END AS trend",
    ],
    f"CASE WHEN bull = 1 AND fresh = 0 AND knotted = 1 AND vr >= 1.1 THEN least(greatest(20 * least(greatest((0.3 - spread) / 0.3, 0), 1) + 25 * "
    f"least(greatest((m5 - m30) / close / 0.01, 0), 1) + trend + 20 * least(greatest((vr - 1.1) / (5.0 - 1.1), 0), 1) + {_YES('close > m30')} * 5 + "
    f"{_YES('close > prior')} * 5, 0), 100) ELSE 0.0 END",
    spread_eps=0.3,
    vr_thresh=1.1
)
_add(
    28,
    "vwap_dev_x_volratio_x_mom",
    [*_VWAP(10), f"{q.ma('volume', 20)} AS vm, {q.ma('close', 20)} AS cm"],
    f"({_SAFE('vw', 'close')} - 1) * {_SAFE('volume', 'vm')} * ({_SAFE('close', 'cm')} - 1)"
)
_add(29, "vol_price_combination", [*_VWAP(20), f"{q.ma('volume', 20)} AS vm"], _YES("volume > 1.5 * vm AND close > vw"))
_add(
    30,
    "volume_breakout",
    [f"{q.ma('volume', 60)} AS vm, {q.full('max', 'high', 60)} AS hh, {q.ma('volume', 5)} AS v5", f"{q.ref('v5')} AS v5p"],
    _YES("volume > 1.5 * vm AND close > hh AND volume > 1.2 * v5p")
)
_add(31, "vol_std_3M", _PAD, f"-({q.std('r', 63)})")
_add(32, "vol_highlow_avg_3M", [f"{_SAFE('high', 'low')} AS x"], f"-({q.ma('x', 63)})")
_add(33, "vol_highlow_std_3M", [f"{_SAFE('high', 'low')} AS x"], f"-({q.std('x', 63)})")
_add(
    34,
    "vol_upshadow_std_3M",
    [f"greatest({_SAFE('high - greatest(open, close)', 'high')}, CASE WHEN high IS NOT NULL THEN 0.0 END) AS x"],
    f"-({q.std('x', 63)})"
)
_add(
    35,
    "vol_downshadow_std_3M",
    [f"greatest({_SAFE('least(open, close) - low', 'low')}, CASE WHEN low IS NOT NULL THEN 0.0 END) AS x"],
    f"-({q.std('x', 63)})"
)
_add(
    36,
    "vol_w_upshadow_std_3M",
    [f"greatest({_SAFE('high - close', 'high')}, CASE WHEN high IS NOT NULL THEN 0.0 END) AS x"],
    f"-({q.std('x', 63)})"
)
_add(37, "vol_w_downshadow_std_3M", [f"greatest({_SAFE('close - low', 'low')}, CASE WHEN low IS NOT NULL THEN 0.0 END) AS x"], f"-({q.std('x', 63)})")
