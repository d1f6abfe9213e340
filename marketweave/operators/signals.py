"""Price and volume signals: each adds a column `value` to bars on the dense date grid, using windows per ticker.

A window with a missing value in it is null. Signals are registered under a name with default parameters and the
columns that they need; compute() merges parameters over the defaults.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import change, cs_rank, div, ffill, full, ma, ref, rolling_corr, rolling_cov, staged, std, total, trailing, ts_rank
from .blocks import Scan, scan


@dataclass(frozen=True)
class Signal:
    name: str
    run: Callable[..., DataFrame]
    description: str
    requires: tuple[str, ...]
    defaults: dict = field(default_factory=dict)


SIGNALS: dict[str, Signal] = {}


def register_signal(name: str, description: str, requires: tuple[str, ...], **defaults):
    """Registers fn(df, **parameters) -> df with `value`; a name can be taken once."""
    if name in SIGNALS:
        raise ValueError(f"signal {name} is registered already")

    def add(fn):
        SIGNALS[name] = Signal(name, fn, description, requires, defaults)
        return fn

    return add


def list_signals() -> list[str]:
    return sorted(SIGNALS)


def compute(df: DataFrame, name: str, **parameters) -> DataFrame:
    """bars with the signal's column `value`; unknown names, unknown parameters and missing columns are errors."""
    if name not in SIGNALS:
        raise KeyError(f"unknown signal {name}; known: {', '.join(list_signals())}")
    signal = SIGNALS[name]
    if odd := parameters.keys() - signal.defaults.keys():
        raise TypeError(f"{name} has no parameter {', '.join(sorted(odd))}")
    if missing := [c for c in signal.requires if c not in df.columns]:
        raise ValueError(f"{name} needs columns {missing}")
    return signal.run(df, **{**signal.defaults, **parameters})


def ewm(
    df: DataFrame,
    x: str,
    name: str,
    span: float | None = None,
    alpha: float | None = None,
    halflife: float | None = None,
    least: int = 1,
    key: tuple[str, ...] = ("ticker",),
    order: str = "date"
) -> DataFrame:
    """Exponential mean without adjustment along each key; gaps go on decaying."""
    decay = alpha if alpha is not None else 2 / (span + 1) if span is not None else 1 - math.exp(-math.log(2) / halflife)
    return scan(df, list(key), order, [x], {name: "double"}, _means(decay, least, x, name))


def _means(alpha: float, least: int, x: str, name: str) -> Scan:
    """State: the mean (null before a value), the weight left to it, and the values so far. Between two values a block is an affine map of the mean."""
    f = 1 - alpha

    def first_of(v: np.ndarray) -> int:
        known = ~np.isnan(v)
        return int(known.argmax()) if known.any() else len(v)

    def at_first(state: list, gap: int, value: float) -> float:
        mean, weight = state[0], state[1] * f ** (gap + 1)
        return value if mean is None else (weight * mean + alpha * value) / (weight + alpha)

    def along(v: np.ndarray) -> np.ndarray:
        return pd.Series(v).ewm(alpha=alpha, adjust=False).mean().to_numpy()

    def summarise(c: dict) -> dict:
        v = c[x].astype(float)
        i = first_of(v)
        if i == len(v):
            return {"rows": i, "n": 0}
        rest, unit = v[i:].copy(), np.where(np.isnan(v[i:]), np.nan, 0.0)
        rest[0], unit[0] = 0.0, 1.0
        known = np.flatnonzero(~np.isnan(v))
        return {
            "rows": len(v), "n": len(known), "gap": i, "first": float(v[i]), "times": float(along(unit)[-1]), "plus": float(along(rest)[-1]),
            "tail": int(len(v) - 1 - known[-1]),
        }

    def fold(state: list, s: dict) -> list:
        if not s["n"]:
            return [state[0], state[1] * f ** s["rows"] if state[0] is not None else 1.0, state[2]]
        return [s["times"] * at_first(state, s["gap"], s["first"]) + s["plus"], f ** s["tail"], state[2] + s["n"]]

    def finish(c: dict, state: list) -> dict:
        v = c[x].astype(float)
        i, out = first_of(v), np.full(len(v), np.nan if state[0] is None else state[0])
        if i < len(v):
            rest = v[i:].copy()
            rest[0] = at_first(state, i, v[i])
            out[i:] = along(rest)
        return {name: np.where(state[2] + np.cumsum(~np.isnan(v)) >= least, out, np.nan)}

    return Scan([None, 1.0, 0], summarise, fold, finish)


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def positive(x: str) -> Column:
    return F.when(F.col(x) > 0, F.col(x))


@register_signal("size", "log market capitalisation", ("mkt_cap",), sign=-1, use_cs_rank=False)
def size(df, sign, use_cs_rank):
    df = df.withColumn("_ln", sign * F.ln(positive("mkt_cap")))
    return df.withColumn("value", cs_rank("_ln") if use_cs_rank else F.col("_ln"))


@register_signal("on_minus_id", "compound overnight less compound intraday return", ("open", "close"), lookback=21, sign=-1)
def on_minus_id(df, lookback, sign):
    df = staged(df, _on=F.ln(div("open", ref("close"))), _id=F.ln(div("close", "open")))
    return df.withColumn("value", sign * ((F.exp(total("_on", lookback)) - 1) - (F.exp(total("_id", lookback)) - 1)))


@register_signal("rsi", "relative strength index with Wilder's smoothing", ("close",), lookback=14, sign=1)
def rsi(df, lookback, sign):
    step = F.col("_step")
    df = staged(df, _step=F.col("close") - ref("close"), _up=F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), _down=F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))))
    df = ewm(ewm(df, "_up", "_gain", alpha=1 / lookback, least=lookback), "_down", "_loss", alpha=1 / lookback, least=lookback)
    value = F.when(F.col("_loss") != 0, 100 - 100 / (1 + F.col("_gain") / F.col("_loss"))).when((F.col("_loss") == 0) & (F.col("_gain") > 0), 100.0)
    return df.withColumn("value", sign * value)


def _product(x: Column, n: int, df: DataFrame, sign: int) -> DataFrame:
    return df.withColumn("_x", x).withColumn("value", sign * (full(F.product, "_x", n) - 1))


@register_signal("overnight_mom", "product of overnight returns", ("open", "close"), lookback=21, sign=-1)
def overnight_mom(df, lookback, sign):
    return _product(div("open", ref("close")), lookback, df, sign)


@register_signal("intraday_mom", "product of intraday returns", ("open", "close"), lookback=21, sign=-1)
def intraday_mom(df, lookback, sign):
    return _product(div("close", "open"), lookback, df, sign)


@register_signal("trend_annret_r2", "annualised log trend times its R2", ("close",), lookback=252, ann_factor=252, skip=21)
def trend_annret_r2(df, lookback, ann_factor, skip):
    df = staged(df, _p=ffill("close"), _y=F.ln(ref("_p", skip)), _t=F.col("pos").cast("double"))
    w = trailing(lookback)
    slope, r2 = F.regr_slope("_y", "_t").over(w), F.regr_r2("_y", "_t").over(w)
    return df.withColumn("value", F.when(F.count("_y").over(w) == lookback, (F.exp(slope * ann_factor) - 1) * r2))


@register_signal("mom_ret", "return over lookback rows, skip rows ago", ("close",), lookback=21, skip=0, sign=1)
def mom_ret(df, lookback, skip, sign):
    return df.withColumn("value", sign * (div(ref("close", skip), ref("close", skip + lookback)) - 1))


@register_signal("mom_12_1", "return of a year less the last month", ("close",), lookback=252, skip=21)
def mom_12_1(df, lookback, skip):
    return df.withColumn("value", div(ref("close", skip), ref("close", lookback)) - 1)


@register_signal("ma_diff", "signed price ratio less one", ("close",), lookback=20, skip=0, sign=1)
def ma_diff(df, lookback, skip, sign):
    return df.withColumn("value", sign * div(ref("close", skip), ref("close", skip + lookback)) - 1)


@register_signal("ma_angle", "angle of the moving average's last step", ("close",), lookback=20, skip=0, sign=1)
def ma_angle(df, lookback, skip, sign):
    df = staged(df, _p=ref("close", skip), _m=ma("_p", lookback))
    return df.withColumn("value", sign * F.degrees(F.atan(F.col("_m") - ref("_m"))))


@register_signal("vol_price_rank_cov", "covariance of the ranks of price and volume", ("close", "volume"), window=10, outer_rank=True, sign=1)
def vol_price_rank_cov(df, window, outer_rank, sign):
    df = staged(df, _c=ts_rank("close", window), _v=ts_rank("volume", window), _k=rolling_cov("_c", "_v", window))
    return df.withColumn("value", -sign * (cs_rank("_k") if outer_rank else F.col("_k")))


@register_signal("vol_price_corr", "correlation of price and volume", ("close", "volume"), window=20, sign=1)
def vol_price_corr(df, window, sign):
    return df.withColumn("value", -sign * rolling_corr("close", "volume", window))


def _step(x: str) -> Column:
    return F.col(x) - ref(x)


@register_signal(
    "first_order_divergence",
    "correlation of the ranks of volume change and intraday return",
    ("open", "close", "volume"),
    window=10,
    sign=1
)
def first_order_divergence(df, window, sign):
    df = staged(df, _dv=_step("volume"), _r=div("close", "open") - 1, _a=ts_rank("_dv", window), _b=ts_rank("_r", window))
    return df.withColumn("value", -sign * rolling_corr("_a", "_b", window))


@register_signal(
    "vol_amp_comove",
    "correlation of the ranks of volume change and day range",
    ("high", "low", "volume"),
    window=10,
    negate=False,
    sign=1
)
def vol_amp_comove(df, window, negate, sign):
    df = staged(df, _dv=_step("volume"), _r=div("high", "low") - 1, _a=ts_rank("_dv", window), _b=ts_rank("_r", window))
    return df.withColumn("value", (-sign if negate else sign) * rolling_corr("_a", "_b", window))


@register_signal("mom_second_order", "smoothed change of the distance to the moving average", ("close",), ma_window=20, lag=5, span=10)
def mom_second_order(df, ma_window, lag, span):
    df = staged(df, _m=ma("close", ma_window), _x=div(F.col("close") - F.col("_m"), "_m"), _d=F.col("_x") - ref("_x", lag))
    return ewm(df, "_d", "value", span=span)


@register_signal("mom_term_spread", "short less long return", ("close",), short=20, long=60)
def mom_term_spread(df, short, long):
    return df.withColumn("value", change("close", short) - change("close", long))


@register_signal("amount_std", "deviation of typical price times volume", ("high", "low", "close", "volume"), window=20, sign=1)
def amount_std(df, window, sign):
    return df.withColumn("_a", typical() * F.col("volume")).withColumn("value", -sign * std("_a", window))


@register_signal("volume_std", "deviation of volume", ("volume",), window=20, sign=1)
def volume_std(df, window, sign):
    return df.withColumn("value", -sign * std("volume", window))


def share_turnover(lot: float = 1.0) -> Column:
    return safe_div(F.col("volume") * lot, F.col("shares_outstanding"))


def safe_div(a: Column, b: Column) -> Column:
    return div(a, F.when(F.abs(b) > 1e-12, b))


def rolling_vwap(df: DataFrame, n: int, name: str) -> DataFrame:
    df = staged(df, _pv=typical() * F.col("volume"), _pvn=total("_pv", n), _vn=total("volume", n))
    return df.withColumn(name, safe_div(F.col("_pvn"), F.col("_vn")))


@register_signal(
    "turnover_change",
    "short over long mean share turnover",
    ("volume", "shares_outstanding"),
    window1=20,
    window2=60,
    lot_size=1,
    sign=1
)
def turnover_change(df, window1, window2, lot_size, sign):
    df = df.withColumn("_t", share_turnover(lot_size))
    return df.withColumn("value", sign * safe_div(ma("_t", window1), ma("_t", window2)))


@register_signal("bull_bear_total", "sum of (close - low) / (high - close)", ("high", "low", "close"), window=20, sign=1)
def bull_bear_total(df, window, sign):
    df = df.withColumn("_z", safe_div(F.col("close") - F.col("low"), F.col("high") - F.col("close")))
    return df.withColumn("value", -sign * total("_z", window))


@register_signal("bull_bear_change", "short less long smoothed money flow", ("high", "low", "close", "volume"), window1=10, window2=30, sign=1)
def bull_bear_change(df, window1, window2, sign):
    df = df.withColumn("_z", F.col("volume") * safe_div(2 * F.col("close") - F.col("high") - F.col("low"), F.col("high") - F.col("low")))
    df = ewm(ewm(df, "_z", "_s", span=window1), "_z", "_l", span=window2)
    return df.withColumn("value", sign * (F.col("_s") - F.col("_l")))


@register_signal("liq_turn_avg_3M", "mean share turnover", ("volume", "shares_outstanding"), lookback=63, lot_size=1, sign=1)
def liq_turn_avg(df, lookback, lot_size, sign):
    return df.withColumn("_t", share_turnover(lot_size)).withColumn("value", sign * ma("_t", lookback))


@register_signal("liq_turn_std_3M", "deviation of share turnover", ("volume", "shares_outstanding"), lookback=63, lot_size=1, sign=1)
def liq_turn_std(df, lookback, lot_size, sign):
    return df.withColumn("_t", share_turnover(lot_size)).withColumn("value", sign * std("_t", lookback))


def _amount(df: DataFrame, lookback: int, mode: str) -> DataFrame:
    if mode == "tp":
        return df.withColumn("_a", typical() * F.col("volume"))
    if mode == "rvwap":
        return rolling_vwap(df, lookback, "_vwap").withColumn("_a", F.col("_vwap") * F.col("volume"))
    raise ValueError("amount_mode is tp or rvwap")


def _padded_return(df: DataFrame) -> DataFrame:
    return staged(df, _p=ffill("close"), _r=change("_p"))


@register_signal(
    "liq_vstd_3M",
    "mean amount over the deviation of returns",
    ("high", "low", "close", "volume"),
    lookback=63,
    amount_mode="tp",
    sign=1
)
def liq_vstd(df, lookback, amount_mode, sign):
    df = staged(_amount(_padded_return(df), lookback, amount_mode), _s=std("_r", lookback))
    return df.withColumn("value", sign * safe_div(ma("_a", lookback), F.col("_s")))


@register_signal(
    "liq_amihud_avg_3M",
    "mean of absolute return over amount",
    ("high", "low", "close", "volume"),
    lookback=63,
    amount_mode="tp",
    use_abs=True,
    sign=1
)
def liq_amihud_avg(df, lookback, amount_mode, use_abs, sign):
    df = _amount(_padded_return(df), lookback, amount_mode)
    df = df.withColumn("_i", safe_div(F.abs("_r") if use_abs else F.col("_r"), F.col("_a")))
    return df.withColumn("value", sign * ma("_i", lookback))


@register_signal(
    "liq_amihud_std_3M",
    "deviation of absolute unpadded return over amount",
    ("high", "low", "close", "volume"),
    lookback=63,
    amount_mode="tp",
    use_abs=True,
    sign=1
)
def liq_amihud_std(df, lookback, amount_mode, use_abs, sign):
    df = _amount(df.withColumn("_r", change("close")), lookback, amount_mode)
    df = df.withColumn("_i", safe_div(F.abs("_r") if use_abs else F.col("_r"), F.col("_a")))
    return df.withColumn("value", sign * std("_i", lookback))


def _yes(condition: Column) -> Column:
    """A comparison with a missing value does not hold."""
    return F.coalesce(condition, F.lit(False))


def _clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


@register_signal(
    "fourline_open_score", "0-100: four moving averages open into a bull stack out of a knot, on rising volume", ("close", "volume"),
    slope_L=5, adh_contract_L=10, spread_eps=0.012, spread_contract_min=0.003, D_open=5, D_pre=10, vr_N=5, vr_thresh=2.0, vr_full=5.0,
    w_adh=20.0, w_open=25.0, w_vol=20.0, w_px=10.0, gap_full=0.01, trend_L=20, strong_score=25.0, neutral_score=10.0, rebound_score=-10.0,
    breakout_L=20, trade_threshold=70.0, output="score",
)
def fourline_open_score(df, **p):
    m = {n: f"_m{n}" for n in (5, 10, 20, 30, 50, 120, 250)}
    fast = [F.col(m[n]) for n in (5, 10, 20, 30)]
    known = fast[3].isNotNull() & fast[0].isNotNull() & fast[1].isNotNull() & fast[2].isNotNull()
    df = staged(df, **{name: ma("close", n) for n, name in m.items()})
    rising = lambda n, k: _yes(F.col(m[n]) > ref(m[n], k))
    df = staged(
        df,
        _spread=F.when(known, div(F.greatest(*fast) - F.least(*fast), "close")),
        _ups=sum((rising(n, p["slope_L"]).cast("int") for n in (5, 10, 20, 30)), F.lit(0)),
        _knot=_yes(
            (F.col("_spread") <= p["spread_eps"]) & (F.col("_ups") >= 3) & (
                ref("_spread", p["adh_contract_L"]) - F.col("_spread") >= p["spread_contract_min"]
            )
        ).cast("int"),
        _bull=_yes((fast[0] > fast[1]) & (fast[1] > fast[2]) & (fast[2] > fast[3])).cast("int"),
        _fresh=F.min("_bull").over(trailing(p["D_open"])) == 0,
        _knotted=F.max("_knot").over(trailing(p["D_pre"])) == 1,
        _vm=ma("volume", p["vr_N"]),
        _vr=div("volume", ref("_vm")),
    )
    df = staged(df, _c1=ref("close"), _prior=full(F.max, "_c1", p["breakout_L"]))
    close, m50, m120, m250 = F.col("close"), F.col(m[50]), F.col(m[120]), F.col(m[250])
    falling = lambda n: _yes(F.col(m[n]) < ref(m[n], p["trend_L"]))
    strong = _yes((close > m50) & (m50 > m120) & (m120 > m250)) & rising(50, p["trend_L"]) & rising(120, p["trend_L"])
    rebound = _yes(close < m50) & (falling(50) | falling(120) | _yes(m50 < m120))
    trend = F.when(rebound, p["rebound_score"]).when(strong, p["strong_score"]).otherwise(p["neutral_score"])
    gap = div(fast[0] - fast[3], "close")
    score = (
        p["w_adh"] * _clip((p["spread_eps"] - F.col("_spread")) / p["spread_eps"], 0.0, 1.0)
        + p["w_open"] * _clip(gap / p["gap_full"], 0.0, 1.0)
        + F.col("_trend")
        + p["w_vol"] * _clip((F.col("_vr") - p["vr_thresh"]) / max(p["vr_full"] - p["vr_thresh"], 1e-9), 0.0, 1.0)
        + p["w_px"] / 2 * _yes(close > fast[3]).cast("int") + p["w_px"] / 2 * _yes(close > F.col("_prior")).cast("int")
    )
    gate = (F.col("_bull") == 1) & F.col("_fresh") & F.col("_knotted") & _yes(F.col("_vr") >= p["vr_thresh"])
    df = df.withColumn("_trend", trend)
    df = df.withColumn("value", F.when(gate, _clip(score, 0.0, 100.0)).otherwise(0.0))
    return df.withColumn("value", (F.col("value") >= p["trade_threshold"]).cast("double")) if p["output"] == "trade" else df


@register_signal(
    "vwap_dev_x_volratio_x_mom",
    "distance to the mean price times volume ratio times momentum",
    ("high", "low", "close", "volume"),
    vwap_window=10,
    vol_window=20,
    mom_window=20,
    sign=1
)
def vwap_dev_x_volratio_x_mom(df, vwap_window, vol_window, mom_window, sign):
    df = staged(rolling_vwap(df, vwap_window, "_w"), _vm=ma("volume", vol_window), _cm=ma("close", mom_window))
    value = (safe_div(F.col("_w"), F.col("close")) - 1) * safe_div(F.col("volume"), F.col("_vm")) * (safe_div(F.col("close"), F.col("_cm")) - 1)
    return df.withColumn("value", sign * value)


@register_signal(
    "vol_price_combination",
    "1 on high volume above the mean price, else 0",
    ("high", "low", "close", "volume"),
    vol_window=20,
    vwap_window=20,
    vol_mult=1.5,
    sign=1
)
def vol_price_combination(df, vol_window, vwap_window, vol_mult, sign):
    df = rolling_vwap(df, vwap_window, "_w").withColumn("_vm", ma("volume", vol_window))
    return df.withColumn("value", sign * _yes((F.col("volume") > vol_mult * F.col("_vm")) & (F.col("close") > F.col("_w"))).cast("double"))


@register_signal(
    "volume_breakout",
    "1 on high volume above the highest high, else 0",
    ("high", "close", "volume"),
    vol_window=60,
    hhv_window=60,
    vol_mult=1.5,
    use_confirm=True,
    confirm_window=5,
    confirm_mult=1.2,
    sign=1
)
def volume_breakout(df, vol_window, hhv_window, vol_mult, use_confirm, confirm_window, confirm_mult, sign):
    df = staged(df, _vm=ma("volume", vol_window), _hh=full(F.max, "high", hhv_window), _v5=ma("volume", confirm_window), _v5p=ref("_v5"))
    hit = _yes((F.col("volume") > vol_mult * F.col("_vm")) & (F.col("close") > F.col("_hh")))
    if use_confirm:
        hit = hit & _yes(F.col("volume") > confirm_mult * F.col("_v5p"))
    return df.withColumn("value", sign * hit.cast("double"))


def _volatility(name: str, description: str, requires: tuple[str, ...], x, agg=F.stddev_samp) -> None:
    """Registers sign * agg(x) over lookback rows."""

    @register_signal(name, description, requires, lookback=63, sign=-1)
    def run(df, lookback, sign):
        return staged(x(df), value=sign * full(agg, "_x", lookback))


def _shadow(top: Column, bottom: Column, base: str):
    x = safe_div(top - bottom, F.col(base))
    return lambda df: df.withColumn("_x", F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))))


def _both(pick, a: str, b: str) -> Column:
    """pick of two columns, null if either is."""
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), pick(F.col(a), F.col(b)))


def _register_volatility() -> None:
    _volatility("vol_std_3M", "deviation of padded returns", ("close",), lambda df: staged(_padded_return(df), _x=F.col("_r")))
    ratio = lambda df: df.withColumn("_x", safe_div(F.col("high"), F.col("low")))
    _volatility("vol_highlow_avg_3M", "mean of high over low", ("high", "low"), ratio, F.avg)
    _volatility("vol_highlow_std_3M", "deviation of high over low", ("high", "low"), ratio)
    _volatility(
        "vol_upshadow_std_3M",
        "deviation of the upper shadow",
        ("open", "close", "high"),
        lambda df: _shadow(F.col("high"), _both(F.greatest, "open", "close"), "high")(df)
    )
    _volatility(
        "vol_downshadow_std_3M",
        "deviation of the lower shadow",
        ("open", "close", "low"),
        lambda df: _shadow(_both(F.least, "open", "close"), F.col("low"), "low")(df)
    )
    _volatility(
        "vol_w_upshadow_std_3M",
        "deviation of the distance from close up to high",
        ("close", "high"),
        lambda df: _shadow(F.col("high"), F.col("close"), "high")(df)
    )
    _volatility(
        "vol_w_downshadow_std_3M",
        "deviation of the distance from low up to close",
        ("close", "low"),
        lambda df: _shadow(F.col("close"), F.col("low"), "low")(df)
    )


_register_volatility()
