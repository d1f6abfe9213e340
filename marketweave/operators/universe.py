"""Point-in-time universe: eligibility filters, execution masks, setups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import div, full, ma, ref, staged, trailing


def holds(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


@dataclass(frozen=True)
class UniverseConfig:
    """Limits of the investable universe; None switches a filter off."""

    price_window: int = 21
    min_price: float | None = None
    mcap_window: int = 21
    min_mcap: float | None = None
    max_mcap: float | None = None
    turnover_window: int = 20
    min_turnover: float | None = None
    min_age: int = 63


def price_floor(window: int, low: float, price: str = "close") -> Column:
    return holds(ma(price, window) >= low)


def mean_between(x: str, window: int, low: float | None, high: float | None) -> Column:
    mean = ma(x, window)
    out = mean.isNotNull()
    if low is not None:
        out = out & holds(mean >= low)
    if high is not None:
        out = out & holds(mean <= high)
    return out


def seasoned(least: int, price: str = "close") -> Column:
    return F.lit(True) if least <= 0 else F.count(price).over(trailing(None)) >= least


def investable(df: DataFrame, cfg: UniverseConfig) -> Column:
    """The conjunction of the filters that cfg switches on; a missing column that one needs is an error."""
    out = F.lit(True)
    if cfg.min_price is not None:
        out = out & price_floor(cfg.price_window, cfg.min_price)
    if cfg.min_mcap is not None or cfg.max_mcap is not None:
        if "mkt_cap" not in df.columns:
            raise ValueError("mkt_cap is needed")
        out = out & mean_between("mkt_cap", cfg.mcap_window, cfg.min_mcap, cfg.max_mcap)
    if cfg.min_turnover is not None:
        if "turnover" not in df.columns:
            raise ValueError("turnover is needed")
        out = out & mean_between("turnover", cfg.turnover_window, cfg.min_turnover, None)
    return out & seasoned(cfg.min_age)


def universe_bundle(df: DataFrame, cfg: UniverseConfig, first_event: Column | None = None) -> DataFrame:
    """df (with member) with exists, investable and eligible; members before the first event are blanked if it is given."""
    member = holds(F.col("member")) if first_event is None else holds(F.col("member")) & holds(F.col("date") >= first_event)
    return staged(
        df,
        member=member,
        exists=F.col("close").isNotNull(),
        investable=investable(df, cfg),
        eligible=F.col("member") & F.col("exists") & F.col("investable")
    )


MASKS = ("tradeable", "limit_up_locked", "limit_down_locked", "can_buy_next_open", "can_sell_next_open")


def execution_masks(df: DataFrame, tolerance: float = 0.01, missing: str = "allow") -> DataFrame:
    """The five masks of MASKS from open, close, volume, high_limit, low_limit; with missing = block an unknown limit locks."""
    unknown = F.lit(missing == "block")
    near = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= tolerance, unknown)
    tradeable = F.col("open").isNotNull() & F.col("close").isNotNull() & holds(F.col("volume") > 0)
    df = staged(
        df,
        tradeable=tradeable,
        limit_up_locked=near("close", "high_limit"),
        limit_down_locked=near("close", "low_limit"),
        _up=near("open", "high_limit"),
        _down=near("open", "low_limit")
    )
    can = lambda lock: F.coalesce(ref("tradeable", -1), F.lit(False)) & ~F.coalesce(ref(lock, -1), F.lit(True))
    return staged(df, can_buy_next_open=can("_up"), can_sell_next_open=can("_down")).drop("_up", "_down")


def next_close_masks(df: DataFrame) -> DataFrame:
    if missing := [m for m in MASKS if m not in df.columns]:
        raise ValueError(f"exec_masks missing keys: {missing}")
    can = lambda lock: F.coalesce(ref("tradeable", -1), F.lit(False)) & ~F.coalesce(ref(lock, -1), F.lit(True))
    return staged(df, can_buy_next_close=can("limit_up_locked"), can_sell_next_close=can("limit_down_locked"))


def feasible(h: int, entry: str = "next_open") -> Column:
    """Whether entry after this row and exit h rows later can both be done; not so beyond the end."""
    side = "open" if entry == "next_open" else "close"
    return holds(F.col(f"can_buy_next_{side}")) & F.coalesce(ref(f"can_sell_next_{side}", -h), F.lit(False))


def score_between(x: str, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that a missing score passes."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col(x) >= low)
    if high is not None:
        inside = inside & (F.col(x) <= high)
    return F.col(x).isNull() | inside


def tight_stack(df: DataFrame, tight: float = 0.02, ratio: float = 1.5, window: int = 20, rows: int = 2) -> DataFrame:
    """setup: MA5 > MA10 > MA20 within tight of each other, and volume at ratio times its mean for some rows."""
    df = staged(df, _a=ma("close", 5), _b=ma("close", 10), _c=ma("close", 20), _vr=div("volume", ma("volume", window)))
    spread = div(F.greatest("_a", "_b", "_c") - F.least("_a", "_b", "_c"), "close")
    calm = holds(F.col("_c").isNotNull() & (spread <= tight))
    busy = holds(full(F.min, "_vr", rows) >= ratio)
    return df.withColumn("setup", holds((F.col("_a") > F.col("_b")) & (F.col("_b") > F.col("_c"))) & calm & busy).drop("_a", "_b", "_c", "_vr")


def structure_flag(df: DataFrame, fast: int = 50, mid: int = 120, slow: int = 250, k: int = 20) -> DataFrame:
    """flag: 1 in an ordered rise, -1 in a fall under the fast line (which wins), else 0."""
    df = staged(df, _f=ma("close", fast), _m=ma("close", mid), _s=ma("close", slow))
    up = lambda c: holds(F.col(c) > ref(c, k))
    down = lambda c: holds(F.col(c) < ref(c, k))
    strong = holds((F.col("close") > F.col("_f")) & (F.col("_f") > F.col("_m")) & (F.col("_m") > F.col("_s"))) & up("_f") & up("_m")
    weak = holds(F.col("close") < F.col("_f")) & (down("_f") | down("_m") | holds(F.col("_f") < F.col("_m")))
    df = staged(df, _strong=strong, _weak=weak)
    return df.withColumn("flag", F.when(F.col("_weak"), -1).when(F.col("_strong"), 1).otherwise(0)).drop("_f", "_m", "_s", "_strong", "_weak")


def after_move(price: str, days: int, threshold: float, above: bool = True) -> Column:
    """Whether the price moved past the threshold from `days` rows ago to the row before."""
    move = div(ref(price, 1), ref(price, days)) - 1
    return holds(move > threshold if above else move < threshold)
