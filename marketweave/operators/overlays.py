"""Extension points: overlays of weights with diagnostics, membership gates, books with selection filters, the tilt study."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import full, ref, staged
from . import inference as inf
from . import joins as jn
from . import portfolio as pf
from . import regimes as rg


class Overlay(Protocol):
    """Changes decision-time weights w of (date, ticker) rows and tells what it saw, as tables by name."""

    name: str

    def apply(self, df: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]: ...


@dataclass(frozen=True)
class VolTarget:
    target: float
    window: int
    cap: float
    freq: float = 252
    name: str = "asset_vol_target"

    def apply(self, df: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
        out = pf.asset_vol_target(df.withColumn("_before", F.col("w")), self.target, self.window, self.cap, self.freq)
        return out.drop("_before"), {"scale": out.select("date", "ticker", F.try_divide("w", "_before").alias("scale"))}


@dataclass(frozen=True)
class TradeStop:
    stop: float
    cooldown: int
    price: str = "px"
    name: str = "trade_dd_stop"

    def apply(self, df: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
        out = rg.trailing_stop(df, "w", self.price, self.stop, self.cooldown, ["ticker"])
        return out.drop("w", "exit_flag", "dd", "peak").withColumnRenamed("held", "w"), {
            "exits": out.select("date", "ticker", "exit_flag", "dd", "peak")
        }


def apply_overlays(df: DataFrame, overlays: Sequence[Overlay]) -> tuple[DataFrame, dict[str, dict[str, DataFrame]]]:
    """The weights after all overlays in order, and each one's diagnostics by its name; a name twice is an error."""
    found: dict[str, dict[str, DataFrame]] = {}
    for o in overlays:
        if o.name in found:
            raise ValueError(f"overlay {o.name} twice")
        df, found[o.name] = o.apply(df)
    return df, found


def check_weights(df: DataFrame, long_only: bool = True, most: float = 1.01) -> DataFrame:
    """date, gross and least weight of the dates that break the rules: a negative weight, or a gross above `most`."""
    by_date = df.groupBy("date").agg(F.sum(F.abs("w")).alias("gross"), F.min("w").alias("least"))
    return by_date.where((F.col("gross") > most) | (F.lit(long_only) & (F.col("least") < 0)))


class MembershipGate(Protocol):
    """Says for each (date, ticker) of a grid whether the ticker belongs to the universe: adds a boolean column member."""

    name: str

    def mask(self, grid: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class EventGate:
    """Membership by events (ticker, date, delta) on trading dates."""

    events: DataFrame
    seeds: tuple[str, ...] = ()
    name: str = "events"

    def mask(self, grid: DataFrame) -> DataFrame:
        return jn.replay_delta(grid, self.events, list(self.seeds))


@dataclass(frozen=True)
class SpanGate:
    """Membership inside spans (ticker, start, end)."""

    spans: DataFrame
    name: str = "spans"

    def mask(self, grid: DataFrame) -> DataFrame:
        return jn.within_span(grid, self.spans, "ticker", "date").withColumnRenamed("alive", "member")


def gated(grid: DataFrame, gates: Sequence[MembershipGate]) -> DataFrame:
    """grid (date, ticker) with a column for each gate, by its name, and member: whether all gates let the row in."""
    out = grid.select("date", "ticker")
    for g in gates:
        out = g.mask(out).withColumnRenamed("member", g.name)
    every = F.lit(True)
    for g in gates:
        every = every & F.coalesce(g.name, F.lit(False))
    return out.withColumn("member", every)


Filter = Callable[[], Column]


def select_book(
    df: DataFrame, score: str, long_k: int, short_k: int = 0, long_filter: Filter | None = None, short_filter: Filter | None = None,
    long_budget: float = 1.0, short_budget: float = 0.0, both_sides: bool = False,
) -> DataFrame:
    """date, ticker, leg, w: the long_k best and short_k worst scores that the filters let through, equal weights in a leg.

    A filter gives a condition over df's columns; where it is null, the row is left out. With both_sides, dates on which
    a leg is empty have no book.
    """

    def leg(name: str, keep: Filter | None, k: int, order: Column, budget: float) -> DataFrame:
        rows = df.where(F.col(score).isNotNull())
        rows = rows.where(F.coalesce(keep(), F.lit(False))) if keep else rows
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("date").orderBy(order, "ticker"))).where(F.col("_place") <= k)
        return rows.select("date", "ticker", F.lit(name).alias("leg"), (F.lit(budget) / F.count("*").over(Window.partitionBy("date"))).alias("w"))

    out = leg("long", long_filter, long_k, F.col(score).desc(), long_budget)
    if short_k:
        out = out.unionByName(leg("short", short_filter, short_k, F.col(score).asc(), -short_budget))
    if both_sides:
        sides = F.size(F.collect_set("leg").over(Window.partitionBy("date")))
        out = out.withColumn("_sides", sides).where("_sides = 2").drop("_sides")
    return out


def tilt_study(
    df: DataFrame,
    r: str,
    predictors: list[str],
    least: int = 36,
    confirm: int = 2,
    threshold: float = 0.0,
    target: float = 0.1,
    lookback: int = 36,
    cap: float = 2.0,
    freq: float = 12,
    cost: float = 0.0
) -> DataFrame:
    """ticker, date, pred, position, pnl: return forecasts by expanding least squares, their confirmed signs as positions,
    scaled to a target volatility, and last row's position times this row's return less the cost of its change."""
    rows = inf.expanding_ols(
        df.select("ticker", "date", r, *predictors),
        r,
        predictors,
        least,
        ["ticker"]
    ).where("forecast is not null and not isnan(forecast)").withColumnRenamed("forecast", "pred")
    rows = rg.tri_state(rows, "pred", threshold, confirm)
    vol = full(F.stddev_samp, r, lookback) * freq**0.5
    rows = staged(rows, _vol=vol, _lev=F.when(F.col("_vol") > 1e-12, F.least(F.lit(target) / F.col("_vol"), F.lit(cap))))
    rows = rows.withColumn("position", F.col("position") * F.coalesce(ref("_lev"), F.lit(0.0)))
    rows = staged(rows, _held=F.coalesce(ref("position"), F.lit(0.0)), _traded=F.abs(F.col("position") - F.coalesce(ref("position"), F.lit(0.0))))
    return rows.withColumn(
        "pnl",
        F.col("_held") * F.coalesce(F.col(r), F.lit(0.0)) - cost * F.col("_traded")
    ).select("ticker", "date", F.col(r).alias("r"), "pred", "position", "pnl")


def tilt_metrics(study: DataFrame, freq: float = 12) -> DataFrame:
    """ticker, n, oos_r2 (against the mean so far), sharpe, max_drawdown, hit_rate and turnover of a tilt study."""
    before = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = study.withColumn("_mean", F.avg("r").over(before)).withColumn("_eq", F.product(1 + F.coalesce("pnl", F.lit(0.0))).over(upto))
    rows = rows.withColumn("_dd", F.col("_eq") / F.max("_eq").over(upto) - 1).withColumn("_turn", F.abs(F.col("position") - ref("position")))
    known = F.col("_mean").isNotNull() & F.col("r").isNotNull()
    square = lambda e: F.sum(F.when(known, F.pow(F.col("r") - F.col(e), 2)))
    return rows.groupBy("ticker").agg(
        F.count("r").alias("n"),
        (1 - F.try_divide(square("pred"), square("_mean"))).alias("oos_r2"),
        (F.try_divide(F.avg("pnl"), F.stddev_samp("pnl")) * freq**0.5).alias("sharpe"),
        F.min("_dd").alias("max_drawdown"),
        F.avg((F.signum("pred") == F.signum("r")).cast("double")).alias("hit_rate"),
        F.avg("_turn").alias("turnover"),
    )
