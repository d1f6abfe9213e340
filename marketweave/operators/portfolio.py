"""Weights, overlays and backtests on long tables keyed by strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import div, full, ref, staged, trailing
from .signals import ewm


def strategy_key(key: str | None) -> list[str]:
    return [key, "ticker"] if key else ["ticker"]


def hold_weights(grid: DataFrame, weights: DataFrame, rebalance: DataFrame) -> DataFrame:
    """Daily weights: on rebalance dates those given (0 for all others), kept until the next one; 0 before the first."""
    marked = grid.join(
        rebalance.select("date", F.lit(True).alias("_reb")),
        "date",
        "left"
    ).join(weights.select("date", "ticker", "w"), ["date", "ticker"], "left")
    given = F.when(F.col("_reb"), F.coalesce("w", F.lit(0.0)))
    return marked.withColumn("w", given).withColumn("w", F.coalesce(F.last("w", ignorenulls=True).over(trailing(None)), F.lit(0.0))).drop("_reb")


def backtest(df: DataFrame, fee: float = 0.0, cash: float = 0.0, key: str | None = None) -> DataFrame:
    """Per date: gross, cost, net, turnover, exposure, from weights w decided at the row's close and returns ret.

    Weights act on the next row's return; the fee is paid on the turnover one row later; the first turnover is 0.
    """
    keys = strategy_key(key)
    df = df.withColumn("_w", F.coalesce(ref("w", 1, keys), F.lit(0.0))).withColumn(
        "_dw",
        F.coalesce(F.abs(F.col("w") - ref("w", 1, keys)), F.lit(0.0))
    )
    by = [key, "date"] if key else ["date"]
    daily = df.groupBy(*by).agg(
        F.sum(F.col("_w") * F.coalesce("ret", F.lit(0.0))).alias("held"),
        F.sum(F.abs("_w")).alias("exposure"),
        F.sum("_dw").alias("turnover")
    )
    daily = daily.withColumn("_s", F.col(key) if key else F.lit(1))
    late = F.coalesce(F.lag("turnover").over(Window.partitionBy("_s").orderBy("date")), F.lit(0.0))
    return daily.withColumn(
        "gross",
        F.col("held") + (1 - F.col("exposure")) * cash
    ).withColumn("cost", late * fee).withColumn("net", F.col("gross") - F.col("cost")).drop("_s", "held")


def allocate(df: DataFrame, method: str, leg: str = "leg", budget: str = "budget", cap: float | None = None) -> DataFrame:
    """w of the chosen names of each date and leg: equal, inv_vol (column vol) or score_prop (column score, floor 0)."""
    within = Window.partitionBy("date", leg)
    raw = {
        "equal": F.lit(1.0),
        "inv_vol": F.when(F.col("vol") > 0, 1 / F.col("vol")) if "vol" in df.columns else None,
        "score_prop": F.greatest(F.col("score"), F.lit(0.0)) if "score" in df.columns else None
    }[method]
    df = df.withColumn("_raw", raw).withColumn("_sum", F.sum("_raw").over(within))
    df = df.withColumn("w", F.when(F.col("_sum") > 0, F.col("_raw") / F.col("_sum")).otherwise(1 / F.count("*").over(within)) * F.col(budget))
    if cap is not None:
        df = capped(df, "w", cap, ["date", leg], budget)
    return df.drop("_raw", "_sum")


def capped(df: DataFrame, w: str, cap: float, by: list[str], budget: str) -> DataFrame:
    """Weights up to the cap; what is cut goes once, in proportion, to those below it; then all are scaled to the budget."""
    within = Window.partitionBy(*by)
    df = df.withColumn("_c", F.least(F.col(w), F.lit(cap))).withColumn("_free", F.when(F.col(w) < cap, F.col(w)).otherwise(0.0))
    df = df.withColumn("_excess", F.sum(F.col(w) - F.col("_c")).over(within)).withColumn("_fs", F.sum("_free").over(within))
    df = df.withColumn("_c", F.col("_c") + F.when(F.col("_fs") > 0, F.col("_excess") * F.col("_free") / F.col("_fs")).otherwise(0.0))
    return df.withColumn(w, F.col("_c") * F.col(budget) / F.sum("_c").over(within)).drop("_c", "_free", "_excess", "_fs")


def asset_vol_target(df: DataFrame, target: float, window: int, cap: float, freq: float = 252) -> DataFrame:
    """Weights scaled by target / volatility up to the cap; if any date's gross is above 1, all rows are divided by theirs."""
    vol = full(F.stddev_pop, "ret", window) * freq**0.5
    df = df.withColumn(
        "_scale",
        F.coalesce(F.least(div(F.lit(target), F.when(vol > 1e-12, vol)), F.lit(cap)), F.lit(1.0))
    ).withColumn("w", F.col("w") * F.col("_scale"))
    gross = df.groupBy("date").agg(F.sum(F.abs("w")).alias("_gross"))
    worst = gross.agg(F.max("_gross").alias("_worst"))
    df = df.join(gross, "date").crossJoin(F.broadcast(worst))  # one row
    return df.withColumn(
        "w",
        F.when((F.col("_worst") > 1) & (F.col("_gross") > 0), F.col("w") / F.col("_gross")).otherwise(F.col("w"))
    ).drop("_scale", "_gross", "_worst")


def book_vol(df: DataFrame, window: int, freq: float = 252) -> DataFrame:
    """date, full, diagonal: the book's volatility with the covariance of the last rows, and without it.

    The variance of the weighted sum of returns equals w'Sw, so that no matrix is built. Dates that follow each other with
    the same weights are a span: its weighted returns are summed once for each row that any of its windows holds, so that
    a name costs a span's length and a window's, not their product. Dates are a dimension: spans are found by one sort.
    """
    w = df.where("w <> 0").select("date", "pos", "ticker", "w")
    r = df.select(F.col("ticker").alias("_t"), F.col("pos").alias("_p"), F.coalesce("ret", F.lit(0.0)).alias("_r"))
    dates = w.groupBy("date", "pos").agg(F.bit_xor(F.xxhash64("ticker", "w")).alias("_h"))
    order = Window.orderBy("pos")
    follows = (F.lag("_h").over(order) == F.col("_h")) & (F.lag("pos").over(order) == F.col("pos") - 1)
    dates = dates.withColumn("_new", F.coalesce((~follows).cast("int"), F.lit(1)))
    dates = dates.withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("date", "pos", "_span")
    spans = dates.groupBy("_span").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    held = w.join(spans, F.col("pos") == F.col("_first")).select("_span", "ticker", "w", "_first", "_last")
    each = held.withColumn("_at", F.explode(F.sequence(F.col("_first") - (window - 1), F.col("_last"))))
    each = each.join(r, (F.col("ticker") == F.col("_t")) & (F.col("_at") == F.col("_p")))
    path = each.groupBy("_span", "_at").agg(F.sum(F.col("w") * F.col("_r")).alias("x"))
    last = Window.partitionBy("_span").orderBy("_at").rowsBetween(-(window - 1), 0)
    path = path.select("_span", "_at", (F.stddev_pop("x").over(last) * freq**0.5).alias("full"), F.count("x").over(last).alias("rows"))
    full_path = dates.join(path.where(F.col("rows") == window), (dates["_span"] == path["_span"]) & (F.col("pos") == F.col("_at"))).select("date", "full")
    own = df.select("date", F.col("ticker").alias("_t"), F.var_pop(F.coalesce("ret", F.lit(0.0))).over(trailing(window)).alias("v"))
    squares = w.join(own, (w["date"] == own["date"]) & (F.col("ticker") == F.col("_t"))).groupBy(w["date"])
    diagonal = squares.agg((F.sqrt(F.sum(F.col("w") * F.col("w") * F.col("v"))) * freq**0.5).alias("diagonal"))
    return full_path.join(diagonal, "date")


def series_vol_target(df: DataFrame, r: str, target: float, window: int, cap: float, key: str, freq: float = 252) -> DataFrame:
    """scaled: the return times last row's target / volatility, up to the cap."""
    vol = full(F.stddev_samp, r, window, key=key) * freq**0.5
    df = df.withColumn("_lev", F.least(div(F.lit(target), F.when(vol > 1e-12, vol)), F.lit(cap)))
    return df.withColumn("scaled", F.coalesce(ref("_lev", 1, key), F.lit(0.0)) * F.col(r)).drop("_lev")


def single_asset(df: DataFrame, signal: Column, cost: float, key: str = "ticker") -> DataFrame:
    """pnl of last row's position less the cost of its change, for a 0/1 signal."""
    df = df.withColumn("_sig", F.coalesce(signal.cast("double"), F.lit(0.0))).withColumn("position", F.coalesce(ref("_sig", 1, key), F.lit(0.0)))
    traded = F.abs(F.col("position") - F.coalesce(ref("position", 1, key), F.lit(0.0)))
    return df.withColumn("pnl", F.col("position") * F.coalesce("ret", F.lit(0.0)) - cost * traded).drop("_sig")


def risk_parity(df: DataFrame, window: int) -> DataFrame:
    """w in inverse proportion to rolling volatility per date."""
    df = staged(df, _v=full(F.stddev_samp, "ret", window), _i=F.when(F.col("_v") > 1e-12, 1 / F.col("_v")))
    return df.withColumn("w", F.col("_i") / F.sum("_i").over(Window.partitionBy("date"))).drop("_v", "_i")


def policy_weights(
    df: DataFrame, p: str, regime: str, momentum: str, policies: dict[int, tuple[float, float, float]], share: float, bond_share: float,
    halflife: float = 2.0, key: str = "ticker",
) -> DataFrame:
    """w_eq, w_bond and w_cash of each row: a blend (share) of what the risk probability p says and the regime's policy.

    policies: equity, bond and cash by regime. In regime 1 with momentum below 0 the bonds' weight goes to cash. The
    weights are smoothed by exponential means along the key, and add up to 1.
    """
    by_regime = lambda k: F.coalesce(*[F.when(F.col(regime) == r, F.lit(float(w[k]))) for r, w in policies.items()])
    by_chance = (1 - F.col(p), F.lit(bond_share) * F.col(p), F.lit(1 - bond_share) * F.col(p))
    names = ("w_eq", "w_bond", "w_cash")
    for k, name in enumerate(names):
        df = df.withColumn(name, F.greatest(F.least(share * by_chance[k] + (1 - share) * by_regime(k), F.lit(1.0)), F.lit(0.0)))
    divert = F.coalesce((F.col(regime) == 1) & (F.col(momentum) < 0), F.lit(False))
    df = df.withColumn("w_cash", F.when(divert, F.col("w_cash") + F.col("w_bond")).otherwise(F.col("w_cash")))
    df = df.withColumn("w_bond", F.when(divert, F.lit(0.0)).otherwise(F.col("w_bond")))
    for name in names:
        df = ewm(df, name, f"_{name}", halflife=halflife, key=(key,))
    total = F.col("_w_eq") + F.col("_w_bond") + F.col("_w_cash")
    return df.withColumns({n: div(F.col(f"_{n}"), total) for n in names}).drop(*[f"_{n}" for n in names])
