"""Ordered operators per key: fits, scores, equity, forward returns, calendars, runs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.orderstat import window_ranks
from ..functions.series import change, col, div, forward, full, ma, ordered, ref, staged, std, trailing
from .blocks import ROWS, in_blocks, in_order, kept, long_keys, numbered, same, schema_of, with_columns


def rolling_ols(df: DataFrame, y: str, n: int, key: str = "ticker", order: str = "date", t: str = "pos") -> DataFrame:
    """slope and r2 of y on t over the last n rows, all of which must have a value."""
    w = trailing(n, key, order)
    time = F.col(t).cast("double")
    known = F.count(y).over(w) == n
    return df.withColumn("slope", F.when(known, F.regr_slope(y, time).over(w))).withColumn("r2", F.when(known, F.regr_r2(y, time).over(w)))


def zscore(x: str, n: int, least: int | None = None, **k) -> Column:
    deviation = std(x, n, least=least, **k)
    return (F.col(x) - ma(x, n, least=least, **k)) / F.when(deviation > 1e-12, deviation)


def rolling_sharpe(r: str, n: int, freq: float = 252, rf: float = 0.0, ddof: int = 0, **k) -> Column:
    deviation = full(F.stddev_pop if ddof == 0 else F.stddev_samp, r, n, **k)
    per_period = (1 + rf) ** (1 / freq) - 1
    return (ma(r, n, **k) - per_period) / F.when(deviation > 1e-12, deviation) * freq**0.5


def equity(r: str | Column, key: str | list[str] = "ticker", order: str = "date") -> Column:
    return F.product(1 + F.coalesce(col(r), F.lit(0.0))).over(trailing(None, key, order))


def drawdown(eq: str, key: str | list[str] = "ticker", order: str = "date") -> Column:
    """Below the running peak; the peak starts at the first value."""
    return F.col(eq) / F.max(eq).over(trailing(None, key, order)) - 1


def forward_return(h: int, entry: str = "next_close", key: str = "ticker", order: str = "date") -> Column:
    """Return over h rows of a position entered after the current row's close."""
    if entry == "next_close":
        return div(ref("close", -(h + 1), key, order), ref("close", -1, key, order)) - 1
    if entry == "next_open":
        return div(ref("open", -(h + 1), key, order), ref("open", -1, key, order)) - 1
    if entry == "open_to_close":
        return div(ref("close", -h, key, order), ref("open", -1, key, order)) - 1
    raise ValueError("entry is next_close, next_open or open_to_close")


def forward_compound(r: str, h: int, key: str = "ticker", order: str = "date") -> Column:
    """Compounded return of the h rows after the current one; missing returns count as 0."""
    later = F.sum(F.log1p(F.coalesce(F.col(r), F.lit(0.0)))).over(forward(1, h, key, order))
    return F.when(F.count(F.lit(1)).over(forward(1, h, key, order)) == h, F.expm1(later))


def forward_drawdown(price: str, h: int, key: str = "ticker", order: str = "date") -> Column:
    """The deepest fall below the running peak over the next h rows, the current one included."""
    path = F.collect_list(price).over(forward(0, h, key, order))
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("fall"))
    step = lambda s, x: F.struct(F.greatest(s["peak"], x).alias("peak"), F.least(s["fall"], x / F.greatest(s["peak"], x) - 1).alias("fall"))
    return F.when(F.size(path) == h + 1, F.aggregate(path, start, step, lambda s: s["fall"]))


def rebalance_every(calendar: DataFrame, h: int, offset: int = 0) -> DataFrame:
    return calendar.where((F.col("pos") >= offset) & ((F.col("pos") - offset) % h == 0))


def rebalance_calendar(calendar: DataFrame, rule: str) -> DataFrame:
    """The last trading date of each day, week ending on Friday, or month."""
    bins = {"D": F.col("date"), "W-FRI": F.next_day(F.date_sub("date", 1), "FRI"), "M": F.last_day("date")}
    return calendar.groupBy(bins[rule].alias("bin")).agg(F.max("date").alias("date")).select("date")


def rebalance_dates_of(weights: DataFrame) -> DataFrame:
    """Dates on which any weight changes, and the first date. weights: date, ticker, w on a dense grid."""
    moved = weights.withColumn(
        "moved",
        F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce(ref("w"), F.lit(0.0))) > 1e-12
    ).withColumn("first", ref("date").isNull())
    return moved.groupBy("date").agg(F.max(F.col("moved") | F.col("first")).alias("hit")).where("hit").select("date")


def run_age(flag: str, key: str = "ticker", order: str = "date") -> Column:
    """How many rows in a row the flag has held; 0 where it does not."""
    breaks = F.sum(F.when(F.col(flag), 0).otherwise(1)).over(trailing(None, key, order))
    within = Window.partitionBy(*([key] if isinstance(key, str) else key), F.col("_breaks"), F.col(flag)).orderBy(order)
    return breaks, F.when(F.col(flag), F.row_number().over(within)).otherwise(0)


def with_run_age(df: DataFrame, flag: str, name: str = "age", key: str = "ticker", order: str = "date") -> DataFrame:
    breaks, age = run_age(flag, key, order)
    return df.withColumn("_breaks", breaks).withColumn(name, age).drop("_breaks")


def cusum(df: DataFrame, x: str, drift: float = 0.0, key: str = "ticker", order: str = "date") -> DataFrame:
    """up and down: one-sided cumulative sums that never fall below 0; the first row does not count."""
    w = trailing(None, key, order)
    first = ref(x, 1, key, order).isNull()
    df = df.withColumn("_u", F.when(first, 0.0).otherwise(F.coalesce(F.col(x) - drift, F.lit(0.0)))).withColumn(
        "_d",
        F.when(first, 0.0).otherwise(F.coalesce(-F.col(x) - drift, F.lit(0.0)))
    )
    df = df.withColumn("_cu", F.sum("_u").over(w)).withColumn("_cd", F.sum("_d").over(w))
    up = F.col("_cu") - F.least(F.lit(0.0), F.min("_cu").over(w))
    down = F.col("_cd") - F.least(F.lit(0.0), F.min("_cd").over(w))
    return df.withColumn("up", up).withColumn("down", down).drop("_u", "_d", "_cu", "_cd")


def rolling_rank(df: DataFrame, x: str, n: int, name: str, key: str | list[str] = "ticker", order: str = "date", rows: int = ROWS) -> DataFrame:
    """df with the average rank of the value among the last n rows' values, as a share; null unless all of them are known.

    Ranks come from sorted runs (functions.orderstat), a few for each row whatever n is. A key of more than `rows` rows
    is cut into blocks that also read the n - 1 rows before them.
    """
    keys, inputs = [key] if isinstance(key, str) else key, df.columns
    schema = schema_of(df, inputs, {name: "double"})

    def ranks(part: pa.Table) -> pa.Table:
        v = part.column(x).to_numpy().astype(float)
        begin = np.maximum(np.arange(len(v)) - n + 1, 0)
        seen = np.append(0, np.cumsum(~np.isnan(v)))
        less, equal = window_ranks(np.nan_to_num(v), begin)
        full = (seen[1:] - seen[begin] == n) & (np.arange(len(v)) >= n - 1)
        return with_columns(part, {name: "double"}, {name: np.where(full, (less + (equal + 2) / 2) / n, np.nan)}, part.column_names)

    def whole(part: pa.Table) -> pa.Table:
        return ranks(in_order(part, [order])).select([*inputs, name])

    def one_block(part: pa.Table) -> pa.Table:
        own = ranks(in_order(part, ["_pos"]))
        return own.filter(pc.greater_equal(own.column("_pos"), pc.multiply(own.column("_block"), rows))).select([*inputs, name])

    cold, hot = in_blocks(df, keys, order, rows, reach=n - 1)
    done = cold.groupBy(*keys).applyInArrow(whole, schema)
    return done if hot is None else done.unionByName(hot.groupBy(*keys, "_block").applyInArrow(one_block, schema))


def expanding_rank(df: DataFrame, x: str, least: int, name: str, key: str | list[str] = "ticker", order: str = "date", rows: int = ROWS) -> DataFrame:
    """df with the average rank of the value among all of the key's values so far, as a share; null before `least` values.

    A key of more than `rows` rows is numbered by time and by value and cut into blocks both ways. Below a row's value
    are: earlier rows of its value block; rows of its time block before it, of lower value blocks; and whole cells of
    earlier time blocks and lower value blocks, of which only counts move. Equal values are numbered by time.
    """
    keys, inputs = [key] if isinstance(key, str) else key, df.columns
    schema, places = schema_of(df, inputs, {name: "double"}), ["_pos", "_less", "_equal", "_time", "_value"]
    share = lambda less, equal, seen: np.where(seen >= least, (less + (equal + 2) / 2) / seen, np.nan)

    def whole(part: pa.Table) -> pa.Table:
        part = in_order(part, [order])
        v = part.column(x).to_numpy().astype(float)
        known, rank = ~np.isnan(v), np.full(len(v), np.nan)
        less, equal = window_ranks(v[known], np.zeros(known.sum(), np.int64))
        rank[known] = share(less, equal, np.arange(1, len(less) + 1))
        return with_columns(part, {name: "double"}, {name: rank}, inputs)

    def value_block(part: pa.Table) -> pa.Table:
        part = in_order(part, ["_pos"])
        less = window_ranks(part.column("_less").to_numpy(), np.zeros(part.num_rows, np.int64))[0]
        return part.set_column(part.column_names.index("_less"), "_less", pa.array(less, pa.int64()))

    def cells(part: pa.Table) -> pa.Table:
        """For each time block and value block that meet: the rows of earlier and lower blocks."""
        part = part.sort_by([("_time", "ascending"), ("_value", "ascending")])
        time, value, n = (part.column(c).to_numpy() for c in ("_time", "_value", "n"))
        sums, before = np.zeros(int(value.max()) + 2, np.int64), np.zeros(len(n), np.int64)
        for own in np.split(np.arange(len(n)), np.flatnonzero(np.diff(time)) + 1):
            before[own] = np.cumsum(sums)[value[own]]
            sums[value[own] + 1] += n[own]
        return part.append_column("_before", pa.array(before))

    def time_block(part: pa.Table, below: pa.Table) -> pa.Table:
        part = in_order(part, ["_pos"])
        value, pos = part.column("_value").to_numpy(), part.column("_pos").to_numpy()
        before = dict(zip(below.column("_value").to_pylist(), below.column("_before").to_pylist(), strict=True))
        less = part.column("_less").to_numpy() + window_ranks(value, np.zeros(len(value), np.int64))[0] + np.array([before[v] for v in value.tolist()])
        return with_columns(part, {name: "double"}, {name: share(less, part.column("_equal").to_numpy(), pos + 1)}, inputs)

    hot = long_keys(df, keys, rows)
    if hot is None:
        return df.groupBy(*keys).applyInArrow(whole, schema)
    done = df.join(hot, same(df, hot, keys), "left_anti").groupBy(*keys).applyInArrow(whole, schema)
    long = df.join(hot, same(df, hot, keys), "left_semi").withColumn(x, F.nanvl(F.col(x).cast("double"), F.lit(None)))
    timed = numbered(long.where(F.col(x).isNotNull()), keys, [F.col(order).asc_nulls_last()])
    valued = numbered(timed.withColumnRenamed("_pos", "_t"), keys, [F.col(x), F.col("_t").desc()]).withColumnRenamed("_pos", "_less")
    both = numbered(valued, [*keys, x], [F.col("_t")]).withColumnRenamed("_pos", "_equal").withColumnRenamed("_t", "_pos")
    block = lambda c: F.floor(F.col(c) / rows).cast("long")
    both = kept(both.select(*inputs, "_pos", "_less", "_equal", block("_pos").alias("_time"), block("_less").alias("_value")), "ranked-blocks")
    keyed = schema_of(df, keys, {"_time": "long", "_value": "long", "n": "long", "_before": "long"})
    counts = both.groupBy(*keys, "_time", "_value").agg(F.count("*").alias("n")).groupBy(*keys).applyInArrow(cells, keyed)
    inside = both.groupBy(*keys, "_value").applyInArrow(value_block, schema_of(both, [*inputs, *places], {}))
    ranked = inside.groupBy(*keys, "_time").cogroup(counts.groupBy(*keys, "_time")).applyInArrow(time_block, schema)
    return done.unionByName(ranked).unionByName(long.where(F.col(x).isNull()).withColumn(name, F.lit(None).cast("double")))


#: Aggregates of windows by name: from an array of windows (rows x n, one array for each column) to a value for each row.
AGGREGATES: dict[str, Callable[..., np.ndarray]] = {
    "product": lambda x: x.prod(axis=1),
    "rank": lambda x: ((x < x[:, -1:]).sum(axis=1) + ((x == x[:, -1:]).sum(axis=1) + 1) / 2) / x.shape[1],
    "rmse": lambda x, y: np.sqrt(((x - y) ** 2).mean(axis=1)),
    "dot": lambda x, y: (x * y).sum(axis=1),
}


def register_aggregate(name: str, fn: Callable[..., np.ndarray]) -> None:
    """Names a user's aggregate of windows for rolling_apply; a name is taken once."""
    if name in AGGREGATES:
        raise ValueError(f"an aggregate named {name} exists")
    AGGREGATES[name] = fn


def rolling_apply(
    df: DataFrame,
    fn: str | Callable[..., float],
    columns: str | list[str],
    n: int,
    name: str,
    key: str | list[str] = "ticker",
    order: str = "date",
    rows: int = ROWS
) -> DataFrame:
    """df with a user's aggregate of the last n rows; null unless all of them have all values, and where fn gives NaN or an infinity.

    fn is called for each window with a numpy array for each column, or is the name of an aggregate of whole arrays of
    windows (AGGREGATES), which is some 100 times as fast. Keys of more than `rows` rows are cut into blocks that also
    read the n - 1 rows before them. Windows are views of a block: no row is copied n times.
    """
    keys, columns, inputs = [key] if isinstance(key, str) else key, [columns] if isinstance(columns, str) else columns, df.columns
    if isinstance(fn, str) and fn not in AGGREGATES:
        raise KeyError(f"unknown aggregate {fn}; known: {', '.join(sorted(AGGREGATES))}")
    many = AGGREGATES[fn] if isinstance(fn, str) else lambda *x: np.array([fn(*w) for w in zip(*x, strict=True)], dtype=float)
    schema = schema_of(df, inputs, {name: "double"})

    def applied(part: pa.Table) -> pa.Table:
        values = [part.column(c).to_numpy().astype(float) for c in columns]
        out = np.full(part.num_rows, np.nan)
        if part.num_rows >= n:
            views = [np.lib.stride_tricks.sliding_window_view(v, n) for v in values]
            step = max(1, 1_000_000 // n)
            for begin in range(0, len(views[0]), step):
                some = [v[begin : begin + step] for v in views]
                fine = np.flatnonzero(np.logical_and.reduce([~np.isnan(v).any(axis=1) for v in some]))
                if len(fine):
                    out[begin + n - 1 + fine] = many(*[v[fine] for v in some])
        return with_columns(part, {name: "double"}, {name: np.where(np.isfinite(out), out, np.nan)}, part.column_names)

    def whole(part: pa.Table) -> pa.Table:
        return applied(in_order(part, [order])).select([*inputs, name])

    def one_block(part: pa.Table) -> pa.Table:
        own = applied(in_order(part, ["_pos"]))
        return own.filter(pc.greater_equal(own.column("_pos"), pc.multiply(own.column("_block"), rows))).select([*inputs, name])

    cold, hot = in_blocks(df, keys, order, rows, reach=n - 1)
    done = cold.groupBy(*keys).applyInArrow(whole, schema)
    return done if hot is None else done.unionByName(hot.groupBy(*keys, "_block").applyInArrow(one_block, schema))


def returns_grid(df: DataFrame) -> DataFrame:
    """close_to_close (without padding), open_to_close and open_to_open returns; where an open is missing the close stands in."""
    return staged(
        df,
        close_to_close=change("close"),
        open_to_close=div("close", "open") - 1,
        _o=F.coalesce("open", "close"),
        open_to_open=div(ref("_o", -1), "_o") - 1,
    ).drop("_o")


def trend_flips(df: DataFrame, slope: str, key: str = "ticker", order: str = "date") -> Column:
    return F.coalesce(F.signum(slope) * F.signum(ref(slope, 1, key, order)) < 0, F.lit(False))


def ordered_rows(key: str = "ticker", order: str = "date"):
    return ordered(key, order)
