"""Column helpers with one null and division policy: NaN and infinities are null, x / 0 is null, a window with too few values is null."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

ColumnLike = Column | str


def col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordered(key: str | list[str] = "ticker", order: str = "date") -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def trailing(n: int | None = None, key: str | list[str] = "ticker", order: str = "date") -> WindowSpec:
    """The last n rows with the current one; all rows up to the current one without n."""
    return ordered(key, order).rowsBetween(Window.unboundedPreceding if n is None else -(n - 1), 0)


def forward(a: int, b: int, key: str | list[str] = "ticker", order: str = "date") -> WindowSpec:
    return ordered(key, order).rowsBetween(a, b)


def clean(x: ColumnLike) -> Column:
    """Null for NaN and infinities."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def div(a: ColumnLike, b: ColumnLike) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def ref(x: ColumnLike, k: int = 1, key: str | list[str] = "ticker", order: str = "date") -> Column:
    """x as it was k rows before (after, if k is negative)."""
    return col(x) if k == 0 else F.lag(col(x), k).over(ordered(key, order)) if k > 0 else F.lead(col(x), -k).over(ordered(key, order))


def full(agg, x: ColumnLike, n: int, least: int | None = None, key: str | list[str] = "ticker", order: str = "date") -> Column:
    """agg of x over the last n rows, if at least `least` (all n, unless given) of them have a value."""
    w = trailing(n, key, order)
    return F.when(F.count(col(x)).over(w) >= (n if least is None else least), agg(col(x)).over(w))


def ma(x: ColumnLike, n: int, **k) -> Column:
    return full(F.avg, x, n, **k)


def std(x: ColumnLike, n: int, **k) -> Column:
    return full(F.stddev_samp, x, n, **k)


def total(x: ColumnLike, n: int, **k) -> Column:
    return full(F.sum, x, n, **k)


def ffill(x: ColumnLike, n: int | None = None, key: str | list[str] = "ticker", order: str = "date") -> Column:
    return F.last(col(x), ignorenulls=True).over(trailing(n, key, order))


def change(x: ColumnLike, k: int = 1, key: str | list[str] = "ticker", order: str = "date") -> Column:
    """x / x k rows ago - 1, without padding; pad first with ffill where the source of x pads."""
    return div(x, ref(x, k, key, order)) - 1


def rolling_cov(x: ColumnLike, y: ColumnLike, n: int, key: str | list[str] = "ticker", order: str = "date") -> Column:
    w = trailing(n, key, order)
    both = F.count(F.when(col(x).isNotNull() & col(y).isNotNull(), 1)).over(w)
    return F.when(both == n, F.covar_samp(col(x), col(y)).over(w))


def rolling_corr(x: ColumnLike, y: ColumnLike, n: int, key: str | list[str] = "ticker", order: str = "date") -> Column:
    """Sample correlation; null if a variable does not vary."""
    w = trailing(n, key, order)
    both = F.count(F.when(col(x).isNotNull() & col(y).isNotNull(), 1)).over(w)
    scale = F.stddev_samp(col(x)).over(w) * F.stddev_samp(col(y)).over(w)
    return F.when(both == n, F.when(F.abs(scale) > 1e-12, F.covar_samp(col(x), col(y)).over(w) / scale))


def ts_rank(x: ColumnLike, n: int, key: str | list[str] = "ticker", order: str = "date") -> Column:
    """Average rank of the last of n values among them, as a share."""
    values = F.collect_list(col(x)).over(trailing(n, key, order))
    last = F.element_at(values, -1)
    less = F.size(F.filter(values, lambda v: v < last))
    same = F.size(F.filter(values, lambda v: v == last))
    return F.when((F.size(values) == n) & col(x).isNotNull(), (less + (same + 1) / 2) / n)


def cs_rank(x: ColumnLike, by: str | list[str] = "date") -> Column:
    """Average rank of x among the non-null values of its cross section, as a share of their number."""
    keys = [by] if isinstance(by, str) else by
    x = col(x)
    below = F.rank().over(Window.partitionBy(*keys, x.isNull()).orderBy(x))
    ties = F.count(x).over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), (below + (ties - 1) / 2) / F.count(x).over(Window.partitionBy(*keys)))


def centred_rank(x: ColumnLike, by: str | list[str] = "date") -> Column:
    """Twice the average rank of x in its cross section less twice the mean of all ranks: a whole number; null for null."""
    keys = [by] if isinstance(by, str) else by
    x = col(x)
    below = F.rank().over(Window.partitionBy(*keys, x.isNull()).orderBy(x))
    ties = F.count(x).over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), 2 * below + ties - F.count(x).over(Window.partitionBy(*keys)) - 2).cast("double")


def staged(df: DataFrame, **columns) -> DataFrame:
    """df with one column after the other, each of which may use those before it."""
    for name, column in columns.items():
        df = df.withColumn(name, column(df) if callable(column) and not isinstance(column, Column) else column)
    return df


def corr_of(x: ColumnLike, y: ColumnLike) -> Column:
    """Sample correlation as an aggregate; null where a variable does not vary."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    scale = F.stddev_samp(x) * F.stddev_samp(y)
    return F.when(F.abs(scale) > 1e-15, F.try_divide(F.covar_samp(x, y), scale))


def ln_factorial(n: ColumnLike) -> Column:
    """ln n! by Stirling's series after a shift by 8, exact to about 1e-10."""
    n = col(n).cast("double")
    x = n + 9
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    for k in range(1, 9):
        series = series - F.log(n + k)
    return series


#: Ranges into which a key's values are cut to be ordered, each by a task of its own.
RANGES = 64


def pooled_order(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, x, n, less: how often each value occurs, and how many rows of its key have a lower one.

    A key may hold any number of rows: values are counted, cut at approximate quantiles of the key, and ordered inside
    each range; the ranges' sums make the offsets. Nulls are left out. There are few keys (features, horizons): their
    quantiles, RANGES numbers a key, are broadcast.
    """
    values = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("n"))
    cuts = df.groupBy(*keys).agg(F.percentile_approx(x, [i / RANGES for i in range(1, RANGES)], 10_000).alias("_cuts"))
    same = lambda a, b: [F.col(k).eqNullSafe(b[f"_{k}"]) for k in keys]
    named = lambda t: t.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in t.columns if c not in keys])
    drop = [f"_{k}" for k in keys]
    cuts = named(cuts)
    ranged = values.join(F.broadcast(cuts), same(values, cuts)).drop(*drop).withColumn(
        "_range",
        F.size(F.filter("_cuts", lambda c: c < F.col(x)))
    ).drop("_cuts")
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("n").alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = named(sums.withColumn("_offset", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m").withColumnRenamed("_range", "_r"))
    joined = ranged.join(F.broadcast(offsets), [*same(ranged, offsets), F.col("_range") == F.col("_r")]).drop(*drop, "_r")
    inside = Window.partitionBy(*keys, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("less", F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))).select(*keys, x, "n", "less")


def pooled_quantiles(df: DataFrame, keys: list[str], x: str, at: dict[str, float]) -> DataFrame:
    """keys and, for each name in at, the exact quantile of x with linear interpolation; see pooled_order."""
    order = pooled_order(df, keys, x)
    total = order.groupBy(*keys).agg(F.sum("n").alias("_total"))
    total = total.select(*[F.col(k).alias(f"_{k}") for k in keys], "_total")
    rows = order.join(F.broadcast(total), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    place = lambda p: (F.col("_total") - 1) * F.lit(float(p))
    holds = lambda i: (F.col("less") <= i) & (i < F.col("less") + F.col("n"))
    ends = [
        F.max(F.when(holds(f(place(p))), F.col(x))).alias(f"_{side}_{name}") for name,
        p in at.items() for side,
        f in (("low", F.floor), ("high", F.ceil))
    ]
    found = rows.groupBy(*keys).agg(F.max("_total").alias("_total"), *ends)
    return found.select(
        *keys,
        *[(F.col(f"_low_{n}") + (place(p) - F.floor(place(p))) * (F.col(f"_high_{n}") - F.col(f"_low_{n}"))).alias(n) for n, p in at.items()]
    )
