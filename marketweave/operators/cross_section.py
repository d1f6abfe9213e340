"""Operators on the cross section of a date: clipping, neutralising, buckets, grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import cs_rank, div, pooled_order

def by_date():
    """The window of a cross section (made on use: columns need a session)."""
    return Window.partitionBy("date")


def winsorized_zscore(df: DataFrame, x: str, low: float = 0.01, high: float = 0.99, least: int = 5, name: str = "z") -> DataFrame:
    """Clips x to its date's quantiles (linear) and standardises it; few values are left as they are, constant ones are only clipped."""
    bounds = F.percentile(F.col(x), F.array(F.lit(low), F.lit(high))).over(by_date())
    df = df.withColumn("_n", F.count(x).over(by_date())).withColumn("_b", bounds)
    df = df.withColumn("_c", F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col("_b")[0]), F.col("_b")[1])))
    df = df.withColumn("_m", F.avg("_c").over(by_date())).withColumn("_s", F.stddev_samp("_c").over(by_date()))
    z = F.when(F.col("_n") < least, F.col(x)).when(F.col("_s") > 1e-12, (F.col("_c") - F.col("_m")) / F.col("_s")).otherwise(F.col("_c"))
    return df.withColumn(name, z).drop("_n", "_b", "_c", "_m", "_s")


def demean(df: DataFrame, x: str, group: str, name: str = "d") -> DataFrame:
    return df.withColumn(name, F.col(x) - F.avg(x).over(Window.partitionBy("date", group)))


def neutralize(df: DataFrame, x: str, group: str, size: str, low: float = 0.01, high: float = 0.99, name: str = "resid") -> DataFrame:
    """Residual of x on group dummies and log size per date, by partialling out: both are demeaned by group on their common sample."""
    df = df.withColumn("_ln", F.when(F.col(size) > 0, F.ln(size)))
    df = df.withColumn("_b", F.percentile("_ln", F.array(F.lit(low), F.lit(high))).over(by_date()))
    known = F.col(x).isNotNull() & F.col("_ln").isNotNull() & F.col(group).isNotNull()
    df = df.withColumn("_x", F.when(known, F.col(x))).withColumn(
        "_l",
        F.when(known, F.least(F.greatest(F.col("_ln"), F.col("_b")[0]), F.col("_b")[1]))
    )
    within = Window.partitionBy("date", group)
    df = df.withColumn("_dx", F.col("_x") - F.avg("_x").over(within)).withColumn("_dl", F.col("_l") - F.avg("_l").over(within))
    square = F.sum(F.col("_dl") * F.col("_dl")).over(by_date())
    beta = F.sum(F.col("_dx") * F.col("_dl")).over(by_date()) / F.when(square > 1e-12, square)
    df = df.withColumn("_beta", F.coalesce(beta, F.lit(0.0)))
    return df.withColumn(name, F.col("_dx") - F.col("_beta") * F.col("_dl")).drop("_ln", "_b", "_x", "_l", "_dx", "_dl", "_beta")


def buckets(df: DataFrame, x: str, n: int, method: str = "quantile", eligible: Column | None = None, name: str = "bucket") -> DataFrame:
    """Bucket 1 to n of x per date; ties go by ticker; dates with fewer values than buckets have none.

    quantile: equal counts by linear quantile edges, ascending. rank_floor: descending, bucket 1 is the best.
    qcut: like quantile with edges that belong to the bucket below.
    """
    usable = F.col(x).isNotNull() if eligible is None else F.col(x).isNotNull() & F.coalesce(eligible, F.lit(False))
    df = df.withColumn("_u", usable)
    order = [F.col(x).desc() if method == "rank_floor" else F.col(x).asc(), F.col("ticker")]
    i = F.row_number().over(Window.partitionBy("date", "_u").orderBy(*order)) - 1
    m = F.count(F.when(F.col("_u"), 1)).over(by_date())
    df = df.withColumn("_i", i).withColumn("_m", m)
    if method == "quantile":
        b = F.least(F.lit(n - 1), F.floor(F.col("_i") * n / F.greatest(F.col("_m") - 1, F.lit(1)))) + 1
    elif method == "rank_floor":
        b = F.least(F.lit(n), F.floor(F.col("_i") * n / F.col("_m")) + 1)
    elif method == "qcut":
        b = F.greatest(F.lit(1), F.ceil(F.col("_i") * n / F.greatest(F.col("_m") - 1, F.lit(1))))
    else:
        raise ValueError("method is quantile, rank_floor or qcut")
    return df.withColumn(name, F.when(F.col("_u") & (F.col("_m") >= n), b.cast("int"))).drop("_u", "_i", "_m")


def grades(df: DataFrame, x: str, n: int, least: int, name: str = "grade") -> DataFrame:
    """Whole grades 0 to n - 1 per date by average rank; null on dates with fewer than `least` values."""
    rank = cs_rank(x) * F.count(x).over(by_date())
    grade = F.floor((rank - 1) / F.greatest(F.count(x).over(by_date()) / n, F.lit(1.0)))
    return df.withColumn(name, F.when(F.count(x).over(by_date()) >= least, F.least(grade, F.lit(n - 1))).cast("int"))


def flip_signs(long: DataFrame, target: str) -> DataFrame:
    """feature, sign: -1 where a feature's pooled rank correlation with the target is below 0. long: feature, value, target."""
    rows = long.where(F.col("value").isNotNull() & F.col(target).isNotNull())
    rank = lambda x, name: pooled_order(rows, ["feature"], x).select(
        F.col("feature").alias("_f"),
        F.col(x).alias("_x"),
        (F.col("less") + (F.col("n") + 1) / 2).alias(name)
    )
    for x, name in (("value", "_a"), (target, "_b")):
        rows = rows.join(rank(x, name), (F.col("feature") == F.col("_f")) & (F.col(x) == F.col("_x"))).drop("_f", "_x")
    stats = rows.groupBy("feature").agg(F.covar_samp("_a", "_b").alias("c"))
    return stats.select("feature", F.when(F.col("c") < 0, -1).otherwise(1).alias("sign"))


def double_tail_spread(df: DataFrame, bucket: str, r: str, n: int) -> DataFrame:
    """date, spread: mean return of both end buckets less that of the rest."""
    ends = F.col(bucket).isin(1, n)
    return df.where(F.col(bucket).isNotNull() & F.col(r).isNotNull()).groupBy("date").agg(
        (F.avg(F.when(ends, F.col(r))) - F.avg(F.when(~ends, F.col(r)))).alias("spread")
    )


def top_k(df: DataFrame, x: str, k: int, name: str = "place") -> DataFrame:
    """The k highest values of x per date, ties by ticker."""
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.col(x).desc(), F.col("ticker")))
    return df.where(F.col(x).isNotNull()).withColumn(name, place).where(F.col(name) <= k)


def bottom_k(df: DataFrame, x: str, k: int, name: str = "place") -> DataFrame:
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.col(x).asc(), F.col("ticker")))
    return df.where(F.col(x).isNotNull()).withColumn(name, place).where(F.col(name) <= k)


def share_of(x: str, keys: list[str]) -> Column:
    return div(F.col(x), F.sum(x).over(Window.partitionBy(*keys)))
