"""Performance, information-coefficient, event and classification statistics as grouped aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import centred_rank, corr_of, cs_rank, ln_factorial, pooled_quantiles, trailing
from .blocks import kept

TRADING_DAYS = 252


def annual_return(r: str, freq: float = TRADING_DAYS) -> Column:
    """Geometric: product of 1 + r to the power freq / n, less 1."""
    return F.pow(F.product(1 + F.col(r)), F.lit(float(freq)) / F.count(r)) - 1


def annual_vol(r: str, freq: float = TRADING_DAYS, ddof: int = 0) -> Column:
    return (F.stddev_pop(r) if ddof == 0 else F.stddev_samp(r)) * freq**0.5


def sharpe(r: str, freq: float = TRADING_DAYS, rf: float = 0.0, ddof: int = 0) -> Column:
    vol = annual_vol(r, freq, ddof)
    return (F.avg(r) - ((1 + rf) ** (1 / freq) - 1)) * freq / F.when(vol > 1e-12, vol)


def sortino(r: str, freq: float = TRADING_DAYS) -> Column:
    down = F.sqrt(F.avg(F.pow(F.least(F.col(r), F.lit(0.0)), 2)))
    return F.avg(r) * freq / F.when(down > 1e-12, down) / freq**0.5


def with_drawdown(df: DataFrame, r: str, key: str, order: str = "date") -> DataFrame:
    """eq and dd of a return series per key; missing returns count as 0 and the peak starts at the first equity value."""
    df = df.withColumn("eq", F.product(1 + F.coalesce(F.col(r), F.lit(0.0))).over(trailing(None, key, order)))
    return df.withColumn("dd", F.col("eq") / F.max("eq").over(trailing(None, key, order)) - 1)


def perf_summary(df: DataFrame, r: str, key: str, freq: float = TRADING_DAYS, order: str = "date") -> DataFrame:
    """key, ann_return, ann_vol, sharpe, max_drawdown, n: one pass of windows and one aggregate for all keys."""
    return with_drawdown(df, r, key, order).groupBy(key).agg(
        annual_return(r, freq).alias("ann_return"), annual_vol(r, freq).alias("ann_vol"), sharpe(r, freq).alias("sharpe"),
        F.min("dd").alias("max_drawdown"), F.count(r).alias("n"),
    )


def drawdown_duration(df: DataFrame, r: str, key: str, order: str = "date") -> DataFrame:
    """key, longest: the longest run of rows below the running peak."""
    df = with_drawdown(df, r, key, order).withColumn("_peak", F.sum(F.when(F.col("dd") >= 0, 1).otherwise(0)).over(trailing(None, key, order)))
    runs = df.groupBy(key, "_peak").agg(F.sum(F.when(F.col("dd") < 0, 1).otherwise(0)).alias("run"))
    return runs.groupBy(key).agg(F.max("run").alias("longest"))


def icir(ic: str) -> Column:
    deviation = F.stddev_pop(ic)
    return F.when(F.count(ic) >= 2, F.avg(ic) / F.when(deviation > 1e-12, deviation))


def spearman_ic(df: DataFrame, s: str, r: str, least: int, keys: list[str] | None = None) -> DataFrame:
    """keys, ic, n: rank correlation over the jointly known rows of each cross section with at least `least` of them.

    Sums of products of whole numbers are exact in any order (to 300,000 rows a cross section), so that ic is 0 where it
    is 0, and neither its sign nor a hit rate hangs on the order of rows.
    """
    keys = keys or ["date"]
    rows = df.where(F.col(s).isNotNull() & F.col(r).isNotNull())
    ranked = rows.withColumn("_a", centred_rank(s, keys)).withColumn("_b", centred_rank(r, keys))
    product = lambda x, y: F.sum(F.col(x) * F.col(y))
    return ranked.groupBy(*keys).agg(
        F.try_divide(product("_a", "_b"), F.sqrt(product("_a", "_a") * product("_b", "_b"))).alias("ic"),
        F.count("*").alias("n")
    ).withColumn("ic", F.when(F.col("n") >= least, F.col("ic")))


def ic_stats(ic: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, deviation (ddof 0), icir and hit rate (missing values count as misses) of the column ic."""
    return ic.groupBy(*keys).agg(
        F.avg("ic").alias("mean"), F.stddev_pop("ic").alias("std"), icir("ic").alias("icir"),
        F.avg(F.coalesce((F.col("ic") > 0).cast("double"), F.lit(0.0))).alias("hit"), F.count("ic").alias("n"),
    )


def bucket_returns(df: DataFrame, bucket: str, r: str) -> DataFrame:
    """date, bucket, ret, n: equal-weight mean of each bucket."""
    rows = df.where(F.col(bucket).isNotNull() & F.col(r).isNotNull())
    return rows.groupBy("date", bucket).agg(F.avg(r).alias("ret"), F.count("*").alias("n"))


def bucket_summary(returns: DataFrame, bucket: str) -> DataFrame:
    deviation = F.stddev_pop("ret")
    return returns.groupBy(bucket).agg(
        F.avg("ret").alias("mean"), deviation.alias("std"), F.count("ret").alias("n"),
        (F.avg("ret") / F.when(deviation > 1e-12, deviation) * F.sqrt(F.count("ret"))).alias("t_stat"),
    )


def monotonicity(summary: DataFrame, bucket: str, keys: list[str] | None = None) -> DataFrame:
    """Rank correlation of the bucket number and its mean."""
    keys = keys or []
    ranked = summary.withColumn("_k", F.lit(1)).withColumn("_a", cs_rank(bucket, ["_k", *keys])).withColumn("_b", cs_rank("mean", ["_k", *keys]))
    return ranked.groupBy(*keys).agg(corr_of("_a", "_b").alias("monotonicity"))


def long_short(returns: DataFrame, bucket: str, best: int, worst: int) -> DataFrame:
    pick = lambda k: F.max(F.when(F.col(bucket) == k, F.col("ret")))
    return returns.groupBy("date").agg((pick(best) - pick(worst)).alias("ret"))


def turnover_proxy(labels: DataFrame, bucket: str, k: int) -> DataFrame:
    """date, turnover: share of bucket k that was not in it on the previous rebalance date. labels: date, ticker, bucket on a dense grid."""
    was = F.lag(bucket).over(Window.partitionBy("ticker").orderBy("date"))
    rows = labels.withColumn(
        "_in",
        F.coalesce(F.col(bucket) == k, F.lit(False)).cast("int")
    ).withColumn("_was", F.coalesce(was == k, F.lit(False)).cast("int"))
    out = rows.groupBy("date").agg(F.sum("_in").alias("size"), F.sum(F.col("_in") * F.col("_was")).alias("stay"))
    return out.where("size > 0").select("date", (1 - F.col("stay") / F.col("size")).alias("turnover"))


def transition_matrix(df: DataFrame, state: str, key: str, order: str = "date") -> DataFrame:
    """prev, state, share: how often each state follows each other, by the state before."""
    moves = df.withColumn(
        "prev",
        F.lag(state).over(Window.partitionBy(key).orderBy(order))
    ).where(F.col("prev").isNotNull() & F.col(state).isNotNull())
    counts = moves.groupBy("prev", F.col(state).alias("state")).agg(F.count("*").alias("n"))
    return counts.select("prev", "state", (F.col("n") / F.sum("n").over(Window.partitionBy("prev"))).alias("share"))


def confusion(df: DataFrame, p: str, y: str, at: float, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn, precision, recall of p >= at for the 0/1 label y."""
    yes, is_one = F.col(p) >= at, F.col(y) == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*(keys or [])).agg(
        n(yes & is_one).alias("tp"),
        n(yes & ~is_one).alias("fp"),
        n(~yes & ~is_one).alias("tn"),
        n(~yes & is_one).alias("fn")
    )
    return out.withColumn(
        "precision",
        F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    ).withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))


def roc_points(df: DataFrame, p: str, y: str, key: str) -> DataFrame:
    """key, threshold, tpr, fpr, precision, youden for each distinct score, from the highest on."""
    grouped = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(key, F.col(p).alias("threshold")).agg(
        F.sum(y).alias("pos"),
        F.sum(1 - F.col(y)).alias("neg")
    )
    down = Window.partitionBy(key).orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(key)
    rows = grouped.withColumn("tp", F.sum("pos").over(down)).withColumn("fp", F.sum("neg").over(down)).withColumn(
        "all_pos",
        F.sum("pos").over(every)
    ).withColumn("all_neg", F.sum("neg").over(every))
    rows = rows.withColumn(
        "tpr",
        F.try_divide(F.col("tp").cast("double"), "all_pos")
    ).withColumn("fpr", F.try_divide(F.col("fp").cast("double"), "all_neg"))
    return rows.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("youden", F.col("tpr") - F.col("fpr")).select(
        key,
        "threshold",
        "pos",
        "tpr",
        "fpr",
        "precision",
        "youden",
        "all_pos"
    )


def auc(df: DataFrame, p: str, y: str, key: str) -> DataFrame:
    """key, auc (by ranks, ties count half), average_precision and youden_threshold."""
    points = roc_points(df, p, y, key)
    before = Window.partitionBy(key).orderBy(F.col("threshold").desc())
    steps = points.withColumn(
        "t0",
        F.coalesce(F.lag("tpr").over(before), F.lit(0.0))
    ).withColumn("f0", F.coalesce(F.lag("fpr").over(before), F.lit(0.0)))
    return steps.groupBy(key).agg(
        F.sum((F.col("fpr") - F.col("f0")) * (F.col("tpr") + F.col("t0")) / 2).alias("auc"),
        F.sum((F.col("tpr") - F.col("t0")) * F.col("precision")).alias("average_precision"),
        F.max_by("threshold", F.struct("youden", "threshold")).alias("youden_threshold"),
    )


def brier(p: str, y: str) -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), 2))


def calibration(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(at.alias("bin")).agg(
        F.avg(p).alias("mean_p"),
        F.avg(y).alias("rate"),
        F.count("*").alias("n")
    )


def sample_skew(x: str) -> Column:
    """Bias-corrected skewness."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def event_study(df: DataFrame, event: Column, horizons: dict[str, str]) -> DataFrame:
    """horizon, n, mean, hit, p10, p50, p90 of the forward-return columns on event rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("ret")) for h, c in horizons.items()]))
    rows = df.where(event).select(pairs.alias("e")).select("e.*").where("ret is not null")
    sums = rows.groupBy("horizon").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.avg((F.col("ret") > 0).cast("double")).alias("hit"))
    return sums.join(pooled_quantiles(rows, ["horizon"], "ret", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), "horizon")


#: Names and dates of a block of pairwise_corr: two blocks of names meet in a task for each block of dates.
NAMES, DATES = 1024, 1024


def pairwise_corr(df: DataFrame, name: str, value: str, on: str, least: int, best: int | None = None, names: int = NAMES, dates: int = DATES) -> DataFrame:
    """a, b, corr, n for each pair of names with a common date, a < b; corr is null under `least` common dates or without variation.

    Names are dealt to blocks of about `names`, dates to blocks of about `dates`. A task takes two blocks of names on a
    block of dates and multiplies matrices; sums of blocks of dates are then added for each two blocks of names. What is
    shuffled are the rows, once for each block of names, and these sums, never pairs of rows. With `best`, each two
    blocks give back only their pairs of the highest |corr|, of which there are enough for the best overall. Several
    values of a name on a date are averaged.
    """
    kind = dict(df.dtypes)[name]
    rows = df.where(F.col(value).isNotNull() & F.col(name).isNotNull() & F.col(on).isNotNull())
    rows = kept(rows.groupBy(F.col(on).alias("on"), F.col(name).alias("name")).agg(F.avg(value).cast("double").alias("x")), "pair-values")
    n_names, n_dates = rows.agg(F.approx_count_distinct("name"), F.approx_count_distinct("on")).first()
    blocks, spans = max(1, -(-n_names // names)), max(1, -(-n_dates // dates))
    # sums about a name's mean do not cancel
    means = rows.groupBy("name").agg(F.avg("x").alias("_mean"))
    rows = rows.join(means, "name").select("on", "name", (F.col("x") - F.col("_mean")).alias("x"))
    own = F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")
    rows = rows.withColumn("own", own).withColumn("span", F.pmod(F.xxhash64("on"), F.lit(spans)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("on", "name", "x", "own", "span", F.least("own", "other").alias("l"), F.greatest("own", "other").alias("r"))

    def matrix(rows: pa.Table, dates: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        labels = pc.unique(rows.column("name"))
        labels = labels.take(pc.sort_indices(labels))
        at = pc.index_in(rows.column("name"), labels).to_numpy()
        out = np.full((len(dates), len(labels)), np.nan)
        out[np.searchsorted(dates, rows.column("_at").to_numpy()), at] = rows.column("x").to_numpy()
        return labels, out

    def products(part: pa.Table) -> pa.Table:
        l, r, span = (part.column(c)[0].as_py() for c in ("l", "r", "span"))
        at = part.column("on").combine_chunks().dictionary_encode().indices.to_numpy()
        part = part.append_column("_at", pa.array(at))
        every = np.unique(at)
        sides = [matrix(part.filter(pc.equal(part.column("own"), s)), every) for s in (l, r)]
        (a, x), (b, y) = sides
        m, k = (~np.isnan(v) for v in (x, y))
        x, y, m, k = np.nan_to_num(x), np.nan_to_num(y), m.astype(float), k.astype(float)
        sums = [m.T @ k, x.T @ k, m.T @ y, (x * x).T @ k, m.T @ (y * y), x.T @ y]
        return pa.table(
            {
                "l": pa.array([l], pa.int32()), "r": pa.array([r], pa.int32()), "span": pa.array([span], pa.int32()), "a": pa.array([a.to_pylist()], pa.list_(a.type)),
                "b": pa.array([b.to_pylist()], pa.list_(b.type)), "sums": pa.array([np.stack(sums).tobytes()], pa.binary()),
            }
        )

    def pairs(part: pa.Table) -> pa.Table:
        a, b = ([v for v in part.column(c).to_pylist()] for c in ("a", "b"))
        left, right = sorted({x for v in a for x in v}), sorted({x for v in b for x in v})
        total = np.zeros((6, len(left), len(right)))
        of = {x: i for i, x in enumerate(left)}, {x: i for i, x in enumerate(right)}
        for p, q, raw in zip(a, b, part.column("sums").to_pylist(), strict=True):
            if p and q:
                i, j = np.array([of[0][x] for x in p]), np.array([of[1][x] for x in q])
                total[:, i[:, None], j[None]] += np.frombuffer(raw).reshape(6, len(p), len(q))
        n, x, y, xx, yy, xy = total
        with np.errstate(all="ignore"):
            scale = np.sqrt(np.maximum(xx - x * x / n, 0) * np.maximum(yy - y * y / n, 0))
            corr = np.where((n >= max(least, 2)) & (scale / (n - 1) > 1e-15), (xy - x * y / n) / scale, np.nan)
        i, j = np.nonzero(n)
        if part.column("l")[0].as_py() == part.column("r")[0].as_py():
            i, j = i[i < j], j[i < j]
        values, n = corr[i, j], n[i, j].astype(np.int64)
        low = [left[p] < right[q] for p, q in zip(i.tolist(), j.tolist(), strict=True)]
        a, b = ([(left[p] if z == s else right[q]) for p, q, z in zip(i.tolist(), j.tolist(), low, strict=True)] for s in (True, False))
        out = pa.table({"a": pa.array(a, part.schema.field("a").type.value_type), "b": pa.array(b, part.schema.field("b").type.value_type),
                        "corr": pa.array(values, from_pandas=True), "n": pa.array(n)})
        if best is None or len(n) <= best:
            return out
        size = pc.fill_null(pc.abs(out.column("corr")), -1.0)
        order = out.append_column("_size", size).sort_by([("_size", "descending"), ("a", "ascending"), ("b", "ascending")])
        return order.slice(0, best).drop_columns(["_size"])

    sums = rows.groupBy("l", "r", "span").applyInArrow(products, f"l int, r int, span int, a array<{kind}>, b array<{kind}>, sums binary")
    return sums.groupBy("l", "r").applyInArrow(pairs, f"a {kind}, b {kind}, corr double, n long")


def top_pairs(df: DataFrame, name: str, value: str, on: str, least: int, k: int) -> DataFrame:
    """The k pairs of pairwise_corr with the highest |corr|, equal ones by name."""
    return pairwise_corr(df, name, value, on, least, k).orderBy(F.abs("corr").desc_nulls_last(), "a", "b").limit(k)


def log_choose(n: Column, k: Column) -> Column:
    """ln of n over k."""
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def fisher_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided p of a 2 x 2 table: chance of at least a, given the margins.

    Terms beyond 12 standard deviations from the mean (or from a, above it) add less than 1e-20 and are left out, so
    that a table of N rows takes some sqrt(N) terms.
    """
    n, row, column = a + b + c + d, a + b, a + c
    mean = row * column / F.greatest(n, F.lit(1))
    deviation = F.sqrt(mean * (n - row) / F.greatest(n, F.lit(1)) * (n - column) / F.greatest(n - 1, F.lit(1)))
    base = log_choose(n, column)
    first = F.greatest(a.cast("double"), F.floor(mean - 12 * deviation) - 2, row + column - n, F.lit(0)).cast("long")
    last = F.least(row, column, F.ceil(F.greatest(a, mean) + 12 * deviation) + 50).cast("long")
    chance = lambda k: F.exp(log_choose(row, k) + log_choose(n - row, column - k) - base)
    return F.least(
        F.lit(1.0),
        F.aggregate(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, k: s + chance(k))
    )


def enrichment(df: DataFrame, subset: Column, label: Column) -> DataFrame:
    """a, b, c, d, odds_ratio, p of label inside against outside the subset."""
    n = lambda x: F.sum(F.when(x, 1).otherwise(0)).cast("long")
    s, y = F.coalesce(subset, F.lit(False)), F.coalesce(label, F.lit(False))
    table = df.groupBy().agg(n(s & y).alias("a"), n(s & ~y).alias("b"), n(~s & y).alias("c"), n(~s & ~y).alias("d"))
    odds = F.try_divide((F.col("a") * F.col("d")).cast("double"), F.col("b") * F.col("c"))
    return table.withColumn("odds_ratio", odds).withColumn("p", fisher_greater(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
