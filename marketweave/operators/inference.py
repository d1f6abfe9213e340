"""Walk-forward fits and resampling tests."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import trailing
from ..sources.io import scratch
from .blocks import ROWS, Scan, kept, scan


def expanding_trend(df: DataFrame, y: str, least: int = 10, key: str = "ticker", order: str = "date", t: str = "pos") -> DataFrame:
    """forecast of y from a line through all earlier rows, its error, the error of the last value, and the slope's t value."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = F.when(F.col(y).isNotNull(), F.col(t).cast("double"))
    n, slope, base = F.count(y).over(w), F.regr_slope(F.col(y), x).over(w), F.regr_intercept(F.col(y), x).over(w)
    df = df.withColumn("_n", n).withColumn("_b", slope).withColumn("_a", base).withColumn(
        "_sxx",
        F.regr_sxx(F.col(y), x).over(w)
    ).withColumn("_syy", F.regr_syy(F.col(y), x).over(w))
    df = df.withColumn("_last", F.last(y, ignorenulls=True).over(w))
    rest = F.greatest(F.col("_syy") - F.col("_b") * F.col("_b") * F.col("_sxx"), F.lit(0.0))
    known = F.col("_n") >= least
    df = df.withColumn("forecast", F.when(known, F.col("_a") + F.col("_b") * F.col(t)))
    df = df.withColumn("error", F.col(y) - F.col("forecast")).withColumn("naive_error", F.when(known, F.col(y) - F.col("_last")))
    return df.withColumn(
        "t_value",
        F.when(known, F.try_divide(F.col("_b"), F.sqrt(F.try_divide(rest, (F.col("_n") - 2) * F.col("_sxx")))))
    ).drop("_n", "_a", "_b", "_sxx", "_syy", "_last")


def rolling_forecast(df: DataFrame, y: str, n: int, quantile: float, key: str = "ticker", order: str = "date", t: str = "pos") -> DataFrame:
    """forecast from the n rows before, its interval by the given quantile, and z of the outcome."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    x = F.col(t).cast("double")
    known = F.count(y).over(w) == n
    slope, base = F.regr_slope(F.col(y), x).over(w), F.regr_intercept(F.col(y), x).over(w)
    df = df.withColumn("_b", F.when(known, slope)).withColumn("_a", F.when(known, base)).withColumn(
        "_sxx",
        F.regr_sxx(F.col(y), x).over(w)
    ).withColumn("_syy", F.regr_syy(F.col(y), x).over(w)).withColumn("_mx", F.avg(x).over(w))
    rest = F.greatest(F.col("_syy") - F.col("_b") * F.col("_b") * F.col("_sxx"), F.lit(0.0)) / (n - 2)
    spread = F.sqrt(rest * (1 + 1 / n + F.try_divide(F.pow(x - F.col("_mx"), 2), F.col("_sxx"))))
    df = df.withColumn("forecast", F.col("_a") + F.col("_b") * x).withColumn("_s", spread)
    return df.withColumn("low", F.col("forecast") - quantile * F.col("_s")).withColumn("high", F.col("forecast") + quantile * F.col("_s")).withColumn(
        "z",
        F.try_divide(F.col(y) - F.col("forecast"), F.col("_s"))
    ).drop("_a", "_b", "_sxx", "_syy", "_mx", "_s")


def split_rmse(df: DataFrame, y: str, x: str, train: Column, key: str) -> DataFrame:
    """Line fitted on the training rows of a key: rmse there, on the rest, and of the training mean on the rest."""
    yt, xt = F.when(train, F.col(y)), F.when(train & F.col(y).isNotNull(), F.col(x))
    fit = df.groupBy(key).agg(F.regr_slope(yt, xt).alias("_b"), F.regr_intercept(yt, xt).alias("_a"), F.avg(yt).alias("_m"))
    rows = df.join(fit, key).withColumn("_e", F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).withColumn("_t", train)
    rms = lambda e, on: F.sqrt(F.avg(F.when(on, e * e)))
    return rows.groupBy(key).agg(
        rms(F.col("_e"), F.col("_t")).alias("train"),
        rms(F.col("_e"), ~F.col("_t")).alias("test"),
        rms(F.col(y) - F.col("_m"), ~F.col("_t")).alias("naive")
    )


def break_scan(df: DataFrame, y: str, least: int, key: str = "ticker", order: str = "date", t: str = "pos") -> DataFrame:
    """key, break_at, sse: the place where two lines fit best; sums after a place are the total less the prefix."""
    rows = df.where(F.col(y).isNotNull()).withColumn("_x", F.col(t).cast("double"))
    w, every = trailing(None, key, order), Window.partitionBy(key)
    terms = {
        "n": F.lit(1.0),
        "x": F.col("_x"),
        "y": F.col(y),
        "xx": F.col("_x") * F.col("_x"),
        "xy": F.col("_x") * F.col(y),
        "yy": F.col(y) * F.col(y)
    }
    for name, term in terms.items():
        rows = rows.withColumn(f"_p{name}", F.sum(term).over(w)).withColumn(f"_q{name}", F.sum(term).over(every) - F.col(f"_p{name}"))

    def sse(s: str) -> Column:
        n, x, v, xx, xy, yy = (F.col(f"_{s}{k}") for k in terms)
        sxx, sxy, syy = xx - x * x / n, xy - x * v / n, yy - v * v / n
        return syy - F.try_divide(sxy * sxy, sxx)

    rows = rows.where((F.col("_pn") >= least) & (F.col("_qn") >= least))
    return rows.withColumn("sse", sse("p") + sse("q")).groupBy(key).agg(F.min_by(t, F.struct("sse", t)).alias("break_at"), F.min("sse").alias("sse"))


def expanding_ols(df: DataFrame, y: str, xs: list[str], least: int, key: list[str], order: str = "date", rows: int = ROWS) -> DataFrame:
    """forecast of y by least squares on all earlier complete rows of the key, at least `least`.

    Gram matrices and moments are running sums, so that a block of a long key adds to those before it; the normal
    equations of many rows are solved together, by pseudo-inverses where they are singular.
    """
    width = len(xs) + 1

    def parts(c: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a = np.column_stack([np.ones(len(c[y])), *[c[x].astype(float) for x in xs]])
        b = c[y].astype(float)
        known = np.isfinite(a).all(axis=1)
        full = known & np.isfinite(b)
        return a, np.where(full[:, None], a, 0.0), np.where(full, b, 0.0), known

    def summarise(c: dict) -> list:
        a, used, b, _ = parts(c)
        return [(used.T @ used).tolist(), (used.T @ b).tolist(), int(used[:, 0].sum())]

    def fold(state: list, block: list) -> list:
        return [(np.array(u) + np.array(v)).tolist() for u, v in zip(state, block, strict=True)]

    def finish(c: dict, state: list) -> dict:
        a, used, b, known = parts(c)
        (gram, moment, n), out = (np.array(x, dtype=float) for x in state), np.full(len(b), np.nan)
        for begin in range(0, len(b), 4096):
            own = slice(begin, begin + 4096)
            grams = gram + np.cumsum(used[own, :, None] * used[own, None, :], axis=0)
            moments, counts = moment + np.cumsum(used[own] * b[own, None], axis=0), n + np.cumsum(used[own, 0])
            before = [np.concatenate([first[None], later[:-1]]) for first, later in ((gram, grams), (moment, moments), (n, counts))]
            fit = np.flatnonzero(known[own] & (before[2] >= least))
            inverse = np.linalg.pinv(before[0][fit], rcond=np.finfo(float).eps * width, hermitian=True)
            out[begin + fit] = np.einsum("ij,ijk,ik->i", a[own][fit], inverse, before[1][fit])
            gram, moment, n = grams[-1], moments[-1], counts[-1]
        return {"forecast": out}

    start = [np.zeros((width, width)).tolist(), [0.0] * width, 0]
    return scan(df, key, order, [*xs, y], {"forecast": "double"}, Scan(start, summarise, fold, finish), rows)


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Coefficients of a balanced ridge logistic regression on standardised x (intercept first) by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    penalty, b = np.eye(a.shape[1]) * ridge, np.zeros(a.shape[1])
    penalty[0, 0] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + penalty @ b
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(b)), gradient)
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _literal(spark, rows: list[dict], schema: str) -> DataFrame:
    """A few rows as a literal of the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def fit_folds(rows: DataFrame, xs: list[str], ridge: float, least_each: int, steps: int = 30) -> DataFrame:
    """fold, mean, scale, coef (arrays): a balanced ridge logistic regression for each fold of rows (fold, y, xs).

    All folds take their Newton steps together: a step is one aggregate of gradients and second derivatives, a few
    numbers a fold, over rows that stay distributed. Folds with under least_each of a label are left out.
    """
    spark, k = rows.sparkSession, len(xs)
    stats = rows.groupBy("fold").agg(
        F.count("*").alias("n"),
        F.sum("y").alias("pos"),
        F.array(*[F.avg(x) for x in xs]).alias("mean"),
        F.array(*[F.stddev_pop(x) for x in xs]).alias("scale")
    )
    folds = {r.fold: r for r in stats.collect() if r.pos >= least_each and r.n - r.pos >= least_each}  # a row per test span of the calendar
    known = {f: {"fold": f, "mean": list(r["mean"]), "scale": [s or 1.0 for s in r.scale], "coef": [0.0] * (k + 1)} for f, r in folds.items()}
    schema = "fold:int,mean:array<double>,scale:array<double>,coef:array<double>"
    penalty = np.diag([0.0] + [ridge] * k)
    pairs = [(i, j) for i in range(k + 1) for j in range(i + 1)]
    for _ in range(steps if known else 0):
        table = _literal(
            spark,
            [{**v, "yes": folds[f].n / (2 * folds[f].pos), "no": folds[f].n / (2 * (folds[f].n - folds[f].pos))} for f, v in known.items()],
            schema + ",yes:double,no:double"
        )
        a = [F.lit(1.0)] + [(F.col(x) - F.col("mean")[i]) / F.col("scale")[i] for i, x in enumerate(xs)]
        z = sum((F.col("coef")[i] * x for i, x in enumerate(a)), F.lit(0.0))
        each = rows.join(F.broadcast(table), "fold").select(
            "fold",
            "y",
            F.when(F.col("y") == 1, F.col("yes")).otherwise(F.col("no")).alias("w"),
            (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("p"),
            *[x.alias(f"a{i}") for i, x in enumerate(a)]
        )
        gradient = [F.sum(F.col("w") * (F.col("p") - F.col("y")) * F.col(f"a{i}")) for i in range(k + 1)]
        curve = [F.sum(F.col("w") * F.col("p") * (1 - F.col("p")) * F.col(f"a{i}") * F.col(f"a{j}")) for i, j in pairs]
        largest = 0.0
        for r in each.groupBy("fold").agg(F.array(*gradient).alias("g"), F.array(*curve).alias("h")).collect():
            b, h = np.array(known[r.fold]["coef"]), np.zeros((k + 1, k + 1))
            for (i, j), v in zip(pairs, r.h, strict=True):
                h[i, j] = h[j, i] = v
            step = np.linalg.solve(h + penalty + 1e-9 * np.eye(k + 1), np.array(r.g) + penalty @ b)
            known[r.fold]["coef"], largest = (b - step).tolist(), max(largest, float(np.abs(step).max()))
        if largest < 1e-8:
            break
    return _literal(spark, list(known.values()), schema)


def walk_forward_logistic(df: DataFrame, y: str, xs: list[str], folds: DataFrame, ridge: float = 1.0, least_each: int = 5) -> DataFrame:
    """fold, date, ticker, y, p: each fold's fit on its training rows scores its test rows; see fit_folds.

    folds: fold, train_start, train_end, test_start, test_end (row numbers), a row per test span of the calendar; folds
    with too few of a label are left out. The rows are written once, as each Newton step reads them again.
    """
    known = df.where(" and ".join(f"{c} is not null" for c in [y, *xs])).select(
        "date",
        "ticker",
        "pos",
        F.col(y).cast("double").alias("y"),
        *[F.col(c).cast("double").alias(c) for c in xs]
    )
    path = scratch(df.sparkSession, "walk-forward")
    known.write.parquet(path)
    rows, spans = df.sparkSession.read.parquet(path), F.broadcast(folds)
    train = rows.join(spans, F.col("pos").between(F.col("train_start"), F.col("train_end"))).select("fold", "y", *xs)
    fits = fit_folds(train, xs, ridge, least_each)
    test = rows.join(spans, F.col("pos").between(F.col("test_start"), F.col("test_end"))).join(F.broadcast(fits), "fold")
    z = sum((F.col("coef")[i + 1] * (F.col(x) - F.col("mean")[i]) / F.col("scale")[i] for i, x in enumerate(xs)), F.col("coef")[0])
    return test.select("fold", "date", "ticker", "y", (1 / (1 + F.exp(-z))).alias("p"))


def make_folds(calendar: DataFrame, train: int, test: int, purge: int) -> DataFrame:
    """fold, train_start, train_end, test_start, test_end in row numbers: consecutive tests after a purged training span."""
    last = calendar.agg(F.max("pos").alias("last"))
    starts = last.select(
        F.explode(F.sequence(F.lit(train + purge).cast("long"), F.col("last").cast("long"), F.lit(test).cast("long"))).alias("test_start"),
        "last"
    )
    return starts.select(
        ((F.col("test_start") - train - purge) / test).cast("int").alias("fold"),
        (F.col("test_start") - train - purge).alias("train_start"),
        (F.col("test_start") - purge - 1).alias("train_end"),
        "test_start",
        F.least(F.col("test_start") + test - 1, F.col("last").cast("long")).alias("test_end")
    )


def _seed(seed: int, key: str) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(str(key).encode())])


def shift_test(df: DataFrame, mask: str, r: str, tries: int, key: str, seed: int = 0) -> DataFrame:
    """key, observed, p: mean return where the mask holds, against circular shifts of the mask by random offsets.

    The means of all offsets of a key's series come from one Fourier transform, so that tries cost nothing but a look-up.
    """
    rows = df.where(F.col(r).isNotNull()).select(
        F.col(key).cast("string").alias(key),
        "date",
        F.coalesce(F.col(mask), F.lit(False)).alias("on"),
        F.col(r).cast("double").alias("r")
    )

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        on, x, n = part["on"].to_numpy(dtype=float), part["r"].to_numpy(), len(part)
        if not on.sum() or n < 2:
            return part[:0].rename(columns={"on": "observed", "r": "p"})[[key, "observed", "p"]].astype({"observed": float})
        means = np.fft.irfft(np.conj(np.fft.rfft(on)) * np.fft.rfft(x), n) / on.sum()
        observed = float(x[on > 0].mean())
        tried = means[_seed(seed, part[key].iloc[0]).integers(1, n, tries)]
        return part[:1][[key]].assign(observed=observed, p=(1 + (tried >= observed - 1e-12).sum()) / (1 + tries))

    return rows.groupBy(key).applyInPandas(run, f"{key} string, observed double, p double")


def draw_test(df: DataFrame, chosen: str, label: str, tries: int, key: str, seed: int = 0) -> DataFrame:
    """key, hits, p: labels among the chosen rows, against as many rows drawn without replacement.

    The labels among m rows drawn from N with K labels are hypergeometric, so that four counts of a key are all it takes.
    """
    c, y = F.coalesce(F.col(chosen), F.lit(False)), F.col(label).cast("boolean")
    n = lambda x: F.sum(x.cast("long"))
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(key).cast("string").alias(key)).agg(
        n(c & y).alias("hits"),
        n(c).alias("m"),
        n(y).alias("labels"),
        F.count("*").alias("n")
    ).where("m > 0")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            drawn = [
                _seed(seed, k).hypergeometric(lab, all_ - lab, m, tries) for k,
                lab,
                m,
                all_ in zip(part[key], part["labels"], part["m"], part["n"], strict=True)
            ]
            yield pd.DataFrame(
                {key: part[key], "hits": part["hits"], "p": [(1 + (d >= h).sum()) / (1 + tries) for d, h in zip(drawn, part["hits"], strict=True)]}
            )

    return counts.mapInPandas(run, f"{key} string, hits long, p double")


def hac_slope(df: DataFrame, y: str, x: str, lags: int, key: str, order: str = "date") -> DataFrame:
    """key, slope, t_value of a line with Newey-West errors (Bartlett weights); t_value is null under ten rows."""
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    fit = rows.groupBy(key).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("_a"),
        F.avg(x).alias("_mx"),
        F.regr_sxx(y, x).alias("_sxx")
    )
    rows = rows.join(fit, key).withColumn("_u", (F.col(x) - F.col("_mx")) * (F.col(y) - F.col("_a") - F.col("slope") * F.col(x)))
    w, spread = Window.partitionBy(key).orderBy(order), F.col("_u") * F.col("_u")
    for k in range(1, lags + 1):
        spread = spread + 2 * (1 - k / (lags + 1)) * F.col("_u") * F.coalesce(F.lag("_u", k).over(w), F.lit(0.0))
    rows = rows.withColumn("_v", spread)
    return rows.groupBy(key).agg(
        F.first("slope").alias("slope"),
        F.first("_sxx").alias("_sxx"),
        F.sum("_v").alias("_s"),
        F.count("*").alias("_n")
    ).select(
        key,
        "slope",
        F.when(F.col("_n") >= 10, F.try_divide(F.col("slope") * F.col("_sxx"), F.sqrt(F.greatest(F.col("_s"), F.lit(0.0))))).alias("t_value")
    )


def principal_components(df: DataFrame, names: list[str], k: int) -> DataFrame:
    """component, name, loading, share of variance of columns, over the rows in which none is missing; see components_of."""
    rows = df.where(" and ".join(f"`{n}` is not null" for n in names)).withColumn("_row", F.monotonically_increasing_id())
    long = rows.select("_row", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("double").alias("value")) for n in names])))
    return components_of(long, "_row", "name", "value", k)


#: Columns of a sketch beyond the wanted components, and its most multiplications by the covariances.
EXTRA, TURNS = 30, 40


def components_of(df: DataFrame, on: str, name: str, value: str, k: int, extra: int = EXTRA, turns: int = TURNS) -> DataFrame:
    """component, name, loading, share of variance of the k largest principal components of long data (on, name, value).

    Rows (values of `on`) that lack a name's value are left out; values of a name in one row are averaged. A sketch of
    k + extra columns, drawn from hashes of the names, is multiplied by the covariance matrix, which is never formed:
    each row's values are summed with the names' sketches, and each name's values with those sums. Sketches are made
    orthonormal by their small Gram matrix. It ends when the images of the components are multiples of them to 1e-8 of the
    largest, or after `turns` multiplications. A loading's sign makes
    the largest one positive. The driver sees matrices of k + extra columns and rows only.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(F.col(on).alias("_on"), F.col(name).alias("name")).agg(F.avg(value).alias("x"))
    rows = kept(rows, "values")
    n_names = rows.select("name").distinct().count()
    complete = rows.groupBy("_on").count().where(F.col("count") == n_names).select("_on")
    rows = rows.join(complete, "_on", "left_semi")
    means = rows.groupBy("name").agg(F.avg("x").alias("_mean"), F.var_samp("x").alias("_var"))
    rows = kept(rows.join(means, "name").select("_on", "name", (F.col("x") - F.col("_mean")).alias("x")), "centred")
    n_rows, total = complete.count(), means.agg(F.sum("_var")).first()[0] or 0.0
    width = min(k + extra, n_names)
    cols = [f"q{j}" for j in range(width)]
    empty = "component int, name string, loading double, share double"
    if n_rows < 2 or not width:
        return df.sparkSession.createDataFrame([], empty)

    def small(left: DataFrame, right: list[str]) -> np.ndarray:
        """Products of the columns q0... with the given ones, summed over names: a matrix from each partition, added up."""

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(cols), len(right)))
            for batch in batches:
                a, b = (np.column_stack([batch.column(c).to_numpy() for c in some]) for some in (cols, right))
                total += a.T @ b
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "x"])

        sums = left.select(*dict.fromkeys([*cols, *right])).mapInArrow(products, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        return np.array([x for _, x in sorted(map(tuple, sums))]).reshape(len(cols), len(right))

    def turned(table: DataFrame, matrix: np.ndarray) -> DataFrame:
        linear = lambda j: sum((F.col(c) * float(matrix[i, j]) for i, c in enumerate(cols)), F.lit(0.0))
        return table.select("name", *[linear(j).alias(f"q{j}") for j in range(matrix.shape[1])])

    def orthonormal(table: DataFrame) -> DataFrame:
        for _ in range(2):  # the second time removes what rounding left
            values, vectors = np.linalg.eigh(small(table, cols))
            scale = np.where(values > values.max() * 1e-13, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
            table = kept(turned(table, vectors * scale), "sketch")
        return table

    def multiplied(table: DataFrame) -> DataFrame:
        """The covariance matrix times the sketch, two aggregates."""
        rows_ = rows.join(table, "name").groupBy("_on").agg(*[F.sum(F.col("x") * F.col(c)).alias(c) for c in cols])
        return kept(rows.join(rows_, "_on").groupBy("name").agg(*[(F.sum(F.col("x") * F.col(c)) / (n_rows - 1)).alias(c) for c in cols]), "sketch")

    seed = lambda j: F.xxhash64("name", F.lit(j)).cast("double") / float(1 << 63)
    sketch = orthonormal(rows.select("name").distinct().select("name", *[seed(j).alias(c) for j, c in enumerate(cols)]))
    for _ in range(turns):
        image = multiplied(sketch)
        joined = sketch.join(image.select("name", *[F.col(c).alias(f"z{j}") for j, c in enumerate(cols)]), "name")
        core = small(joined, [f"z{j}" for j in range(width)])
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        order = np.argsort(values)[::-1][: min(k, width)]
        values, vectors = values[order], vectors[:, order]
        # how far the image of each component is from a multiple of it
        square = small(image, cols)
        rest = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", vectors, square, vectors) - values**2, 0))
        if width == n_names or (rest <= 1e-8 * max(values[0], 1e-300)).all():
            break
        sketch = orthonormal(image)
    found = kept(turned(sketch, vectors), "loadings")
    tops = found.agg(*[F.max_by(f"q{j}", F.struct(F.abs(f"q{j}"), "name")).alias(f"q{j}") for j in range(len(values))]).first()
    parts = [
        F.struct(
            F.lit(j + 1).alias("component"), F.col("name").cast("string").alias("name"),
            (F.col(f"q{j}") * (1.0 if (tops[f"q{j}"] or 0) >= 0 else -1.0)).alias("loading"), F.lit(float(v / max(total, 1e-300))).alias("share"),
        )
        for j, v in enumerate(values)
    ]
    return found.select(F.inline(F.array(*parts)))
