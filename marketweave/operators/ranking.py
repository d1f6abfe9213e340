"""Walk-forward ranking of a cross section: features, grades, preprocessing, signs, fits by fold, scores and their metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cross_section as xs
from . import inference as inf
from . import metrics as m

#: fit(rows with features (a vector) and label, parameters) -> a model with transform, which adds prediction.
Fit = Callable[[DataFrame, dict], object]
RANKERS: dict[str, Fit] = {}


def register_ranker(name: str) -> Callable[[Fit], Fit]:
    """Adds a fit to RANKERS; a name that is taken is an error."""

    def add(fit: Fit) -> Fit:
        if name in RANKERS:
            raise ValueError(f"ranker {name} is there already")
        RANKERS[name] = fit
        return fit

    return add


@register_ranker("linear")
def linear(rows: DataFrame, parameters: dict):
    return LinearRegression(featuresCol="features", labelCol="label", **{"regParam": 0.0, **parameters}).fit(rows)


def linear_folds(rows: DataFrame, folds: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """fold, weights (intercept first): least squares of label on the features over each fold's training span.

    Every fold's Gram matrix is summed in one pass: a row counts in each fold whose span it is in, and a fold comes back
    as one row of (features + 1) squared numbers. Singular matrices get the least-norm fit.
    """
    terms = {"one": F.lit(1.0), **{c: F.col(c).cast("double") for c in features}, "label": F.col("label")}
    names = list(terms)
    spans = F.broadcast(folds.select("fold", "train_start", "train_end"))  # a row for each test span of the calendar
    train = rows.join(spans, F.col("pos").between(F.col("train_start"), F.col("train_end")))
    sums = train.groupBy("fold").agg(*[F.sum(terms[a] * terms[b]).alias(f"{a}*{b}") for i, a in enumerate(names) for b in names[i:]])
    out = []
    for r in sums.collect():
        square = np.array([[r[f"{a}*{b}"] if i <= j else r[f"{b}*{a}"] for j, b in enumerate(names)] for i, a in enumerate(names)])
        mean = square[0] / square[0, 0]
        centred = square / square[0, 0] - np.outer(mean, mean)
        slopes = np.linalg.pinv(centred[1:-1, 1:-1], rcond=1e-12, hermitian=True) @ centred[1:-1, -1]
        out.append((r["fold"], [float(mean[-1] - mean[1:-1] @ slopes), *map(float, slopes)]))
    return rows.sparkSession.createDataFrame(out, "fold int, weights array<double>")


@register_ranker("gbt")
def gbt(rows: DataFrame, parameters: dict):
    return GBTRegressor(featuresCol="features", labelCol="label", **{"maxIter": 20, "maxDepth": 3, "seed": 0, **parameters}).fit(rows)


@dataclass(frozen=True)
class RankConfig:
    """features: columns; target: forward return; grades: classes of the target that the fit aims at (None: the target)."""

    features: tuple[str, ...]
    target: str = "fwd"
    model: str = "linear"
    parameters: dict = field(default_factory=dict)
    grades: int | None = 5
    least: int = 10
    preprocess: bool = True
    align_signs: bool = True
    top_k: int = 7


def prepare(df: DataFrame, cfg: RankConfig) -> DataFrame:
    """date, pos, ticker, the features (z-scores per date, turned so that higher is better), target and label."""
    rows = df.where(" and ".join(f"{c} is not null" for c in (*cfg.features, cfg.target)))
    if cfg.grades:
        rows = xs.grades(
            rows,
            cfg.target,
            cfg.grades,
            cfg.least,
            "label"
        ).where("label is not null").withColumn("label", F.col("label").cast("double"))
    else:
        rows = rows.withColumn("label", F.col(cfg.target))
    rows = rows.select("date", "pos", "ticker", F.col(cfg.target).alias("target"), "label", *cfg.features)
    if cfg.preprocess:
        for c in cfg.features:
            rows = xs.winsorized_zscore(rows, c, name="_z").withColumn(c, F.coalesce("_z", F.lit(0.0))).drop("_z")
    if cfg.align_signs:
        long = rows.select("target", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in cfg.features])))
        signs = {r.feature: r.sign for r in xs.flip_signs(long, "target").collect()}  # a number per feature
        rows = rows.withColumns({c: F.col(c) * signs.get(c, 1) for c in cfg.features})
    return rows


def walk_forward_scores(df: DataFrame, folds: DataFrame, cfg: RankConfig) -> DataFrame:
    """fold, date, ticker, score, target: each fold's model scores the rows of its test span.

    folds: as of inference.make_folds. The plain linear ranker fits all folds in one aggregate (linear_folds); another fit is
    a distributed job for each fold. Folds without training or test rows are left out. The prepared rows are written once. An unknown model is an error, and so is no score at all.
    """
    if cfg.model not in RANKERS:
        raise KeyError(f"unknown ranker {cfg.model}; known: {', '.join(sorted(RANKERS))}")
    path = inf.scratch(df.sparkSession, "ranking")
    VectorAssembler(inputCols=list(cfg.features), outputCol="features").transform(prepare(df, cfg)).write.parquet(path)
    rows, out = df.sparkSession.read.parquet(path), None
    if RANKERS[cfg.model] is linear and not cfg.parameters:
        weights = F.broadcast(folds.select(F.col("fold").cast("int").alias("fold"), "test_start", "test_end").join(linear_folds(rows, folds, cfg.features), "fold"))
        test = rows.join(weights, F.col("pos").between(F.col("test_start"), F.col("test_end")))
        score = F.get("weights", F.lit(0))
        for i, c in enumerate(cfg.features):
            score = score + F.get("weights", F.lit(i + 1)) * F.col(c)
        scores = test.select("fold", "date", "ticker", score.alias("score"), "target")
        if not scores.limit(1).count():
            raise ValueError("no fold has training and test rows")
        return scores
    for f in folds.orderBy("fold").collect():  # a row per test span of the calendar
        train, test = rows.where(F.col("pos").between(f.train_start, f.train_end)), rows.where(F.col("pos").between(f.test_start, f.test_end))
        if not train.limit(1).count() or not test.limit(1).count():
            continue
        scored = RANKERS[cfg.model](train, cfg.parameters).transform(test)
        part = scored.select(F.lit(f.fold).cast("int").alias("fold"), "date", "ticker", F.col("prediction").alias("score"), "target")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fold has training and test rows")
    return out


def rank_metrics(scores: DataFrame, top_k: int, least: int = 5) -> DataFrame:
    """fold, n, mean and icir of the rank correlation of score and target per date, and the mean target of the top_k scores."""
    ic = m.ic_stats(m.spearman_ic(scores, "score", "target", least, ["date", "fold"]), ["fold"])
    top = xs.top_k(scores, "score", top_k).groupBy("fold", "date").agg(F.avg("target").alias("top")).groupBy("fold").agg(
        F.avg("top").alias("top_mean")
    )
    return ic.join(top, "fold")


def wide_scores(scores: DataFrame, tickers: list[str]) -> DataFrame:
    """date and a column of scores for each of the given tickers."""
    return scores.groupBy("date").pivot("ticker", tickers).agg(F.first("score"))
