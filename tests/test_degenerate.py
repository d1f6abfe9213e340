"""Queries on panels without variation: divisions by zero are null, and ties by chance decide nothing."""

import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from marketweave.operators import metrics
from marketweave.plans import cross_queries, research_queries

SCHEMA = "date date, ticker string, score double, ret double"


def flat(spark, score):
    day = datetime.date(2024, 1, 1)
    rows = [(day + datetime.timedelta(i), t, score, 0.01 * i) for t in "ab" for i in range(4)]
    return spark.createDataFrame(rows, SCHEMA)


def test_level_that_no_score_passes_has_no_sharpe(spark):
    found = {r.param_id: r for r in research_queries._grid_backtest(flat(spark, 0.15)).collect()}
    assert sorted(found) == [1, 2, 3, 4]
    assert found[1].sharpe > 0 and found[2].sharpe > 0
    assert [(found[k].mean, found[k].std, found[k].sharpe) for k in (3, 4)] == [(0.0, 0.0, None)] * 2


def test_equal_scores_have_no_panel_zscore(spark, monkeypatch):
    monkeypatch.setattr(cross_queries, "panel", lambda s, d: flat(s, 0.5))
    assert [r.z for r in cross_queries.QUERIES["xs02_panel_zscore"](spark, "").collect()] == [None] * 8


def test_rank_correlation_of_zero_is_exactly_zero(spark):
    draw, rows = random.Random(7), []
    while len(rows) < 30 * 25:
        b = draw.sample(range(25), 25)
        if sum((i - x) ** 2 for i, x in enumerate(b)) == 2600:  # the rank correlation of 25 is 0
            rows += [(len(rows) // 25, i / 7, x / 3) for i, x in enumerate(b)]
    draw.shuffle(rows)
    ic = metrics.spearman_ic(spark.createDataFrame(rows, "date int, s double, r double"), "s", "r", 5)
    assert [r.ic for r in ic.collect()] == [0.0] * 30
    assert metrics.ic_stats(ic.withColumn("k", F.lit(1)), ["k"]).first().hit == 0.0


def test_rank_correlation_with_ties_and_without_variation(spark):
    rows = [("a", float(x), float(y)) for x, y in zip((1, 2, 2, 4, 5), (3, 1, 4, 4, 4), strict=True)] + [("b", 1.0, float(i)) for i in range(5)]
    found = {r.date: r for r in metrics.spearman_ic(spark.createDataFrame(rows, "date string, s double, r double"), "s", "r", 5).collect()}
    # ranks 1, 2.5, 2.5, 4, 5 and 2, 1, 4, 4, 4
    assert abs(found["a"].ic - np.corrcoef([1, 2.5, 2.5, 4, 5], [2, 1, 4, 4, 4])[0, 1]) < 1e-12
    assert found["b"].ic is None and found["b"].n == 5
