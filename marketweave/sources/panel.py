"""The research panel: weekly average prices by brand with a momentum score and forward returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import change, div, ref, staged
from .bars import bars

#: Rows of the score's lookback and of the holding period.
LOOKBACK, HOLD = 4, 2


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, pos, ticker, px, ret, score, fwd, mcap, sector, volume on the dense weekly grid."""
    rows = bars(spark, sf_dir).select("date", "pos", "ticker", "volume", "shares_outstanding", F.round(div("turnover", "volume"), 6).alias("px"))
    return staged(
        rows,
        ret=change("px"), score=change("px", LOOKBACK), fwd=div(ref("px", -(HOLD + 1)), ref("px", -1)) - 1,
        mcap=F.col("px") * F.col("shares_outstanding"),
        sector=F.concat(F.lit("S"), (F.regexp_extract("ticker", r"(\d+)", 1).cast("int") % 5).cast("string")),
    )
