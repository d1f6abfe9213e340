"""Daily bars on a shared date grid, derived from the order lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .io import kept, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a dimension above which order lines meet it by shuffle and hash: lines are not sorted for it.
DIMENSION_ROWS = 2_000_000


def _dimension(rows: DataFrame) -> DataFrame:
    """rows for the small side of a join with order lines; Spark broadcasts it where it is small enough."""
    return rows.hint("shuffle_hash") if rows.count() > DIMENSION_ROWS else rows


def trades(spark: SparkSession, sf_dir: str, by: str = "brand", of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """date, ticker, price, quantity, amount and the order key of each order line: weeks by brand of the part, or days by nation of the supplier.

    Of the lines that `of` keeps, if given: it gets the table of lines with their dates.
    """
    line = table(spark, sf_dir, "lineitem")
    line = line.withColumn("date", F.to_date(F.date_trunc("week", "l_shipdate") if by == "brand" else F.col("l_shipdate")))
    line = of(line) if of else line
    if by == "brand":
        part = _dimension(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker")))
        line = line.join(part, line["l_partkey"] == part["p_partkey"])
    else:
        supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
        names = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select("s_suppkey", F.col("n_name").alias("ticker"))
        line = line.join(_dimension(names), line["l_suppkey"] == names["s_suppkey"])
    return line.select(
        "date",
        "ticker",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("at"),
    )


def sparse_bars(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """One row per date and ticker with trades: open and close are the prices of the first and last order line.

    Lines are read twice, each time without a sort: first for all that numbers sum up, the first and last order key among
    it; then only the lines of those orders, of which the first and last line are looked up. Bars are small beside the
    lines, so both results are written.
    """
    order = F.coalesce("l_orderkey", F.lit(-(2**63)))  # a missing key comes first
    every = trades(spark, sf_dir, by).withColumn("_order", F.coalesce("at.l_orderkey", F.lit(-(2**63))))
    totals = kept(
        every.groupBy("date", "ticker").agg(
            F.max("price").alias("high"), F.min("price").alias("low"), F.sum("quantity").alias("volume"), F.sum("amount").alias("turnover"),
            F.min("_order").alias("_first"), F.max("_order").alias("_last"),
        ),
        f"totals-{by}"
    )
    ends = totals.select(F.col("date").alias("_date"), F.explode(F.array("_first", "_last")).alias("_end")).distinct()
    few = trades(
        spark,
        sf_dir,
        by,
        lambda lines: lines.join(F.broadcast(ends), lines["date"].eqNullSafe(F.col("_date")) & (order == F.col("_end")), "left_semi")
    )
    edges = few.groupBy(F.col("date").alias("_date"), F.col("ticker").alias("_ticker")).agg(
        F.min_by("price", "at").alias("open"),
        F.max_by("price", "at").alias("close")
    )
    both = totals["date"].eqNullSafe(edges["_date"]) & totals["ticker"].eqNullSafe(edges["_ticker"])
    return kept(totals.join(edges, both).select("date", "ticker", "open", "high", "low", "close", "volume", "turnover"), f"sparse-{by}")


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker and shares_outstanding: a static snapshot, the sum of a brand's retail prices."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("ticker")).agg(F.sum("p_retailprice").alias("shares_outstanding"))


def calendar(rows: DataFrame) -> DataFrame:
    """date and its place pos in the calendar: a dimension with a row per trading day."""
    return rows.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def densify(rows: DataFrame) -> DataFrame:
    """rows on the full grid of dates and tickers; pos counts dates from 0. Both sides of the grid are dimensions."""
    grid = calendar(rows).crossJoin(rows.select("ticker").distinct())
    return grid.join(rows, ["date", "ticker"], "left")


#: Paths of the bars that an application has written, by application, folder and kind.
_KEPT: dict[tuple[str, str, str], str] = {}


def bars(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """date, pos, ticker, open, high, low, close, volume, turnover and, by brand, shares_outstanding and mkt_cap.

    Bars are small beside the order lines, and nearly every study begins with them: an application derives them once from
    a folder's tables and writes them, laid out by ticker and date, and reads them from then on. fresh_bars derives them anew.
    """
    key = (spark.sparkContext.applicationId, sf_dir, by)
    if key not in _KEPT:
        path = scratch(spark, f"bars-{by}")
        fresh_bars(spark, sf_dir, by).repartition("ticker").sortWithinPartitions("ticker", "date").write.parquet(path)
        _KEPT[key] = path
    return spark.read.parquet(_KEPT[key])


def fresh_bars(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """bars, derived from the order lines."""
    grid = densify(sparse_bars(spark, sf_dir, by))
    if by == "brand":
        grid = grid.join(shares(spark, sf_dir), "ticker", "left").withColumn("mkt_cap", F.col("close") * F.col("shares_outstanding"))
    return grid


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker (nation) and sector (region)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_name").alias("ticker"),
        F.col("r_name").alias("sector")
    )


def member_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, change_date, direction: order statuses as membership changes of 25 codes named like brands (O: in, F: out)."""
    orders = table(spark, sf_dir, "orders")
    direction = F.when(F.col("o_orderstatus") == "O", "in").when(F.col("o_orderstatus") == "F", "out")
    return orders.select(
        F.col("o_orderkey").alias("event_id"),
        F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("code"),
        F.to_date("o_orderdate").alias("change_date"),
        direction.alias("direction")
    ).where("direction is not null")
