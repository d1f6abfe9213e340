"""Sources around filings: seed indexes, price windows, extraction artifacts, model exports, manifests, share tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import load_any, require

#: Keys that an entry of the manual-input manifest must have (fixed values).
MANIFEST_KEYS = ("name", "owner", "source_note", "last_updated", "validation_status", "downstream_datasets")
#: Days around the first and last publication for which prices are kept (fixed value).
PRICE_MARGIN = 30


class Indexer(Protocol):
    """Finds the filings of an issuer between two years: rows of operators.filings.SEED_FIELDS, with stock_code and language."""

    def __call__(self, spark: SparkSession, stock_code: str, start_year: int, end_year: int, language: str = "EN") -> DataFrame: ...


class SeedFolder:
    """An Indexer over prepared files: {folder}/{stock_code}.csv and .jsonl, all columns as text; a code without files has no rows.

    Files are prepared for the years, so years choose nothing here. Missing codes and languages get the arguments.
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def __call__(self, spark: SparkSession, stock_code: str, start_year: int, end_year: int, language: str = "EN") -> DataFrame:
        found = spark.createDataFrame([], "stock_code string, title string, language string")
        for path in (f"{self.folder}/{stock_code}{suffix}" for suffix in (".csv", ".jsonl")):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                rows = load_any(spark, path)
                found = found.unionByName(rows.select([F.col(c).cast("string") for c in rows.columns]), allowMissingColumns=True)
        return found.withColumns({"stock_code": F.coalesce("stock_code", F.lit(stock_code)), "language": F.coalesce("language", F.lit(language))})


#: Indexers by name.
INDEXERS: dict[str, Callable[[str], Indexer]] = {"seeds": SeedFolder}


def discover(spark: SparkSession, indexer: Indexer, codes: list[str], start_year: int, end_year: int, language: str = "EN") -> DataFrame:
    """The seed rows that an indexer finds for the codes, for operators.filings.filing_index."""
    found = [indexer(spark, c, start_year, end_year, language) for c in codes]
    out = found[0] if found else spark.createDataFrame([], "stock_code string, title string, language string")
    for part in found[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def seed_index(spark: SparkSession, paths: list[str], schema: str, stock_code: str | None = None, language: str = "EN") -> DataFrame:
    """Prepared CSV and JSON-lines indexes as one table; missing stock codes and languages get the defaults."""
    parts = [load_any(spark, p, schema) for p in paths]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    for name, value in (("stock_code", stock_code), ("language", language)):
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    return rows


def price_window(prices: DataFrame, index: DataFrame, issuers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prices of the issuers in index around their publications, and one row that says what was kept.

    issuers: stock_code, ticker. The window is PRICE_MARGIN days before the first publication to as many after the last.
    """
    dates = index.agg(F.date_sub(F.min("publish"), PRICE_MARGIN).alias("first"), F.date_add(F.max("publish"), PRICE_MARGIN).alias("last"))
    wanted = issuers.join(index.select("stock_code").distinct(), "stock_code", "left_semi").select("ticker").distinct()
    kept = prices.join(
        F.broadcast(dates),
        F.col("date").between(F.col("first"), F.col("last"))
    ).drop("first", "last").join(wanted, "ticker", "left_semi")
    tickers = wanted.agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))  # a dimension: one name an issuer
    return kept, dates.crossJoin(tickers).withColumn("fill_method", F.lit("none"))  # one row each


def write_extraction(facts: DataFrame, index: DataFrame, path: str) -> DataFrame:
    """Writes facts as Parquet by stock_code and period_end; returns the log: filing_id and how many facts it has (0 too)."""
    rows = facts.join(index.select("filing_id", "stock_code", "period_end"), "filing_id")
    rows.repartition("stock_code", "period_end").write.mode("overwrite").partitionBy("stock_code", "period_end").parquet(path)
    return index.select("filing_id").join(facts.groupBy("filing_id").agg(F.count("*").alias("facts")), "filing_id", "left").fillna(0, ["facts"])


def export_model(outputs: DataFrame, path: str) -> None:
    """Three Parquet tables of the model's outputs: book, revalued scenarios, and the discounts of all."""
    outputs.where("scenario = 'book'").write.mode("overwrite").parquet(f"{path}/book_nav_timeseries")
    outputs.where("scenario like 'rnav\\\\_%'").write.mode("overwrite").parquet(f"{path}/rnav_timeseries")
    discount = outputs.select("stock_code", "period_end", "scenario", "price", "nav_per_share", "discount")
    discount.write.mode("overwrite").parquet(f"{path}/discount_to_nav_timeseries")


def check_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a manual-input manifest (JSON, a list under manual_inputs); a missing key is an error."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "manual_inputs array<map<string,string>>")["manual_inputs"]).alias("entry"))
    lacks = F.array_except(F.array(*map(F.lit, MANIFEST_KEYS)), F.map_keys("entry"))
    bad = entries.where(F.size(lacks) > 0).select(F.col("entry")["name"].alias("name"), lacks.alias("lacks")).first()  # a row per hand-kept file
    if bad is not None:
        raise ValueError(f"manifest entry {bad['name']} lacks {sorted(bad['lacks'])}")
    return entries.select(*[F.col("entry")[k].alias(k) for k in MANIFEST_KEYS])


def save_shares(
    shares: DataFrame,
    path: str,
    asof: str | None = None,
    price_asof: str | None = None,
    source: str = "market cap / latest close"
) -> None:
    """ticker and estimated_shares with their dates and source, as Parquet or CSV by suffix; other suffixes are an error."""
    rows = shares.select(F.col("ticker").cast("string"), F.col("estimated_shares").cast("double"))
    for name, value in (("asof_date", asof), ("px_asof_date", price_asof)):
        rows = rows.withColumn(name, F.lit(value)) if value is not None else rows
    writer = rows.withColumn("source", F.lit(source)).write.mode("overwrite")
    if path.endswith((".parquet", ".pq")):
        writer.option("compression", "zstd").parquet(path)
    elif path.endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown suffix: {path}")


def load_shares(spark: SparkSession, path: str) -> DataFrame:
    """ticker and estimated_shares; the first column may be named Ticker. Other names are an error."""
    rows = load_any(spark, path)
    found = [c for c in ("ticker", "Ticker") if c in rows.columns]
    require(rows, ["estimated_shares"] if found else ["ticker", "estimated_shares"])
    return rows.select(F.col(found[0]).alias("ticker"), F.col("estimated_shares").cast("double").alias("estimated_shares"))


def vendor_tables(load: Callable[[str], DataFrame], names: tuple[str, ...] = ("valuation", "income", "indicator")) -> dict[str, DataFrame]:
    """The vendor's three yearly tables by name, each as load(name) gives it."""
    return {name: load(name) for name in names}
