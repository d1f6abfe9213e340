"""Readers and writers of panels, vendor tables, factor stores and registries."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import clean, ffill

FIELDS = ("open", "high", "low", "close", "volume", "turnover")
#: Columns of a daily table of price limits (fixed values).
LIMIT_FIELDS = ("open", "close", "volume", "high_limit", "low_limit")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or on one machine the warehouse."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which ends its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def to_wide(bars: DataFrame, field: str, tickers: list[str]) -> DataFrame:
    """date and one column field__ticker for each of the given tickers."""
    wide = bars.groupBy("date").pivot("ticker", tickers).agg(F.first(field, ignorenulls=True))
    return wide.select("date", *[F.col(f"`{t}`").alias(f"{field}__{t}") for t in tickers])


def to_long(wide: DataFrame) -> DataFrame:
    """Columns field__ticker back to date, ticker and a column for each field; other column names are an error."""
    names = [c for c in wide.columns if c != "date"]
    if odd := [c for c in names if "__" not in c]:
        raise ValueError(f"not field__ticker: {odd}")
    fields = sorted({c.split("__", 1)[0] for c in names})
    long = wide.unpivot(["date"], names, "name", "value").withColumn("field", F.substring_index("name", "__", 1)).withColumn(
        "ticker",
        F.expr("substring(name, instr(name, '__') + 2)")
    )
    return long.groupBy("date", "ticker").pivot("field", fields).agg(F.first("value", ignorenulls=True))


def save_panel(bars: DataFrame, path: str) -> None:
    bars.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year").parquet(path)


def load_panel(spark: SparkSession, path: str, registry: DatasetRegistry | None = None, root: str = "") -> DataFrame:
    """A panel by path, or by the name that a registry knows; a name without a suffix is looked up there."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if registry is not None and "/" not in path and "." not in name:
        path = registry.resolve(path, root)
    return spark.read.parquet(path)


def load_with_provenance(
    spark: SparkSession,
    path: str,
    registry: DatasetRegistry,
    root: str = "",
    schema: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """A table by name or path, read by its suffix, and the registry's entries for it (no row, if it has none)."""
    name = path if "/" not in path and "." not in path else None
    entries = registry.read()
    entries = entries.where(F.col("dataset_name") == name) if name else entries.where(F.endswith(F.lit(path), F.col("path")))
    return load_any(spark, registry.resolve(path, root) if name else path, schema), entries


def build_or_load(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; where there is none, build's rows are written there first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_limits(spark: SparkSession, path: str, grid: DataFrame) -> DataFrame:
    """open, close, volume, high_limit and low_limit on the grid (date, ticker) from a daily table of codes.

    A missing column and a repeated date and code are errors; codes are trimmed, rows without a key dropped.
    """
    rows = require(spark.read.parquet(path), ["date", "code", *LIMIT_FIELDS])
    keyed = rows.select(
        F.to_date("date").alias("date"),
        F.trim("code").alias("ticker"),
        *[clean(F.col(c)).alias(c) for c in LIMIT_FIELDS]
    ).where("date is not null and ticker <> ''")
    if keyed.groupBy("date", "ticker").count().where("count > 1").limit(1).count():
        raise ValueError("duplicate date and code")
    return grid.select("date", "ticker").join(keyed, ["date", "ticker"], "left")


def load_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, CSV with a header, or JSON lines, by suffix; other suffixes are an error."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith((".parquet", ".pq")):
        return reader.parquet(path)
    if path.endswith(".csv"):
        return reader.option("header", True).csv(path)
    if path.endswith((".json", ".jsonl")):
        return reader.json(path)
    raise ValueError(f"unknown suffix: {path}")


def aligned(df: DataFrame, date_col: str, code_col: str, value_col: str, grid: DataFrame) -> DataFrame:
    """value on the grid (date, ticker) from a long table: codes trimmed, rows without key dropped, duplicates an error."""
    rows = df.select(
        F.to_date(date_col).alias("date"),
        F.trim(code_col).alias("ticker"),
        clean(F.col(value_col)).alias("value")
    ).where("date is not null and ticker <> ''")
    if rows.groupBy("date", "ticker").count().where("count > 1").limit(1).count():
        raise ValueError("duplicate date and code")
    return grid.join(rows, ["date", "ticker"], "left")


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last by order, over all rows and not by chunk."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def yearly_csv_to_parquet(
    spark: SparkSession,
    paths: list[str],
    schema: str,
    keys: list[str],
    date_col: str,
    out: str,
    postprocess: Callable[[DataFrame], DataFrame] | None = None,
    order: str | None = None
) -> DataFrame:
    """CSV files of years as one Parquet table: codes trimmed, dates parsed (a bad one is an error), the last row of a key kept.

    The last row is the one with the highest `order`; without it, the last line of the last file by name.
    """
    raw = spark.read.schema(schema).option("header", True).csv(paths)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    raw = raw.withColumn("_seq", place if order is None else F.col(order))
    require(raw, [*keys, date_col])
    rows = raw.withColumn("_d", F.try_to_timestamp(F.col(date_col).cast("string"), F.lit("yyyy-MM-dd")).cast("date"))
    if rows.where("_d is null").limit(1).count():
        raise ValueError(f"bad dates in {date_col}")
    rows = rows.withColumn(date_col, F.col("_d")).drop("_d")
    if postprocess:
        rows = rows.transform(postprocess)
    keep_last(rows, keys, "_seq").drop("_seq").write.mode("overwrite").option("compression", "zstd").parquet(out)
    return spark.read.parquet(out)


def snapshot(df: DataFrame, ticker_col: str, value_col: str, order: str) -> DataFrame:
    """ticker and value: numbers only, above 0, the last row of a ticker."""
    rows = df.select(
        F.col(ticker_col).alias("ticker"),
        F.col(value_col).cast("string").try_cast("double").alias("value"),
        F.col(order).alias("_o")
    ).where("value > 0")
    return keep_last(rows, ["ticker"], "_o").drop("_o")


class FactorStore:
    """Factors as one table partitioned by group and field, read by partition."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, df: DataFrame, group: str, field: str) -> None:
        rows = df.select("date", "ticker", "value", F.lit(group).alias("group"), F.lit(field).alias("field"))
        rows.write.mode("append").partitionBy("group", "field").parquet(self.path)

    def get(self, group: str, field: str, grid: DataFrame | None = None, fill: float | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.path).where((F.col("group") == group) & (F.col("field") == field)).select("date", "ticker", "value")
        if grid is not None:
            rows = grid.select("date", "ticker").join(rows, ["date", "ticker"], "left")
        return rows.fillna({"value": fill}) if fill is not None else rows

    def fields(self) -> DataFrame:
        return self.spark.read.parquet(self.path).select("group", "field").distinct()

    def bundle(self, group: str, fields: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(self.path).where((F.col("group") == group) & F.col("field").isin(fields))
        return rows.groupBy("date", "ticker").pivot("field", fields).agg(F.first("value"))


class DatasetRegistry:
    """Names of datasets with paths and metadata, kept as JSON lines."""

    SCHEMA = (
        "dataset_name string, path string, source_system string, schema_version int, format string, build_timestamp string, upstream_raw_inputs "
        "array<string>, source_quality string, parameters map<string,string>"
    )

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, entries: list[dict]) -> None:
        lines = self.spark.createDataFrame([(json.dumps(e),) for e in entries], "value string")
        lines.coalesce(1).write.mode("overwrite").text(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).json(self.path)

    def resolve(self, name: str, root: str) -> str:
        row = self.read().where(F.col("dataset_name") == name).select("path").first()
        if row is None:
            raise KeyError(f"unknown dataset {name}")
        return row["path"] if row["path"].startswith(("/", "file:", "hdfs:", "s3")) else f"{root.rstrip('/')}/{row['path']}"


def fill_sheets(rows: DataFrame, group_cols: list[str], sheet: str = "sheet", order: str = "row_no") -> DataFrame:
    """Sheet rows with merged cells filled downward, rows without code dropped, codes as four digits, changes as numbers."""
    for c in group_cols:
        rows = rows.withColumn(c, ffill(F.when(F.trim(c) != "", F.col(c)), key=sheet, order=order))
    code = F.regexp_replace(F.col("code").cast("string"), r"\.0$", "")
    rows = rows.where("code is not null").withColumn("code", F.when(F.length(code) >= 4, code).otherwise(F.lpad(code, 4, "0")))
    return rows.withColumn("delta", F.regexp_extract("change", r"([+-]?\d+)", 1).try_cast("int"))


def clean_bars(df: DataFrame, fill: bool = True, drop_empty: bool = True) -> DataFrame:
    """Downloaded bars: infinities are null, gaps filled forward if asked, dates on which no ticker has a value dropped."""
    df = df.select("date", "ticker", *[clean(F.col(c)).alias(c) for c in df.columns if c not in ("date", "ticker")])
    if drop_empty:
        some = F.max(F.greatest(*[F.col(c).isNotNull().cast("int") for c in df.columns[2:]], F.lit(0))).over(Window.partitionBy("date"))
        df = df.withColumn("_some", some).where("_some = 1").drop("_some")
    return df.select("date", "ticker", *[ffill(c).alias(c) for c in df.columns[2:]]) if fill else df


def load_table(df: DataFrame, path: str, replace: bool) -> DataFrame:
    """Delete-then-insert or append of rows by column name; returns the table."""
    df.write.mode("overwrite" if replace else "append").parquet(path)
    return df.sparkSession.read.parquet(path)


def vendor_history(df: DataFrame, order: str | None = None) -> DataFrame:
    """month_end and price from day/month/year dates and numbers with thousands separators: the last row of each month,
    and of rows of one day the last by order, if one is given."""
    at = F.struct(F.to_date("day", "dd/MM/yyyy").alias("date"), F.col(order) if order else F.lit(0))
    rows = df.select(at.alias("at"), F.regexp_replace("price", ",", "").try_cast("double").alias("price"), "ticker").where("price is not null")
    return rows.groupBy("ticker", F.last_day("at.date").alias("month_end")).agg(F.max_by("price", "at").alias("price"))


def write_artifacts(path: str, run_id: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")
