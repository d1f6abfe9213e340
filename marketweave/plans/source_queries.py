"""Registered source and sink queries: what is written is read again and compared with the tables it came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import io
from ..sources.bars import bars, sparse_bars, table
from . import sqlkit as q

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(key: str, run, digits: dict[str, int], sql: str | None, plain: tuple[str, ...] = ()) -> None:
    QUERIES[key] = lambda spark, sf_dir: run(spark, sf_dir).select(*plain, *[F.round(c, d).alias(c) for c, d in digits.items()])
    if sql is not None:
        ORACLE_SQL[
            key
        ] = f"WITH {sql.strip()}\nSELECT {', '.join([*plain, *[f'round({c}, {d}) + 0.0 AS {c}' for c, d in digits.items()]])} FROM final"


_DT = ("date", "ticker")
_T = [f"Brand#{i}" for i in range(1, 26)]


def _wide(s, d):
    b = bars(s, d)
    return io.to_wide(b, "close", _T).join(io.to_wide(b, "volume", _T), "date")


def _written(s, d, name, write):
    path = io.scratch(s, name)
    write(path)
    return path


def _panel_files(s, d):
    b = sparse_bars(s, d)
    return io.load_panel(s, _written(s, d, "panel", lambda p: io.save_panel(b, p))).where("year = 1997")


def _csv(s, d):
    b = sparse_bars(s, d, "nation").select("date", "ticker", "volume")
    path = _written(s, d, "panel", lambda p: b.write.option("header", True).csv(p + ".csv"))
    return io.load_any(s, path + ".csv", "date date, ticker string, volume double")


def _registry(s, d):
    r = io.DatasetRegistry(s, io.scratch(s, "registry"))
    names = [x["n_name"] for x in table(s, d, "nation").toLocalIterator()]
    r.write([{"dataset_name": n, "path": f"processed/{n}.parquet", "schema_version": 1, "format": "parquet", "parameters": {"k": n}} for n in names])
    return r.read().select("dataset_name", "path", F.col("parameters")["k"].alias("k"))


def _yearly(s, d):
    o = table(s, d, "orders").select(
        F.concat(F.lit(" "), (F.col("o_custkey") % 20).cast("string")).alias("code"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderkey").alias("line"),
        F.year("o_orderdate").alias("year")
    )
    path = io.scratch(s, "yearly")
    o.write.partitionBy("year").option("header", True).csv(path)
    return io.yearly_csv_to_parquet(
        s,
        [path],
        "code string, date string, value double, line long",
        ["code", "date"],
        "date",
        path + "-out",
        lambda x: x.withColumn("code", F.trim("code")),
        "line"
    )


def _factors(s, d):
    store = io.FactorStore(s, io.scratch(s, "factors"))
    b = sparse_bars(s, d)
    for f in ("close", "volume"):
        store.put(b.select("date", "ticker", F.col(f).alias("value")), "price", f)
    return store.bundle("price", ["close", "volume"])


def _factor_grid(s, d):
    store = io.FactorStore(s, io.scratch(s, "factors"))
    store.put(sparse_bars(s, d, "nation").select("date", "ticker", F.col("volume").alias("value")), "liq", "volume")
    return store.get("liq", "volume", bars(s, d, "nation"), 0.0)


def _sheets(s, d):
    o = table(s, d, "orders").select(
        (F.col("o_orderkey") % 4).alias("sheet"),
        F.col("o_orderkey").alias("row_no"),
        F.when(F.col("o_orderkey") % 7 < 2, F.col("o_orderpriority")).alias("grp"),
        F.when(F.col("o_custkey") % 5 > 0, F.concat((F.col("o_custkey") % 900).cast("string"), F.lit(".0"))).alias("code"),
        F.concat(F.lit("net +"), (F.col("o_orderkey") % 9).cast("string")).alias("change")
    )
    return io.fill_sheets(o, ["grp"])


def _jsonl(s, d):
    b = table(s, d, "nation")
    path = io.scratch(s, "index")
    b.write.json(path + ".jsonl")
    return io.load_any(s, path + ".jsonl", "n_nationkey int, n_name string, n_regionkey int")


def _curated(s, d):
    path = io.scratch(s, "curated")
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    io.load_table(o.where("o_orderkey % 2 = 0"), path, True)
    io.load_table(o.where("o_orderkey % 2 = 1"), path, False)
    io.load_table(o.where("o_orderkey % 3 = 0"), path + "-2", True)
    return io.load_table(o.where("o_orderkey % 5 = 0"), path + "-2", True).groupBy("o_orderstatus").agg(F.count("*").alias("n")).join(
        s.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("all_n")),
        "o_orderstatus"
    )


def _artifacts(s, d):
    path = io.scratch(s, "runs")
    b = sparse_bars(s, d)
    io.write_artifacts(path, "r1", returns=b.select("date", "ticker", "close"), weights=b.select("date", "ticker", "volume"))
    return s.read.parquet(f"{path}/returns").groupBy("ticker").agg(F.count("*").alias("n"))


_add("src01_wide_to_long", lambda s, d: io.to_long(_wide(s, d)), {"close": 9, "volume": 2}, f"{q.BRAND}, final AS (SELECT * FROM bars)", _DT)
_add(
    "src02_long_to_wide",
    _wide,
    {},
    f"{q.BRAND}, final AS (SELECT date, round(max(CASE WHEN ticker = 'Brand#3' THEN close END), 9) AS c3, max(CASE WHEN ticker = 'Brand#7' THEN "
    f"volume END) AS v7 FROM bars GROUP BY date)",
    ()
)
QUERIES["src02_long_to_wide"] = lambda s, d: _wide(s, d).select(
    "date",
    F.round("`close__Brand#3`", 9).alias("c3"),
    F.col("`volume__Brand#7`").alias("v7")
)
ORACLE_SQL["src02_long_to_wide"] = ORACLE_SQL["src02_long_to_wide"].rsplit("SELECT", 1)[0] + "SELECT date, c3, v7 FROM final"
_add("src03_panel_files", _panel_files, {"close": 9}, f"{q.BRAND}, final AS (SELECT * FROM sparse WHERE year(date) = 1997)", _DT)
_add("src05_csv", _csv, {"volume": 2}, f"{q.NATION}, final AS (SELECT * FROM sparse)", _DT)
_add(
    "src07_registry",
    _registry,
    {},
    "final AS (SELECT n_name AS dataset_name, 'processed/' || n_name || '.parquet' AS path, n_name AS k FROM nation)",
    ("dataset_name", "path", "k")
)
_add(
    "src08_aligned",
    lambda s, d: io.aligned(
        sparse_bars(s, d, "nation").withColumn("code", F.concat(F.lit(" "), "ticker")),
        "date",
        "code",
        "volume",
        bars(s, d, "nation").select("date", "ticker")
    ),
    {"value": 2},
    f"{q.NATION}, final AS (SELECT date, ticker, volume AS value FROM bars)",
    _DT
)
_add(
    "src10_vendor_fields",
    lambda s, d: sparse_bars(s, d).select("date", "ticker", F.col("turnover").alias("money")).where(
        "date >= '1998-01-01' and ticker in ('Brand#1', 'Brand#5')"
    ).withColumnRenamed("money", "turnover"),
    {"turnover": 2},
    f"{q.BRAND}, final AS (SELECT * FROM sparse WHERE date >= DATE '1998-01-01' AND ticker IN ('Brand#1', 'Brand#5'))",
    _DT
)
_add(
    "src12_yearly_csv",
    _yearly,
    {"value": 2},
    "final AS (SELECT CAST(o_custkey % 20 AS VARCHAR) AS code, CAST(o_orderdate AS DATE) AS date, max_by(o_totalprice, o_orderkey) AS value "
    "FROM orders GROUP BY 1, 2)",
    ("code", "date")
)
_add(
    "src16_snapshot",
    lambda s, d: io.snapshot(
        table(s, d, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("t"), "c_acctbal", "c_custkey"),
        "t",
        "c_acctbal",
        "c_custkey"
    ),
    {"value": 2},
    "final AS (SELECT 'N' || CAST(c_nationkey AS VARCHAR) AS ticker, max_by(c_acctbal, c_custkey) AS value FROM customer WHERE c_acctbal > 0 "
    "GROUP BY 1)",
    ("ticker",)
)
_add("src17_factor_bundle", _factors, {"close": 9, "volume": 2}, f"{q.BRAND}, final AS (SELECT * FROM sparse)", _DT)
_add("src14_factor_on_grid", _factor_grid, {"value": 2}, f"{q.NATION}, final AS (SELECT date, ticker, coalesce(volume, 0) AS value FROM bars)", _DT)
_add(
    "src18_filled_sheets",
    _sheets,
    {},
    "r AS (SELECT o_orderkey % 4 AS sheet, o_orderkey AS row_no, last_value(CASE WHEN o_orderkey % 7 < 2 THEN o_orderpriority END IGNORE NULLS) "
    "OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS grp, o_custkey, o_orderkey "
    "FROM orders), final AS (SELECT sheet, row_no, grp, CASE WHEN length(CAST(o_custkey % 900 AS VARCHAR)) >= 4 THEN CAST(o_custkey % 900 AS "
    "VARCHAR) ELSE lpad(CAST(o_custkey % 900 AS VARCHAR), 4, '0') END AS code, CAST(o_orderkey % 9 AS INTEGER) AS delta FROM r "
    "WHERE o_custkey % 5 > 0)",
    ("sheet", "row_no", "grp", "code", "delta")
)
_add("src20_json_lines", _jsonl, {}, "final AS (SELECT * FROM nation)", ("n_nationkey", "n_name", "n_regionkey"))
_add(
    "src21_curated_load",
    _curated,
    {},
    "final AS (SELECT o_orderstatus, count(CASE WHEN o_orderkey % 5 = 0 THEN 1 END) AS n, count(*) AS all_n FROM orders GROUP BY o_orderstatus)",
    ("o_orderstatus", "n", "all_n")
)
_add("src22_run_artifacts", _artifacts, {}, f"{q.BRAND}, final AS (SELECT ticker, count(*) AS n FROM sparse GROUP BY ticker)", ("ticker", "n"))
_add(
    "src25_clean_bars",
    lambda s, d: io.clean_bars(
        bars(s, d, "nation").select("date", "ticker", F.when(F.col("volume") > 45, float("inf")).otherwise(F.col("volume")).alias("volume"))
    ),
    {"volume": 2},
    f"{q.NATION}, c AS (SELECT date, ticker, CASE WHEN volume <= 45 THEN volume END AS v "
    f"FROM bars), k AS (SELECT *, count(v) OVER (PARTITION BY date) AS n FROM c), final AS (SELECT date, ticker, {q.ffill('v')} AS volume FROM k "
    f"WHERE n > 0)",
    _DT
)
_add(
    "src28_vendor_history",
    lambda s, d: io.vendor_history(
        table(s, d, "orders").select(
            F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
            F.format_number("o_totalprice", 2).alias("price"),
            (F.col("o_custkey") % 30).cast("string").alias("ticker"),
            F.col("o_orderkey").alias("line")
        ),
        "line"
    ),
    {"price": 2},
    "final AS (SELECT CAST(o_custkey % 30 AS VARCHAR) AS ticker, last_day(CAST(o_orderdate AS DATE)) AS month_end, max_by(o_totalprice, {'a': "
    "CAST(o_orderdate AS DATE), 'b': o_orderkey}) AS price FROM orders GROUP BY 1, 2)",
    ("ticker", "month_end")
)
