"""Registered filing curation, loader, ranking, overlay and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.series import ref, staged
from ..operators import cross_section as xs
from ..operators import curation as cu
from ..operators import inference as inf
from ..operators import overlays as ov
from ..operators import ranking as rk
from ..sources import filing_sources as fs
from ..sources import io
from ..sources.bars import bars, shares, sparse_bars, table
from ..sources.panel import panel
from . import event_queries as ev
from . import research_queries as rq
from . import sqlkit as q

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(key: str, run, digits: dict[str, int], sql: str | None, plain: tuple[str, ...] = ()) -> None:
    QUERIES[key] = lambda spark, sf_dir: run(spark, sf_dir).select(*plain, *[F.round(c, d).alias(c) for c, d in digits.items()])
    if sql is not None:
        columns = [*plain, *[f"round({c}, {d}) + 0.0 AS {c}" for c, d in digits.items()]]
        ORACLE_SQL[key] = q.recursive(f"WITH {sql.strip()}\nSELECT {', '.join(columns)} FROM final")


_DT = ("date", "ticker")


# Filings: facts of four lines an order, with labels, values and gaps that vary with the row
def _facts(s, d):
    o = table(s, d, "orders").withColumn("n", F.floor("o_totalprice").cast("long").cast("string"))
    key = F.col("o_orderkey")

    def line(no, kind, label, code, value):
        cast = (
            F.lit(no).alias("line_no"),
            F.lit(kind).alias("kind"),
            label.alias("label"),
            F.lit(code).cast("string").alias("code"),
            value.cast("double").alias("value")
        )
        return F.struct(*cast)

    half = F.when(key % 2 == 0, F.col("o_totalprice"))
    share = F.when(key % 3 == 0, F.lit("SHARES IN ISSUE as stated")).when(
        key % 3 == 1,
        F.concat(F.lit("Issued shares 12 and "), F.col("n"))
    ).otherwise(F.concat(F.lit("Shares in issue: "), F.format_number("o_totalprice", 0)))
    lines = F.array(
        line(0, "table", F.concat(F.lit("Bank BORROWINGS HK$ million "), F.col("n")), "total_borrowings_current", half),
        line(1, "table", share, None, F.lit(None)),
        line(
            2,
            "table",
            F.when(key % 4 > 0, F.lit("Weighted average 987,654 shares")).otherwise(F.lit("Issued shares 77")),
            None,
            F.when(key % 4 == 1, F.lit(55.0))
        ),
        line(3, "note", F.concat(F.lit("Investment properties at "), F.col("n")), "investment_properties_fair_value_total", F.lit(None)),
    )
    rows = o.select(
        key.alias("filing_id"),
        (key % 3 + 1).cast("int").alias("page_no"),
        F.explode(lines).alias("f")
    ).select("filing_id", "page_no", "f.*")
    return rows.withColumn("confidence", F.lit(0.2)).withColumn("currency", F.when(F.col("line_no") == 0, "HKD")).withColumn(
        "unit_scale",
        F.when(F.col("line_no") == 0, "millions")
    )


def _index(s, d):
    """Filings of half-yearly periods."""
    o, day = table(s, d, "orders").where("o_custkey % 7 > 0"), F.to_date("o_orderdate")
    end = F.make_date(F.year(day), F.when(F.month(day) <= 6, 6).otherwise(12), F.when(F.month(day) <= 6, 30).otherwise(31))
    code = F.lpad((F.col("o_custkey") % 50).cast("string"), 5, "0")
    return o.select(F.col("o_orderkey").alias("filing_id"), code.alias("stock_code"), end.alias("period_end"), day.alias("publish"))


_F = """o0 AS (SELECT *, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS n FROM orders),
fa AS (
  SELECT o_orderkey AS filing_id, CAST(o_orderkey % 3 + 1 AS INTEGER) AS page_no, 0 AS line_no, 'table' AS kind, 'Bank BORROWINGS HK$ million ' || n AS label, 'total_borrowings_current' AS code,
         CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS value, 'HKD' AS currency FROM o0
  UNION ALL SELECT o_orderkey, CAST(o_orderkey % 3 + 1 AS INTEGER), 1, 'table', CASE o_orderkey % 3 WHEN 0 THEN 'SHARES IN ISSUE as stated' WHEN 1 THEN 'Issued shares 12 and ' || n ELSE 'Shares in issue: ' || format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) END, NULL, NULL, NULL FROM o0
  UNION ALL SELECT o_orderkey, CAST(o_orderkey % 3 + 1 AS INTEGER), 2, 'table', CASE WHEN o_orderkey % 4 > 0 THEN 'Weighted average 987,654 shares' ELSE 'Issued shares 77' END, NULL, CASE WHEN o_orderkey % 4 = 1 THEN 55.0 END, NULL FROM o0
  UNION ALL SELECT o_orderkey, CAST(o_orderkey % 3 + 1 AS INTEGER), 3, 'note', 'Investment properties at ' || n, 'investment_properties_fair_value_total', NULL, NULL FROM o0),
ix AS (SELECT o_orderkey AS filing_id, lpad(CAST(o_custkey % 50 AS VARCHAR), 5, '0') AS stock_code, make_date(year(o_orderdate), CASE WHEN month(o_orderdate) <= 6 THEN 6 ELSE 12 END, CASE WHEN month(o_orderdate) <= 6 THEN 30 ELSE 31 END) AS period_end
  FROM orders WHERE o_custkey % 7 > 0),
nm AS (SELECT *, coalesce(value, try_cast(replace(regexp_extract_all(label, '[0-9][0-9,]*')[-1], ',', '') AS DOUBLE)) AS num FROM fa)"""
_FIRST = """cap AS (SELECT filing_id,
    min_by(num, {'a': CASE WHEN contains(lower(label), 'shares in issue') THEN 0 ELSE 1 END, 'b': line_no}) FILTER (num IS NOT NULL AND (contains(lower(label), 'shares in issue') OR contains(lower(label), 'issued shares'))) AS sh,
    min_by(num, line_no) FILTER (num IS NOT NULL AND contains(lower(label), 'weighted average')) AS wa FROM nm GROUP BY filing_id)"""
_add(
    "agg18_first_numeric",
    lambda s, d: cu.capital_structure(_index(s, d), _facts(s, d)),
    {"shares_outstanding_period_end": 1, "weighted_avg_shares_basic": 1},
    f"{_F}, {_FIRST}, final AS (SELECT filing_id, sh AS shares_outstanding_period_end, wa AS weighted_avg_shares_basic FROM ix LEFT "
    f"JOIN cap USING (filing_id))",
    ("filing_id",)
)
_NUM = "row_number() OVER (PARTITION BY filing_id ORDER BY page_no, line_no)"
_add(
    "nav06_statement_line_items",
    lambda s, d: cu.statement_line_items(_index(s, d), _facts(s, d)),
    {"value": 2},
    f"{_F}, it AS (SELECT *, 'fact_' || CAST(filing_id AS VARCHAR) || '_' || CAST({_NUM} AS VARCHAR) AS fact_id FROM fa "
    f"WHERE kind = 'table'), final AS (SELECT it.*, stock_code, period_end, code AS line_item_code, label AS line_item_label_raw FROM it LEFT "
    f"JOIN ix USING (filing_id))",
    ("fact_id", "filing_id", "stock_code", "period_end", "line_item_code", "line_item_label_raw")
)
_add(
    "nav07_debt_schedule",
    lambda s, d: cu.debt_schedule(_index(s, d), _facts(s, d)),
    {"amount": 2},
    f"{_F}, final AS (SELECT 'debt_' || CAST(filing_id AS VARCHAR) || '_1' AS debt_fact_id, filing_id, stock_code, value AS amount, currency "
    f"FROM fa JOIN ix USING (filing_id) WHERE line_no = 0)",
    ("debt_fact_id", "filing_id", "stock_code", "currency")
)
_add(
    "nav07_property_notes",
    lambda s, d: cu.property_notes(_index(s, d), _facts(s, d)),
    {},
    f"{_F}, final AS (SELECT 'ip_' || CAST(filing_id AS VARCHAR) || '_1' AS ip_note_fact_id, filing_id, stock_code, code AS metric_code, label AS "
    f"metric_label_raw FROM fa LEFT JOIN ix USING (filing_id) WHERE kind = 'note')",
    ("ip_note_fact_id", "filing_id", "stock_code", "metric_code", "metric_label_raw")
)


def _pages(s, d):
    """Pages whose lines vary: some have two property lines, some one late, some none, some are empty."""
    o, key = table(s, d, "orders"), F.col("o_orderkey")
    amount = F.floor("o_totalprice").cast("long").cast("string")
    text = F.when(
        key % 6 == 0,
        F.concat(F.lit("Report\n  Investment Properties RMB'000 "), amount, F.lit("\nINVESTMENT PROPERTY under construction 5"))
    ).when(
        key % 6 == 1,
        F.concat(F.lit("Cash and bank balances "), amount, F.lit("\n\nGain on investment property HK$ million"))
    ).when(
        key % 6 == 2,
        F.concat(F.lit("Total equity (in thousands) "), amount)
    ).when(key % 6 == 3, F.lit("")).when(key % 6 == 4, F.lit("nothing\nhere"))
    return o.select(key.alias("filing_id"), (key % 4 + 1).cast("int").alias("page_no"), text.alias("text"))


_PAGED = """p0 AS (SELECT o_orderkey AS filing_id, CAST(o_orderkey % 4 + 1 AS INTEGER) AS page_no, o_orderkey % 6 AS k, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS n FROM orders),
final AS (
  SELECT filing_id, page_no, 'note' AS kind, CASE k WHEN 0 THEN 'Investment Properties RMB''000 ' || n ELSE 'Gain on investment property HK$ million' END AS label, CAST(NULL AS DOUBLE) AS value, 0.2 AS confidence, CASE k WHEN 0 THEN 'CNY' ELSE 'HKD' END AS currency, CASE k WHEN 0 THEN 'thousands' ELSE 'millions' END AS unit_scale FROM p0 WHERE k IN (0, 1)
  UNION ALL SELECT filing_id, page_no, 'table', CASE k WHEN 1 THEN 'Cash and bank balances ' || n ELSE 'Total equity (in thousands) ' || n END, CAST(n AS DOUBLE), 0.45, NULL, CASE k WHEN 2 THEN 'thousands' ELSE 'units' END FROM p0 WHERE k IN (1, 2))"""
_add(
    "nav05_extracted_facts",
    lambda s, d: cu.extracted_facts(_pages(s, d)),
    {"value": 2, "confidence": 2},
    _PAGED,
    ("filing_id", "page_no", "kind", "label", "currency", "unit_scale")
)
_SHEET = f"{_F}, si AS (SELECT filing_id, code, value FROM fa WHERE kind = 'table' AND code = 'total_borrowings_current')"
_KEY = "'{\"filing_id\":' || CAST(filing_id AS VARCHAR) || ',\"line_item_code\":\"' || code || '\"}'"
_add(
    "nav08_review_sheet",
    lambda s, d: cu.core_review_sheet(cu.statement_line_items(_index(s, d), _facts(s, d))),
    {"suggested_value": 2},
    f"{_SHEET}, final AS (SELECT {_KEY} AS target_key_json, value AS suggested_value, 'pending' AS status FROM si)",
    ("target_key_json", "status")
)


def _overridden(s, d):
    items = cu.statement_line_items(_index(s, d), _facts(s, d))
    sheet = cu.core_review_sheet(items)
    key = F.get_json_object("target_key_json", "$.filing_id").cast("long")
    filled = sheet.withColumn("override_value_num", (key % 100).cast("double")).withColumn(
        "status",
        F.when(key % 3 == 0, "approved").when(key % 3 == 1, "unknown").otherwise("rejected")
    )
    return cu.apply_overrides(items, cu.import_overrides(filled)).where("line_item_code is not null")


_add(
    "nav09_overrides",
    _overridden,
    {"value": 2},
    f"{_SHEET}, final AS (SELECT filing_id, CASE WHEN filing_id % 3 = 0 THEN CAST(filing_id % 100 AS DOUBLE) ELSE value END AS value FROM si)",
    ("filing_id",)
)
_add(
    "nav13_curated_counts",
    lambda s, d: (
        lambda t: t["statement_line_items"].select(F.lit("items").alias("name"), "filing_id").unionByName(
            t["investment_property_notes"].select(F.lit("notes").alias("name"), "filing_id")
        ).unionByName(t["capital_structure"].select(F.lit("capital").alias("name"), "filing_id")).groupBy("name").agg(F.count("*").alias("n"))
    )(cu.curate(_index(s, d), _pages(s, d))),
    {},
    "final AS (SELECT 'items' AS name, count(*) AS n FROM orders WHERE o_orderkey % 6 IN (1, 2) UNION ALL SELECT 'notes', count(*) FROM orders "
    "WHERE o_orderkey % 6 IN (0, 1) UNION ALL SELECT 'capital', count(*) FROM orders WHERE o_custkey % 7 > 0)",
    ("name", "n")
)


# Sources
def _registered(s, d, name):
    """A panel that a registry knows by name, and the registry."""
    root = io.scratch(s, "root")
    io.save_panel(sparse_bars(s, d), f"{root}/processed/{name}.parquet")
    registry = io.DatasetRegistry(s, f"{root}/registry")
    registry.write(
        [
            {
                "dataset_name": name,
                "path": f"processed/{name}.parquet",
                "schema_version": 1,
                "source_system": "order lines",
                "parameters": {"by": "brand"}
            }
        ]
    )
    return registry, root


def _by_name(s, d):
    registry, root = _registered(s, d, "brand_panel")
    return io.load_panel(s, "brand_panel", registry, root)


def _provenance(s, d):
    registry, root = _registered(s, d, "brand_panel")
    rows, entry = io.load_with_provenance(s, "brand_panel", registry, root)
    return rows.groupBy("ticker").agg(F.count("*").alias("n")).crossJoin(
        F.broadcast(entry.select("source_system", F.col("parameters")["by"].alias("made_by")))
    )  # one entry


def _limits(s, d):
    path = io.scratch(s, "limits")
    b = bars(s, d, "nation").select(
        "date",
        F.concat(F.lit(" "), "ticker").alias("code"),
        "open",
        "close",
        "volume",
        (F.col("close") * 1.1).alias("high_limit"),
        (F.col("close") * 0.9).alias("low_limit")
    )
    b.where("close is not null").write.parquet(path)
    return io.load_limits(s, path, bars(s, d, "nation"))


def _built_once(s, d):
    path, built = io.scratch(s, "cache"), []

    def build():
        built.append(1)
        return sparse_bars(s, d).groupBy("ticker").agg(F.sum("volume").alias("volume"))

    io.build_or_load(s, path, build)
    return io.build_or_load(s, path, build).withColumn("builds", F.lit(len(built)))


def _saved_shares(s, d):
    path = io.scratch(s, "shares") + ".parquet"
    fs.save_shares(shares(s, d).withColumnRenamed("shares_outstanding", "estimated_shares"), path, "2024-01-31", "2024-01-30")
    return fs.load_shares(s, path)


def _seeds(s, d):
    path, n = io.scratch(s, "seeds"), table(s, d, "customer")
    n.where("c_custkey % 2 = 0").select(
        F.col("c_name").alias("title"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit("00016")).alias("stock_code")
    ).write.option("header", True).csv(path + ".csv")
    n.where("c_custkey % 2 = 1").select(F.col("c_name").alias("title"), F.lit(None).cast("string").alias("stock_code")).write.json(path + ".jsonl")
    return fs.seed_index(s, [path + ".csv", path + ".jsonl"], "title string, stock_code string", "01113")


def _exported(s, d):
    path, out = io.scratch(s, "exports"), table(s, d, "orders")
    scenario = F.element_at(F.array(*map(F.lit, ("book", "rnav_base", "rnav_bull", "rnavx"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    fs.export_model(
        out.select(
            F.col("o_orderstatus").alias("stock_code"),
            F.to_date("o_orderdate").alias("period_end"),
            scenario.alias("scenario"),
            F.col("o_totalprice").alias("price"),
            F.lit(2.0).alias("nav_per_share"),
            F.lit(0.5).alias("discount")
        ),
        path
    )
    parts = [
        s.read.parquet(f"{path}/{n}").groupBy("stock_code").agg(F.count("*").alias("n")).withColumn("name", F.lit(n)) for n in (
            "book_nav_timeseries",
            "rnav_timeseries",
            "discount_to_nav_timeseries"
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _manifest(s, d):
    path = io.scratch(s, "manifest")
    entry = F.struct(
        F.col("n_name").alias("name"),
        F.lit("research").alias("owner"),
        F.lit("kept by hand").alias("source_note"),
        F.lit("2024-01-01").alias("last_updated"),
        F.lit("seeded").alias("validation_status"),
        F.array(F.lit("prices"), F.col("n_name")).alias("downstream_datasets")
    )
    table(s, d, "nation").agg(F.to_json(F.struct(F.collect_list(entry).alias("manual_inputs"))).alias("value")).coalesce(1).write.text(path)
    return fs.check_manifest(s, path)


def _vendor(s, d):
    path = io.scratch(s, "vendor")
    for name, column in (("valuation", "o_totalprice"), ("income", "o_custkey"), ("indicator", "o_orderkey")):
        table(s, d, "orders").select(
            (F.col("o_custkey") % 10).cast("string").alias("code"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
            F.col(column).cast("double").alias("value"),
            F.col("o_orderkey").alias("line")
        ).write.option("header", True).csv(f"{path}/{name}")
    load = lambda n: io.yearly_csv_to_parquet(
        s,
        [f"{path}/{n}"],
        "code string, date string, value double, line long",
        ["code", "date"],
        "date",
        f"{path}-{n}",
        None,
        "line"
    )
    tables = [t.withColumn("name", F.lit(n)) for n, t in fs.vendor_tables(load).items()]
    return tables[0].unionByName(tables[1]).unionByName(tables[2]).groupBy("name", "code").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def _price_window(s, d):
    index = _index(s, d).where("publish between date'1996-02-01' and date'1996-05-01'")
    issuers = index.select("stock_code").distinct().withColumn(
        "ticker",
        F.concat(F.lit("NATION_"), (F.col("stock_code").cast("int") % 5).cast("string"))
    )
    kept, said = fs.price_window(sparse_bars(s, d, "nation").select("date", "ticker", "close"), index, issuers)
    return kept.groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("first_date")).crossJoin(
        F.broadcast(said.select(F.size("tickers").alias("tickers")))
    )  # one row


_add("src04_panel_by_name", _by_name, {"close": 9}, f"{q.BRAND}, final AS (SELECT * FROM sparse)", _DT)
_add(
    "src06_provenance",
    _provenance,
    {},
    f"{q.BRAND}, final AS (SELECT ticker, count(*) AS n, 'order lines' AS source_system, 'brand' AS made_by FROM sparse GROUP BY ticker)",
    ("ticker", "n", "source_system", "made_by")
)
_add(
    "src09_price_limits",
    _limits,
    {"open": 8, "close": 8, "high_limit": 8, "low_limit": 8},
    f"{q.NATION}, final AS (SELECT *, close * 1.1 AS high_limit, close * 0.9 AS low_limit FROM bars)",
    (*_DT, "volume")
)
_add(
    "src11_built_once",
    _built_once,
    {"volume": 2},
    f"{q.BRAND}, final AS (SELECT ticker, sum(volume) AS volume, 1 AS builds FROM sparse GROUP BY ticker)",
    ("ticker", "builds")
)
_add(
    "src13_vendor_tables",
    _vendor,
    {"total": 2},
    "v AS (SELECT CAST(o_custkey % 10 AS VARCHAR) AS code, CAST(o_orderdate AS DATE) AS date, max_by(o_totalprice, o_orderkey) AS valuation, "
    "max_by(CAST(o_custkey AS DOUBLE), o_orderkey) AS income, max(CAST(o_orderkey AS DOUBLE)) AS indicator FROM orders "
    "GROUP BY 1, 2), u AS (UNPIVOT v ON valuation, income, indicator INTO NAME name VALUE value), final AS (SELECT name, code, sum(value) AS total, "
    "count(*) AS n FROM u GROUP BY name, code)",
    ("name", "code", "n")
)
_add(
    "src15_share_table",
    _saved_shares,
    {"estimated_shares": 2},
    f"{q.BRAND}, final AS (SELECT ticker, shares_outstanding AS estimated_shares FROM shares)",
    ("ticker",)
)
_add(
    "src19_seed_index",
    _seeds,
    {},
    "final AS (SELECT c_name AS title, CASE WHEN c_custkey % 4 = 0 THEN '00016' ELSE '01113' END AS stock_code, 'EN' AS language FROM customer)",
    ("title", "stock_code", "language")
)
_add(
    "src23_model_exports",
    _exported,
    {},
    "final AS (SELECT o_orderstatus AS stock_code, 'book_nav_timeseries' AS name, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1 "
    "UNION ALL SELECT o_orderstatus, 'rnav_timeseries', count(*) FROM orders WHERE o_orderkey % 4 IN (1, 2) GROUP BY 1 UNION ALL "
    "SELECT o_orderstatus, 'discount_to_nav_timeseries', count(*) FROM orders GROUP BY 1)",
    ("stock_code", "name", "n")
)
_add(
    "src24_extraction_log",
    lambda s, d: fs.write_extraction(_facts(s, d).where("kind = 'table' and value is not null"), _index(s, d), io.scratch(s, "extracted")),
    {},
    f"{_F}, final AS (SELECT filing_id, count(fa.value) AS facts FROM ix LEFT JOIN fa USING (filing_id) GROUP BY filing_id)",
    ("filing_id", "facts")
)
_add(
    "src26_manifest",
    _manifest,
    {},
    "final AS (SELECT n_name AS name, 'research' AS owner, '[\"prices\",\"' || n_name || '\"]' AS downstream_datasets FROM nation)",
    ("name", "owner", "downstream_datasets")
)
_add(
    "src27_price_window",
    _price_window,
    {},
    f"{q.NATION}, wx AS (SELECT o_custkey % 50 AS code, CAST(o_orderdate AS DATE) AS d FROM orders "
    f"WHERE o_custkey % 7 > 0 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1996-05-01'), wt AS (SELECT DISTINCT 'NATION_' || "
    f"CAST(code % 5 AS VARCHAR) AS ticker FROM wx), wb AS (SELECT min(d) - INTERVAL 30 DAY AS a, max(d) + INTERVAL 30 DAY AS b "
    f"FROM wx), final AS (SELECT ticker, count(*) AS n, min(date) AS first_date, (SELECT count(*) FROM wt) AS tickers FROM sparse "
    f"JOIN wt USING (ticker) CROSS JOIN wb WHERE date BETWEEN a AND b GROUP BY ticker)",
    ("ticker", "n", "first_date", "tickers")
)

# Overlays, gates and filters
_overlaid = lambda s, d: ov.apply_overlays(rq._weights(panel(s, d)), [ov.VolTarget(2.0, 8, 1.5, 52), ov.TradeStop(0.2, 3)])
_TARGETED = (
    f"{rq._W}, va AS (SELECT *, w * coalesce(least(2.0 / CASE WHEN ({q.full('stddev_pop', 'ret', 8)}) * sqrt(52) > 1e-12 THEN "
    f"({q.full('stddev_pop', 'ret', 8)}) * sqrt(52) END, 1.5), 1) AS ws FROM w1), vb AS (SELECT *, sum(abs(ws)) OVER (PARTITION BY date) AS gr "
    f"FROM va), vc AS (SELECT *, max(gr) OVER () AS worst FROM vb), t0 AS (SELECT date, ticker, CAST(CASE WHEN worst > 1 AND gr > 0 THEN ws / gr "
    f"ELSE ws END AS DOUBLE) AS w, px FROM vc)"
)
_add(
    "udf02_overlays",
    lambda s, d: (
        lambda w, found: w.select("date", "ticker", "w").join(
            found["trade_dd_stop"]["exits"].select("date", "ticker", "exit_flag"),
            ["date", "ticker"]
        )
    )(*_overlaid(s, d)),
    {"w": 5},
    f"{q.PANEL}, {_TARGETED}, {rq._STOP}, final AS (SELECT date, ticker, held AS w, exit_flag FROM ts)",
    (*_DT, "exit_flag")
)
_brand_spans = lambda s, d: sparse_bars(s, d).select("ticker").distinct().select(
    "ticker",
    F.date_add(F.lit("1995-06-01").cast("date"), F.regexp_extract("ticker", r"(\d+)", 1).cast("int") * 40).alias("start"),
    F.lit("2000-06-30").cast("date").alias("end")
)
_add(
    "udf03_gates",
    lambda s, d: ov.gated(
        bars(s, d).select("date", "ticker"),
        [ov.EventGate(ev._events(s, d), ("Brand#1", "Brand#2")), ov.SpanGate(_brand_spans(s, d))]
    ),
    {},
    f"{ev._DELTA}, final AS (SELECT date, ticker, member AS events, date BETWEEN DATE '1995-06-01' + CAST(regexp_extract(ticker, '[0-9]+') AS "
    f"INTEGER) * 40 AND DATE '2000-06-30' AS spans, member AND date BETWEEN DATE '1995-06-01' + CAST(regexp_extract(ticker, '[0-9]+') AS INTEGER) * "
    f"40 AND DATE '2000-06-30' AS member FROM mem)",
    (*_DT, "events", "spans", "member")
)
_book = lambda s, d: ov.select_book(
    panel(s, d),
    "score",
    4,
    3,
    lambda: F.col("ret") > 0,
    lambda: (F.col("volume") > 50) & (F.col("ret") < 0),
    1.0,
    0.5,
    True
)
_add(
    "udf04_filtered_book",
    _book,
    {"w": 6},
    f"{q.PANEL}, lo AS (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS k FROM panel "
    f"WHERE score IS NOT NULL AND ret > 0), so AS (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS k "
    f"FROM panel WHERE score IS NOT NULL AND volume > 50 AND ret < 0), bo AS (SELECT date, ticker, 'long' AS leg, 1.0 / count(*) OVER (PARTITION BY "
    f"date) AS w FROM lo WHERE k <= 4 UNION ALL SELECT date, ticker, 'short', -0.5 / count(*) OVER (PARTITION BY date) FROM so "
    f"WHERE k <= 3), final AS (SELECT * FROM bo WHERE date IN (SELECT date FROM bo GROUP BY date HAVING count(DISTINCT leg) = 2))",
    (*_DT, "leg")
)

# Ranking and tilt: fits without SQL
_CFG = rk.RankConfig(features=("score", "l1", "l2", "vr"), top_k=5)
_ranked = lambda s, d: staged(
    panel(s, d),
    l1=ref("ret"),
    l2=ref("ret", 2),
    vr=F.col("volume") / F.avg("volume").over(xs.Window.partitionBy("ticker").orderBy("date").rowsBetween(-7, 0))
)
_folds = lambda d: inf.make_folds(d.select("date", "pos").distinct(), 104, 52, 2)
_add(
    "ml11_ranking_workflow",
    lambda s, d: rk.rank_metrics(rk.walk_forward_scores(_ranked(s, d), _folds(panel(s, d)), _CFG), 5),
    {"mean": 4, "icir": 4, "top_mean": 5},
    None,
    ("fold", "n")
)
_tilt = lambda s, d: ov.tilt_study(
    staged(_ranked(s, d), inter=F.col("l1") * F.col("score")),
    "ret",
    ["l1", "l2", "inter"],
    36,
    target=0.5,
    freq=52,
    cost=0.0005
)
_add(
    "ml17_tilt_study",
    lambda s, d: ov.tilt_metrics(_tilt(s, d), 52),
    {"oos_r2": 4, "sharpe": 4, "max_drawdown": 5, "hit_rate": 5, "turnover": 5},
    None,
    ("ticker", "n")
)
