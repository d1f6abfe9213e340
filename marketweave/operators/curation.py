"""Curated tables of filings: line items, capital structure, debt, property notes, review sheets and overrides.

Facts are rows of filing_id, kind (table or note), label, code, value, page_no, line_no, confidence, and what currency and
unit a line names. All steps are grouped by filing; ids count inside a filing, so that no table is numbered by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import filings as fl

#: Labels of share counts, by priority (fixed values).
SHARE_LABELS, AVERAGE_LABELS = ("shares in issue", "issued shares"), ("weighted average",)
#: Codes that a reviewer sees first (fixed values).
CORE_CODES = (
    "total_equity",
    "equity_attributable_to_owners",
    "non_controlling_interests",
    "total_borrowings_current",
    "total_borrowings_noncurrent",
    "cash_and_bank_balances",
    "dividends_declared",
    "dividends_paid",
    "equity_per_share_disclosed",
)
#: States of an override; any other is pending (fixed values).
STATES = ("approved", "rejected", "pending")
_ORDER = ("page_no", "line_no", "code")


def property_lines(pages: DataFrame) -> DataFrame:
    """The first line of each page that names an investment property, as a fact without a value."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.contains(F.lower(x), F.lit("investment propert")))
    rows = pages.select("filing_id", "page_no", F.try_element_at(lines, F.lit(1)).alias("label")).where("label is not null")
    return rows.select(
        "filing_id",
        F.lit("note").alias("kind"),
        "label",
        F.lit("investment_properties_fair_value_total").alias("code"),
        F.lit(None).cast("double").alias("value"),
        "page_no",
        F.lit(None).cast("int").alias("line_no"),
        F.lit(0.2).alias("confidence"),
        fl.currency(F.col("label")).alias("currency"),
        fl.unit_scale(F.col("label")).alias("unit_scale"),
    )


def extracted_facts(pages: DataFrame) -> DataFrame:
    """Facts of all table lines and, for each page, of its first line on investment properties."""
    table = fl.line_facts(pages).select("filing_id", F.lit("table").alias("kind"), "label", "code", "value", "page_no", "line_no", "confidence")
    table = table.withColumn("currency", fl.currency(F.col("label"))).withColumn("unit_scale", fl.unit_scale(F.col("label")))
    return table.unionByName(property_lines(pages))


def _numbered(rows: DataFrame, prefix: str, name: str) -> DataFrame:
    """rows with an id of filing and place inside it."""
    place = F.row_number().over(Window.partitionBy("filing_id").orderBy(*[F.col(c).asc_nulls_first() for c in _ORDER], "label"))
    return rows.withColumn(name, F.concat_ws("_", F.lit(prefix), F.col("filing_id").cast("string"), place.cast("string")))


def statement_line_items(index: DataFrame, facts: DataFrame) -> DataFrame:
    """Table facts with fact_id and their filing's stock_code and period_end (null for filings that index lacks)."""
    rows = _numbered(facts.where("kind = 'table'"), "fact", "fact_id").join(
        index.select("filing_id", "stock_code", "period_end"),
        "filing_id",
        "left"
    )
    names = {"code": "line_item_code", "label": "line_item_label_raw", "confidence": "extract_confidence"}
    return rows.withColumnsRenamed(names).drop("kind").withColumn("scope", F.lit("group")).withColumn("as_reported_sign", F.lit(1))


def first_numeric(label: Column, value: Column, patterns: tuple[str, ...], order: Column) -> Column:
    """Aggregate: the number of the first row, by pattern and then by order, whose label holds a pattern (in any case).

    A row's number is its value, else the last whole number in its label; rows without one are passed over.
    """
    digits = F.try_element_at(F.regexp_extract_all(label, F.lit(r"(\d[\d,]*)"), F.lit(1)), F.lit(-1))
    number = F.coalesce(value.cast("double"), F.regexp_replace(digits, ",", "").try_cast("double"))
    rank = F.coalesce(*[F.when(F.contains(F.lower(label), F.lit(p)), F.lit(i)) for i, p in enumerate(patterns)])
    return F.min_by(number, F.when(rank.isNotNull() & number.isNotNull(), F.struct(rank, order)))


def capital_structure(index: DataFrame, facts: DataFrame) -> DataFrame:
    """A row per filing of index: shares in issue and their weighted average, by label; null where no label has a number."""
    order = F.struct(*[F.col(c) for c in _ORDER], F.col("label"))
    numbers = facts.groupBy("filing_id").agg(
        first_numeric(F.col("label"), F.col("value"), SHARE_LABELS, order).alias("shares_outstanding_period_end"),
        first_numeric(F.col("label"), F.col("value"), AVERAGE_LABELS, order).alias("weighted_avg_shares_basic"),
    )
    rows = index.select("filing_id", "stock_code", "period_end").join(numbers, "filing_id", "left")
    return rows.withColumn("capital_fact_id", F.concat(F.lit("cap_"), F.col("filing_id").cast("string"))).withColumn("extract_confidence", F.lit(0.2))


def debt_schedule(index: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of index's filings whose label names a borrowing, with debt_fact_id, debt_type and amount."""
    rows = _numbered(facts.where(F.contains(F.lower("label"), F.lit("borrow"))), "debt", "debt_fact_id")
    joined = rows.join(index.select("filing_id", "stock_code", "period_end"), "filing_id")
    return joined.select(
        "debt_fact_id",
        "filing_id",
        "stock_code",
        "period_end",
        F.lit("other").alias("debt_type"),
        "currency",
        F.col("value").alias("amount"),
        "page_no"
    )


def property_notes(index: DataFrame, facts: DataFrame) -> DataFrame:
    """Notes and facts on investment properties; a metric's number, where it has one."""
    rows = facts.where((F.col("kind") == "note") | F.contains(F.coalesce("code", F.lit("")), F.lit("investment_properties")))
    joined = _numbered(rows, "ip", "ip_note_fact_id").join(index.select("filing_id", "stock_code", "period_end"), "filing_id", "left")
    return joined.select(
        "ip_note_fact_id",
        "filing_id",
        "stock_code",
        "period_end",
        F.col("code").alias("metric_code"),
        F.col("label").alias("metric_label_raw"),
        F.col("value").alias("value_num"),
        "page_no"
    )


def review_sheet(rows: DataFrame, target: str, keys: list[str], field: str, value: str) -> DataFrame:
    """rows with what a reviewer fills in: the suggested value, empty override columns, and the row's key as JSON."""
    empty = {"override_value_num": "double", "override_value_text": "string", "override_reason": "string", "reviewer": "string"}
    out = rows.select(
        F.lit(target).alias("target_table"),
        F.to_json(F.struct(*keys)).alias("target_key_json"),
        F.lit(field).alias("field_name"),
        F.col(value).alias("suggested_value")
    )
    return out.select("*", *[F.lit(None).cast(t).alias(n) for n, t in empty.items()], F.lit("pending").alias("status"))


def core_review_sheet(items: DataFrame) -> DataFrame:
    """Review sheet of the statement line items with the core codes."""
    return review_sheet(
        items.where(F.col("line_item_code").isin(*CORE_CODES)),
        "statement_line_items",
        ["filing_id", "line_item_code"],
        "value",
        "value"
    )


def import_overrides(sheets: DataFrame) -> DataFrame:
    """Filled sheets as overrides: unknown states are pending; override_id names table, key and field.

    A sheet without target_table, target_key_json and field_name gives no row.
    """
    keys = ["target_table", "target_key_json", "field_name"]
    if not set(keys) <= set(sheets.columns):
        return sheets.limit(0)
    known = F.when(F.col("status").isin(*STATES), F.col("status")).otherwise("pending")
    return sheets.withColumn(
        "override_id",
        F.concat(F.lit("ovr_"), F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 12))
    ).withColumn("status", known)


def apply_overrides(items: DataFrame, overrides: DataFrame) -> DataFrame:
    """items with the approved numbers of overrides on (filing_id, line_item_code); an explicit step of its own."""
    key = F.from_json("target_key_json", "filing_id long, line_item_code string")
    approved = overrides.where("status = 'approved' and target_table = 'statement_line_items' and field_name = 'value'")
    new = approved.groupBy(key.alias("k")).agg(F.max_by("override_value_num", "override_id").alias("_new")).select("k.*", "_new")
    return items.join(new, ["filing_id", "line_item_code"], "left").withColumn("value", F.coalesce("_new", "value")).drop("_new")


def curate(index: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """All curated tables of filings and their pages, in the order in which they build on each other; an empty index is an error."""
    if index.limit(1).count() == 0:
        raise ValueError("no filing in the index")
    facts = extracted_facts(pages)
    items = statement_line_items(index, facts)
    return {
        "filings_index": index,
        "statement_line_items": items,
        "capital_structure": capital_structure(index, facts),
        "debt_schedule": debt_schedule(index, facts),
        "investment_property_notes": property_notes(index, facts),
        "review_book_nav_core": core_review_sheet(items),
    }
