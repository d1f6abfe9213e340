"""Filing to fact to net asset value: title parsing, line facts, curated tables, valuation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Titles that are left out, and ordered patterns of the document types (fixed values).
DROPPED_TITLES = r"(?i)\bnotice of\b|\bproxy\b"
DOC_TYPES = (
    (r"(?i)\bannual report\b", "annual_report"),
    (r"(?i)\binterim report\b", "interim_report"),
    (r"(?i)\b(annual|final)\s+results\b", "annual_results"),
    (r"(?i)\binterim results\b", "interim_results")
)
#: Patterns of table lines with the canonical code, if the line's label decides it (fixed values).
TABLE_RULES = (
    ("equity attributable to", "equity_attributable_to_owners"),
    ("non-controlling interests", "non_controlling_interests"),
    (r"\btotal equity\b", "total_equity"),
    ("cash and bank balances", "cash_and_bank_balances"),
    (r"\bborrowings\b", None)
)
#: Patterns of note headings and of metrics in notes (fixed values).
NOTE_HEADINGS = (
    ("investment_properties", r"(?i)\binvestment properties\b"),
    ("fair_value", r"(?i)\bfair value (measurement|gain|loss)?\b"),
    ("valuation", r"(?i)\bvaluation\b"),
    ("deferred_tax", r"(?i)\bdeferred tax\b"),
    ("borrowings", r"(?i)\b(borrowings|interest-bearing liabilities)\b"),
    ("share_capital", r"(?i)\bshare capital\b"),
    ("eps", r"(?i)\bearn(?:ings)? per share\b")
)
METRIC_RULES = (
    ("(?i)fair value gain", "fair_value_gain_loss"),
    ("(?i)investment properties", "investment_properties_fair_value_total"),
    ("(?i)cap rate", "valuation_cap_rate_low"),
    ("(?i)discount rate", "discount_rate_low"),
    ("(?i)rental income", "rental_income"),
    ("(?i)deferred tax", "deferred_tax_revaluation_related"),
    ("(?i)valuer|valued by", "valuer_name")
)
#: Scenario, cap-rate shift in basis points, uplift of investment properties, hidden development reserve (fixed values).
SCENARIOS = (("rnav_base", 0, 0.0, 0.05), ("rnav_bull", -25, 0.05, 0.10), ("rnav_bear", 25, -0.05, 0.0))
#: Haircut on deferred tax in every scenario (fixed value).
TAX_HAIRCUT = 0.25


def doc_type(title: Column) -> Column:
    out = F.when(title.rlike(DROPPED_TITLES), F.lit(None).cast("string"))
    for pattern, name in DOC_TYPES:
        out = out.when(title.rlike(pattern), name)
    return out


def period_end(title: Column) -> Column:
    """A date such as 30 June 2024 after "for" or "ended", else one such as 2024/06/30."""
    words = F.regexp_extract(title, r"(?i)(?:for|ended)\s+(\d{1,2}\s+[A-Za-z]+\s+\d{4})", 1)
    digits = F.regexp_replace(F.regexp_extract(title, r"(\d{4}[/-]\d{2}[/-]\d{2})", 1), "/", "-")
    return F.coalesce(
        F.try_to_timestamp(words, F.lit("d MMMM yyyy")),
        F.try_to_timestamp(words, F.lit("d MMM yyyy")),
        F.try_to_timestamp(digits, F.lit("yyyy-MM-dd"))
    ).cast("date")


def currency(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)hk\$|hkd"), "HKD").when(text.rlike(r"(?i)rmb|cny"), "CNY").when(text.rlike(r"(?i)us\$|usd"), "USD")


def unit_scale(text: Column) -> Column:
    return F.when(text.rlike("(?i)million"), "millions").when(text.rlike("(?i)thousand|'000"), "thousands").otherwise("units")


def line_item(label: Column) -> Column:
    """The canonical code of the first rule that the label matches."""
    out, low = None, F.lower(label)
    for pattern, name in TABLE_RULES:
        out = F.when(_holds(low, pattern), F.lit(name)) if out is None else out.when(_holds(low, pattern), F.lit(name))
    return out


def last_number(line: Column) -> Column:
    """The last number of a line; commas are dropped and parentheses mean a minus."""
    found = F.regexp_extract_all(line, F.lit(r"(\(?-?\d[\d,]*\.?\d*\)?)"), F.lit(1))
    number = lambda text: F.regexp_replace(text, r"[(),]", "").try_cast("double")
    # inside transform the line is searched once, however often its last number is looked at
    signed = F.transform(F.array(F.try_element_at(found, F.lit(-1))), lambda t: F.when(t.startswith("("), -number(t)).otherwise(number(t)))
    return F.get(signed, F.lit(0))


def hk_ticker(code: Column) -> Column:
    """Digits padded to four, with the exchange's suffix; null without a digit. Longer codes are never cut."""
    digits = F.regexp_replace(code.cast("string"), r"\D+", "")
    return F.when(digits != "", F.concat(F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0")), F.lit(".HK")))


def filing_id(stock: Column, publish: Column, title: Column) -> Column:
    return F.concat_ws("_", stock, F.substring(F.sha1(F.concat_ws("|", stock, publish, title).cast("binary")), 1, 16))


def fiscal_half(end: Column) -> Column:
    return F.when(end.isNotNull(), F.when(F.month(end) == 6, "H1").otherwise("FY"))


def index_filings(seed: DataFrame) -> DataFrame:
    """Classified filings with period, fiscal fields and ids; of equal stock, type, publication and title one stays.

    seed: stock_code, title, publish_datetime_hk (text). Titles of no known type and rows without a date are dropped.
    """
    rows = seed.withColumn("doc_type", doc_type(F.col("title"))).where("doc_type is not null and publish_datetime_hk is not null")
    rows = rows.withColumn("period_end", period_end(F.col("title"))).withColumn(
        "filing_id",
        filing_id(F.col("stock_code"), F.col("publish_datetime_hk"), F.col("title"))
    )
    rows = rows.withColumn("fiscal_year", F.year("period_end")).withColumn("fiscal_half", fiscal_half(F.col("period_end")))
    return rows.dropDuplicates(["stock_code", "doc_type", "publish_datetime_hk", "title"])


#: Columns of a seed row; all but title may be missing.
SEED_FIELDS = (
    "title", "doc_type", "publish_datetime_hk", "publish_datetime", "publish_date", "period_end", "stock_code", "issuer_name", "filing_id", "doc_id",
    "language", "hkex_url", "pdf_url", "notes",
)


def normalize_seeds(seed: DataFrame, run_id: str, issuers: DataFrame | None = None, default_issuer: str | None = None) -> DataFrame:
    """Filings from seed rows of any of SEED_FIELDS: what a row gives wins over what its title and its other fields say.

    Empty texts count as missing. A row without a given type whose title has no known one is dropped, and so is one
    without a publication: the Hong Kong time, else the time, else midnight of the date. Codes are padded to five
    digits, longer ones stay. The issuer is the given one, else that of the code in issuers (stock_code, issuer_name, a
    row for each code), else the default. Periods that are no dates are null. Repeated rows stay; see filing_index.
    """
    given = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) if c in seed.columns else F.lit(None).cast("string")
    trimmed = lambda x: F.when(F.trim(x) != "", F.trim(x))
    rows = seed.select(*[given(c).alias(c) for c in SEED_FIELDS]).withColumn("title", F.coalesce(F.trim("title"), F.lit("")))
    rows = rows.withColumn("doc_type", F.coalesce("doc_type", doc_type(F.col("title"))))
    at = F.coalesce(trimmed(F.coalesce("publish_datetime_hk", "publish_datetime")), F.concat(trimmed(F.col("publish_date")), F.lit("T00:00:00")))
    rows = rows.withColumn("publish_datetime_hk", at).where("doc_type is not null and publish_datetime_hk is not null")
    code = F.coalesce("stock_code", F.lit(""))
    rows = rows.withColumn("stock_code", F.when(F.length(code) < 5, F.lpad(code, 5, "0")).otherwise(code))
    rows = rows.withColumn("period_end", F.coalesce(F.expr("try_to_date(substr(period_end, 1, 10))"), F.when(F.col("period_end").isNull(), period_end(F.col("title")))))
    if issuers is not None:
        names = issuers.select(F.col("stock_code").alias("_code"), F.col("issuer_name").alias("_name"))
        rows = rows.join(names, F.col("stock_code") == F.col("_code"), "left").withColumn("issuer_name", F.coalesce("issuer_name", "_name"))
    rows = rows.withColumn("filing_id", F.coalesce("filing_id", filing_id(F.col("stock_code"), F.col("publish_datetime_hk"), F.col("title"))))
    return rows.select(
        "filing_id", "stock_code", F.coalesce("issuer_name", F.lit(default_issuer)).alias("issuer_name"), F.coalesce("doc_id", "filing_id").alias("doc_id"), "doc_type",
        "period_end", F.year("period_end").alias("fiscal_year"), fiscal_half(F.col("period_end")).alias("fiscal_half"), "publish_datetime_hk", "title",
        F.coalesce("language", F.lit("EN")).alias("language"), "hkex_url", "pdf_url", F.lit(run_id).alias("discovery_run_id"), F.lit("indexed").alias("parse_status"), "notes",
    )


def filing_index(seed: DataFrame, run_id: str, issuers: DataFrame | None = None, default_issuer: str | None = None) -> DataFrame:
    """normalize_seeds, of rows with equal code, title, publication and language the last one of the seed."""
    rows = normalize_seeds(seed, run_id, issuers, default_issuer).withColumn("_at", F.monotonically_increasing_id())
    same = ["stock_code", "title", "publish_datetime_hk", "language"]
    last = rows.groupBy(*same).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*same, "_at")]), "_at").alias("_row"))
    return last.select(*same, "_row.*").select(*[c for c in rows.columns if c != "_at"])


def _rules(df: DataFrame, rules: tuple, names: str) -> DataFrame:
    """Fixed rules as a broadcast table: as many rows as the constant has."""
    return F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in rules], names))


def _holds(text: Column, pattern: str) -> Column:
    """rlike; fixed words are looked for as they are first, which needs no regular expression where they are missing."""
    words = pattern.replace(r"\b", "")
    if not re.fullmatch(r"[\w -]+", words):
        return text.rlike(pattern)
    return text.contains(words) if words == pattern else text.contains(words) & text.rlike(pattern)


def _matches(text: Column, rules: tuple, value: Column | None = None) -> Column:
    """A row for each rule (pattern, name) whose pattern text holds; each pattern is compiled once.

    value, if given, is worked out here, once for each such row, and not again wherever it is used.
    """
    hits = F.array_compact(F.array(*[F.when(_holds(text, p), F.struct(F.lit(name).cast("string").alias("name"))) for p, name in rules]))
    return F.explode(hits if value is None else F.transform(hits, lambda h: F.struct(h["name"].alias("name"), value.alias("value"))))


def line_facts(pages: DataFrame) -> DataFrame:
    """Every table line and rule that match: filing_id, page_no, line_no, code, value, confidence, label."""
    lines = pages.select("filing_id", "page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    hits = lines.withColumn("hit", _matches(F.lower("line"), TABLE_RULES, last_number(F.col("line"))))
    value = F.col("hit.value")
    code = F.coalesce("hit.name", line_item(F.col("line")))
    return hits.select(
        "filing_id",
        "page_no",
        "line_no",
        code.alias("code"),
        value.alias("value"),
        F.when(value.isNotNull(), 0.45).otherwise(0.2).alias("confidence"),
        F.trim("line").alias("label")
    )


def note_anchors(pages: DataFrame) -> DataFrame:
    hits = pages.withColumn("hit", _matches(F.col("text"), tuple((p, g) for g, p in NOTE_HEADINGS)))
    return hits.select("filing_id", "page_no", F.col("hit.name").alias("note_group"), F.lit(0.8).alias("confidence"))


def note_facts(pages: DataFrame) -> DataFrame:
    """Note lines by metric rule; labels are cut to 250 characters."""
    lines = pages.select("filing_id", "page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    hits = lines.withColumn("hit", _matches(F.col("line"), METRIC_RULES, last_number(F.col("line"))))
    value = F.col("hit.value")
    return hits.select(
        "filing_id",
        "page_no",
        "line_no",
        F.col("hit.name").alias("code"),
        value.alias("value"),
        F.when(value.isNotNull(), 0.35).otherwise(0.25).alias("confidence"),
        F.substring(F.trim("line"), 1, 250).alias("label")
    )


def pivot_facts(facts: DataFrame, codes: list[str]) -> DataFrame:
    """A row per filing with the first value of each code, by page and line."""
    known, place = facts.where("value is not null"), F.struct("page_no", "line_no")
    if all(facts.schema[c].dataType.simpleString() == "int" for c in ("page_no", "line_no")):
        # one number orders as page and line do, a missing one first, and is summed up by hash, without a sort
        page, line = (F.coalesce(F.col(c), F.lit(-(2**31))).cast("long") for c in ("page_no", "line_no"))
        place = page * F.lit(2**32) + line + F.lit(2**31)
    first = lambda c: F.min_by("value", F.when(F.col("code") == c, place)).alias(c)
    return known.groupBy("filing_id").agg(*map(first, codes))


def book_nav(df: DataFrame) -> DataFrame:
    """shares_used, nav_per_share, net_debt, discount; rows without equity or shares are dropped.

    df: equity, cash, borrowings_current, borrowings_noncurrent, shares, weighted_shares, price.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    df = df.withColumn("shares_used", F.coalesce(F.when(F.col("shares") != 0, F.col("shares")), F.col("weighted_shares")))
    df = df.withColumn("shares_source", F.when(F.col("shares") != 0, "period_end").otherwise("weighted_avg_fallback"))
    df = df.where("equity <> 0 and shares_used <> 0").withColumn("nav_per_share", F.col("equity") / F.col("shares_used"))
    df = df.withColumn("net_debt", zero("borrowings_current") + zero("borrowings_noncurrent") - zero("cash"))
    return df.withColumn("discount", F.try_divide("price", "nav_per_share") - 1)


def assumptions(df: DataFrame) -> DataFrame:
    """A row per filing and scenario with the fixed assumptions: a cross product with three rows."""
    return df.crossJoin(_rules(df, SCENARIOS, "scenario string, cap_rate_shift_bps int, ip_uplift double, dev_reserve double"))


def revalued_nav(df: DataFrame) -> DataFrame:
    """rnav_equity, rnav_per_share and discount per filing and scenario, with the components as JSON.

    df: columns of book_nav with investment_properties, deferred_tax and nci.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = assumptions(df).withColumn(
        "ip_adj",
        zero("investment_properties") * F.col("ip_uplift")
    ).withColumn("dev_adj", F.col("equity") * F.col("dev_reserve"))
    rows = rows.withColumn(
        "deferred_tax_adj",
        F.greatest(zero("deferred_tax"), F.col("ip_adj") + F.col("dev_adj")) * TAX_HAIRCUT
    ).withColumn("minority_adj", zero("nci"))
    rows = rows.withColumn("rnav_equity", F.col("equity") + F.col("ip_adj") + F.col("dev_adj") - F.col("deferred_tax_adj") - F.col("minority_adj"))
    rows = rows.withColumn(
        "rnav_per_share",
        F.col("rnav_equity") / F.col("shares_used")
    ).withColumn("rnav_discount", F.try_divide("price", "rnav_per_share") - 1)
    return rows.withColumn("lineage", F.to_json(F.struct("shares_source", "scenario")))
