"""Line facts: how often a line is searched, and which value of a code comes first."""

from marketweave.operators import filings as fl
from pyspark.sql import functions as F

LINES = (
    ("Total equity 1,234", "total_equity", 1234.0), ("subtotal equity 7", None, None), ("Non-controlling interests (5)", "non_controlling_interests", -5.0),
    ("Borrowings and unborrowings", None, None), ("Cash and Bank Balances 12 (3,000.5)", "cash_and_bank_balances", -3000.5),
)


def test_each_line_is_searched_once_and_facts_are_summed_up_by_hash(spark):
    pages = spark.createDataFrame([(1, i, line) for i, (line, _, _) in enumerate(LINES)], "filing_id long, page_no int, text string")
    facts = fl.line_facts(pages)
    got = {r.page_no: (r.code, r.value) for r in facts.collect()}
    assert got == {i: (code, value) for i, (_, code, value) in enumerate(LINES) if code or i == 3}
    plan = fl.pivot_facts(facts, ["total_equity"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert "SortAggregate" not in plan


def test_first_value_is_by_page_and_line_a_missing_place_first(spark):
    rows = [(1, 2, 0, "a", 20.0), (1, 1, 9, "a", 19.0), (1, 1, -3, "a", 13.0), (2, 5, 1, "a", 51.0), (2, None, 7, "a", 7.0), (3, 1, 1, "a", None), (3, 2, 2, "a", 22.0)]
    for kind in ("int", "long"):
        facts = spark.createDataFrame(rows, f"filing_id long, page_no {kind}, line_no int, code string, value double")
        got = {r.filing_id: r.a for r in fl.pivot_facts(facts, ["a"]).collect()}
        assert got == {1: 13.0, 2: 7.0, 3: 22.0}, kind
    assert fl.pivot_facts(facts.where(F.lit(False)), ["a"]).count() == 0
