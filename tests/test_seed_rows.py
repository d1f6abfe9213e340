"""Seed rows, their indexer and the linear ranker's folds."""

import datetime

import numpy as np
import pytest

from marketweave.operators import filings, ranking
from marketweave.sources import filing_sources


def test_given_fields_win(spark):
    seed = spark.createDataFrame(
        [
            (16, " Annual Report for year ended 31 December 2020 ", None, "2021-04-01T10:00:00", None, None, None),
            (123456, "Annual Report 2020", "special", None, "2021-04-02", "2020-06-30", "own-id"),
            (1, "Annual Report 2020", None, None, None, None, None),  # no publication
            (1, "Something else", None, "2021-04-01", None, None, None),  # no type
            (1, None, "special", " ", "2021-05-01", "never", None),
        ],
        "stock_code long, title string, doc_type string, publish_datetime string, publish_date string, period_end string, filing_id string",
    )
    issuers = spark.createDataFrame([("00016", "Sixteen")], "stock_code string, issuer_name string")
    got = {r.stock_code: r for r in filings.normalize_seeds(seed, "r1", issuers, "Default").collect()}
    assert set(got) == {"00016", "123456", "00001"}
    first = got["00016"]
    assert first.issuer_name == "Sixteen" and first.period_end == datetime.date(2020, 12, 31) and first.fiscal_half == "FY" and first.doc_id == first.filing_id
    assert first.title == "Annual Report for year ended 31 December 2020" and first.language == "EN" and first.discovery_run_id == "r1"
    own = got["123456"]
    assert own.filing_id == own.doc_id == "own-id" and own.doc_type == "special" and own.fiscal_half == "H1" and own.fiscal_year == 2020
    assert own.publish_datetime_hk == "2021-04-02T00:00:00" and own.issuer_name == "Default"
    assert got["00001"].period_end is None and got["00001"].title == "" and got["00001"].publish_datetime_hk == "2021-05-01T00:00:00"


def test_folder_of_seeds(spark, tmp_path):
    (tmp_path / "00016.csv").write_text("title,publish_date,notes\nAnnual Report 2020,2021-04-01,a\nAnnual Report 2020,2021-04-01,b\n")
    (tmp_path / "00016.jsonl").write_text('{"title": "Interim Report 2020", "publish_date": "2020-09-01", "language": "ZH"}\n')
    (tmp_path / "00688.jsonl").write_text('{"title": "Annual Report 2019", "publish_date": "2020-04-01", "stock_code": 688}\n')
    seeds = filing_sources.discover(spark, filing_sources.INDEXERS["seeds"](str(tmp_path)), ["00016", "00688", "00001"], 2019, 2021)
    rows = {(r.stock_code, r.title, r.language): r.notes for r in filings.filing_index(seeds, "r").collect()}
    assert rows == {("00016", "Annual Report 2020", "EN"): "b", ("00016", "Interim Report 2020", "ZH"): None, ("00688", "Annual Report 2019", "EN"): None}


def test_linear_folds_equal_least_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2))
    y = x @ (1, 2) + 3 + rng.normal(size=60)
    rows = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(60)], "pos int, a double, b double, label double")
    folds = spark.createDataFrame([(0, 0, 29), (1, 10, 49), (2, 900, 999)], "fold int, train_start int, train_end int")
    got = {r.fold: r.weights for r in ranking.linear_folds(rows, folds, ("a", "b")).collect()}
    assert set(got) == {0, 1}
    for fold, low, high in ((0, 0, 30), (1, 10, 50)):
        want = np.linalg.lstsq(np.column_stack([np.ones(high - low), x[low:high]]), y[low:high], rcond=None)[0]
        assert got[fold] == pytest.approx(want)
