"""Registered queries against their DuckDB SQL on the smallest tables."""

import glob
import math
import os

import pytest

from marketweave.plans import registry

SF = "/root/testdata/sf0.001"
#: One or more of each family; the others are compared in the same way by the driver.
NAMES = [
    "agg05_mom_decile_summary",
    "agg25_roc_auc",
    "flt10_universe_bundle",
    "jon06_next_close_after",
    "jon14_replay_last",
    "ml09_hac_slope",
    "nav12_revalued_nav",
    "pf02_weights_backtest",
    "reg09_bull_cycles",
    "sig20_bull_bear_total",
    "src18_filled_sheets",
    "str06_live_sessions",
    "top01_long_short_weights",
    "win07_ewm",
    "xs04_neutralize"
]


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return round(float(x), 9)
    return str(x)[:10] if hasattr(x, "year") else x


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    order = [list(want.columns).index(n) for n in names]
    a = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=str)
    b = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)
    assert a == b
