"""As-of and span joins against loops, on keys shorter and longer than a block."""

import datetime

import numpy as np
import pytest

from marketweave.operators import blocks, joins, windows

DAY = datetime.datetime(2021, 1, 1)


@pytest.fixture(scope="module")
def sides():
    rng = np.random.default_rng(3)
    at = lambda: DAY + datetime.timedelta(hours=int(rng.integers(0, 400)))
    left = [(k, at() if rng.random() > 0.03 else None, i) for k, n in (("a", 200), ("b", 20), (None, 60), ("only", 5)) for i in range(n)]
    right = [(k, t, float(i) if rng.random() > 0.2 else None) for k, n in (("a", 90), ("b", 9), (None, 30), ("other", 5)) for i, t in enumerate({at() for _ in range(n)})]
    return left + left[:7], right


@pytest.mark.parametrize("rows", [blocks.ROWS, 25])
@pytest.mark.parametrize(("direction", "exact"), [("backward", True), ("backward", False), ("forward", True), ("forward", False)])
def test_asof_equals_loop(spark, sides, direction, exact, rows):
    left, right = sides
    got = joins.asof(
        spark.createDataFrame(left, "code string, t timestamp, n int"), spark.createDataFrame(right, "code string, at timestamp, v double"),
        ["code"], "t", "at", ["v"], direction, exact, rows
    )
    back = direction == "backward"
    want = []
    for k, t, n in left:
        if t is None and not back:
            continue
        fits = [(u, v) for c, u, v in right if c == k and v is not None and t is not None and ((u <= t if back else u >= t) if exact else (u < t if back else u > t))]
        u, v = (max(fits) if back else min(fits)) if fits else (None, None)
        want.append((k, t, n, u, v))
    order = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    rows_ = [tuple(r) for r in got.collect() if back or r.t is not None]
    assert sorted(rows_, key=order) == sorted(want, key=order)


def test_spans_keep_repeated_rows(spark):
    rng = np.random.default_rng(4)
    day = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(days=int(k))
    spans = [(c, day(s), day(s + rng.integers(0, 40))) for c in "ab" for s in rng.integers(0, 900, 12)]
    spans += [("a", day(950), datetime.date(9999, 12, 31)), ("b", None, day(5)), ("b", day(20), None), ("b", day(30), day(10)), ("b", datetime.date(1, 1, 1), day(2)), (None, day(0), day(999))]
    rows = [(c, day(k), "x") for c in ("a", "b", "c", None) for k in rng.integers(0, 1000, 80)] + [("a", None, "x")]
    rows += rows[:30]
    got = joins.within_span(spark.createDataFrame(rows, "code string, date date, note string"), spark.createDataFrame(spans, "code string, start date, end date"), "code", "date")
    want = [(*r, any(r[0] is not None and c == r[0] and r[1] and s and e and s <= r[1] <= e for c, s, e in spans)) for r in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_very_many_spans_of_a_key_do_not_multiply_rows(spark):
    rows = spark.range(2000).selectExpr("'a' AS code", "date_add(date'2000-01-01', cast(id * 7 % 9000 AS int)) AS date")
    spans = spark.range(100_000).selectExpr(
        "'a' AS code", "date_add(date'2000-01-01', cast(id * 13 % 9000 AS int)) AS start", "date_add(date'2000-01-01', cast(id * 13 % 9000 + id % 3 AS int)) AS end"
    ).where("datediff(start, date'2000-01-01') % 10 < 5")
    got = joins.within_span(rows, spans, "code", "date")
    assert got.count() == 2000 and 0 < got.where("alive").count() < 2000


@pytest.mark.parametrize("rows", [blocks.ROWS, 20])
def test_rolling_apply_equals_loop(spark, rows):
    rng = np.random.default_rng(2)
    data = [(k, i, float(rng.normal()) if rng.random() > 0.1 else None, float(rng.normal())) for k, n in (("a", 120), ("b", 30), ("c", 3)) for i in range(n)]
    table = spark.createDataFrame(data, "ticker string, date int, x double, y double")
    got = windows.rolling_apply(table, lambda x, y: float(x @ y) if x[0] > -1 else float("inf"), ["x", "y"], 6, "v", rows=rows)
    got = windows.rolling_apply(got, "dot", ["x", "y"], 6, "d", rows=rows)
    found = {(r.ticker, r.date): (r.v, r.d) for r in got.collect()}
    for key in "abc":
        own = [r for r in data if r[0] == key]
        for i, r in enumerate(own):
            last = own[max(i - 5, 0) : i + 1]
            v, d = found[key, r[1]]
            if len(last) < 6 or any(z[2] is None for z in last):
                assert v is None and d is None
            else:
                want = sum(z[2] * z[3] for z in last)
                assert abs(d - want) < 1e-9 and (v is None if last[0][2] <= -1 else abs(v - want) < 1e-9)


def test_aggregates_have_names(spark):
    with pytest.raises(KeyError):
        windows.rolling_apply(spark.createDataFrame([("a", 1, 1.0)], "ticker string, date int, x double"), "nothing", "x", 2, "v")
    with pytest.raises(ValueError, match="exists"):
        windows.register_aggregate("dot", lambda x: x.sum(axis=1))
