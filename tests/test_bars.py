"""Bars from order lines against a plain loop, on lines of one order, missing and repeated keys."""

import datetime
import random
from collections import defaultdict

import pytest

from marketweave.sources import bars

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"


@pytest.mark.parametrize("by", ["brand", "nation"])
@pytest.mark.parametrize("large", [False, True])
def test_bars_of_lines(spark, tmp_path, monkeypatch, by, large):
    monkeypatch.setattr(bars, "DIMENSION_ROWS", 3 if large else 100)
    draw, plans = random.Random(3), {}
    start = datetime.datetime(2024, 1, 1)
    lines = [
        (
            draw.choice([None, 1, 2, 3, 4]),
            draw.randrange(8),
            draw.randrange(8),
            draw.randrange(3),
            float(draw.randrange(1, 9)),
            float(draw.randrange(1, 99)),
            start + datetime.timedelta(hours=draw.randrange(24 * 20))
        ) for _ in range(600)
    ]
    parts = [(i, f"Brand#{i % 3}", 10.0) for i in range(7)]
    spark.createDataFrame(lines, LINE).repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, i % 3) for i in range(7)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, f"N{i}") for i in range(3)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")

    whole = bars.kept

    def seen(rows, name):
        plans[name] = rows._jdf.queryExecution().executedPlan().toString()
        return whole(rows, name)

    monkeypatch.setattr(bars, "kept", seen)
    got = {(r.date, r.ticker): r for r in bars.sparse_bars(spark, str(tmp_path), by).collect()}
    groups = defaultdict(list)
    for order, part, supplier, number, quantity, amount, at in lines:
        day = at.date() - datetime.timedelta(at.weekday() if by == "brand" else 0)
        key = part if by == "brand" else supplier
        if key < 7:
            place = (order is not None, order or 0, number, part, supplier)
            groups[day, f"Brand#{key % 3}" if by == "brand" else f"N{key % 3}"].append((place, amount / quantity, quantity, amount))
    assert set(got) == set(groups)
    for key, rows in groups.items():
        r, prices = got[key], [x[1] for x in rows]
        assert r.open in {x[1] for x in rows if x[0] == min(rows)[0]} and r.close in {x[1] for x in rows if x[0] == max(rows)[0]}
        assert (r.high, r.low, r.volume) == (max(prices), min(prices), sum(x[2] for x in rows))
        assert abs(r.turnover - sum(x[3] for x in rows)) < 1e-6
    # no table of all lines is sorted: neither for the groups nor for the join
    assert "Sort" not in plans[f"totals-{by}"]
    assert ("ShuffledHashJoin" in plans[f"totals-{by}"]) == large
