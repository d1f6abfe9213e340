"""Rows at the watermark itself in the ordered forms of streams."""

import datetime as dt

from marketweave.streaming import live


def test_a_row_at_the_watermark_waits_also_beside_an_earlier_one(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 2, h)
    rows = [(1, 1, at(10), 70.0), (2, 1, at(11), 5.0), (3, 2, at(12), 70.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    out = live.run_to_end(live.ordered_hysteresis(live.events(spark, f"{tmp_path}/events.parquet"), 60.0, 10.0), f"{tmp_path}/run")
    assert [(r.event_id, r.state) for r in out.collect()] == [(1, 1)]
