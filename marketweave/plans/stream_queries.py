"""Registered streaming queries: each runs over the event table as a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.io import scratch
from ..streaming import live
from . import sqlkit as q

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(key: str, build, digits: dict[str, int], sql: str | None, plain: tuple[str, ...]) -> None:
    def run(spark, sf_dir):
        rows = build(live.events(spark, f"{sf_dir}/events.parquet"))
        out = live.run_to_end(rows, scratch(spark, key))
        return out.select(
            *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in ("start", "stop") else F.col(c) for c in plain],
            *[F.round(c, d).alias(c) for c, d in digits.items()]
        )

    QUERIES[key] = run
    if sql:
        ORACLE_SQL[key] = sql


# windows that the watermark has not passed at the end of the data are not emitted
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
_FMT = "'%Y-%m-%d %H:%M:%S'"
_add("str01_live_bars", live.live_bars, {"open": 2, "high": 2, "low": 2, "close": 2}, f"""
WITH b AS (SELECT date_trunc('hour', ts) AS s, event_type, min_by(value, {{'a': ts, 'b': event_id}}) AS open, max(value) AS high, min(value) AS low, max_by(value, {{'a': ts, 'b': event_id}}) AS close, count(*) AS n FROM events GROUP BY ALL)
SELECT strftime(s, {_FMT}) AS start, event_type, n, round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low, round(close, 2) AS close FROM b WHERE s + INTERVAL 1 HOUR <= {_CLOSED}""", ("start", "event_type", "n"))
_add(
    "str02_live_distinct",
    lambda r: live.live_distinct(r.select("event_id", "user_id", "ts", "value"), ["event_id"]),
    {"value": 2},
    "SELECT event_id, user_id, round(value, 2) AS value FROM events",
    ("event_id", "user_id")
)
_add(
    "str03_live_hysteresis",
    lambda r: live.live_hysteresis(r, 60.0, 10.0),
    {},
    "SELECT event_id, user_id, coalesce(last_value(CASE WHEN value > 60 THEN 1 WHEN value < 10 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id "
    "ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS state FROM events",
    ("event_id", "user_id", "state")
)
_TOP = "CASE WHEN s.wait > 0 THEN 0.0 ELSE greatest(s.peak, n.value, 0.0) END"
_FELL = f"s.wait = 0 AND ({_TOP}) > 0 AND n.value / nullif(({_TOP}), 0) - 1 <= -0.9"
_LIVE_STOP = q.walk(
    "ls",
    "events",
    {"held": "1", "peak": "greatest(n.value, 0.0)", "wait": "0"},
    {
        "held": f"CASE WHEN s.wait > 0 OR ({_FELL}) THEN 0 ELSE 1 END",
        "peak": f"CASE WHEN {_FELL} THEN 0.0 ELSE {_TOP} END",
        "wait": f"CASE WHEN {_FELL} THEN 2 ELSE greatest(s.wait - 1, 0) END"
    },
    "user_id",
    "ts, event_id"
)
_add(
    "str04_live_trailing_stop",
    lambda r: live.live_trailing_stop(r, 0.9, 2),
    {},
    f"WITH RECURSIVE {_LIVE_STOP} SELECT event_id, user_id, held FROM ls",
    ("event_id", "user_id", "held")
)
# rows that the watermark has not passed at the end of the data wait in the state
_PASSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
_add(
    "str03_ordered_hysteresis",
    lambda r: live.ordered_hysteresis(r, 60.0, 10.0),
    {},
    "SELECT event_id, user_id, state FROM (SELECT *, coalesce(last_value(CASE WHEN value > 60 THEN 1 WHEN value < 10 THEN 0 END IGNORE NULLS) OVER "
    f"(PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS state FROM events) WHERE date_trunc('milliseconds', ts) < {_PASSED}",
    ("event_id", "user_id", "state")
)
_add(
    "str04_ordered_trailing_stop",
    lambda r: live.ordered_trailing_stop(r, 0.9, 2),
    {},
    f"WITH RECURSIVE {_LIVE_STOP} SELECT event_id, user_id, held FROM ls WHERE event_id IN (SELECT event_id FROM events WHERE "
    f"date_trunc('milliseconds', ts) < {_PASSED})",
    ("event_id", "user_id", "held")
)
_add("str05_live_rolling", live.live_rolling, {"mean": 6, "std": 4}, f"""
WITH e AS (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events)
SELECT strftime(s, {_FMT}) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 4) AS std FROM e GROUP BY s, event_type HAVING s + INTERVAL 2 HOUR <= {_CLOSED}""", ("start", "event_type", "n"))
_add("str06_live_sessions", live.live_sessions, {"total": 2}, f"""
WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS c FROM events),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT strftime(min(ts), {_FMT}) AS start, strftime(max(ts) + INTERVAL 30 MINUTE, {_FMT}) AS stop, user_id, count(*) AS n, round(sum(value), 2) AS total FROM g GROUP BY user_id, g HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""", ("start", "stop", "user_id", "n"))
