"""Streaming forms of bars, deduplication, regimes, stops and rolling statistics on an event stream."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"
#: A key without events for so long loses its state.
IDLE_MS = 90 * 24 * 3_600_000

#: Values of a key's rows in order, and the state after them, from the rows and the state before them.
Step = Callable[[pd.DataFrame, tuple], tuple[list, tuple]]


def events(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The event table as a stream; its local timestamps become instants, which watermarks need.

    path may be one file or a folder: as a pattern, either is listed as the stream's input. All files that are there
    are one batch, whatever their number and order: files may each span the whole period, and a batch of some of them
    would move the watermark past the others' rows. Only rows of files that come later can be late. For files that were
    written in the order of their rows, `files` bounds a batch to as many of them.
    """
    schema = spark.read.parquet(path).schema
    head, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    rows = reader.parquet(f"{head}/[{name[0]}]{name[1:]}")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def live_bars(rows: DataFrame, size: str = "1 hour", late: str = LATE) -> DataFrame:
    """start, event_type, open, high, low, close, n of tumbling windows."""
    w = rows.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    at = F.struct("ts", "event_id")
    return w.agg(
        F.min_by("value", at).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", at).alias("close"),
        F.count("*").alias("n")
    ).select(F.col("window.start").alias("start"), "event_type", "open", "high", "low", "close", "n")


def live_distinct(rows: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def live_rolling(rows: DataFrame, size: str = "2 hours", slide: str = "1 hour", late: str = LATE) -> DataFrame:
    """Mean and deviation of sliding windows."""
    w = rows.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type")
    return w.agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.count("*").alias("n")
    ).select(F.col("window.start").alias("start"), "event_type", "mean", "std", "n")


def live_sessions(rows: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    w = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("session_window.start").alias("start"),
        F.col("session_window.end").alias("stop"),
        "user_id",
        "n",
        "total"
    )


def _ordered(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    found = [p for p in parts if len(p)]
    return pd.concat(found).sort_values(["ts", "event_id"]) if found else pd.DataFrame()


def _keyed(
    rows: DataFrame,
    step: Callable[[pd.DataFrame, tuple], tuple[list, tuple]],
    first: tuple,
    out: str,
    schema: str,
    late: str,
    idle_ms: int
) -> DataFrame:
    """event_id, user_id and column `out`: step walks a user's rows of a batch, in order of time, on from the state that the
    last batch left. Rows behind the watermark are dropped; a user's state goes idle_ms of event time after its last row."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        batch = _ordered(parts)
        if not len(batch):
            return
        found, now = step(batch, state.get if state.exists else first)
        state.update(now)
        last = int(batch["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"event_id": batch["event_id"], "user_id": batch["user_id"], out: found})

    keyed = rows.withWatermark("ts", late).groupBy("user_id")
    return keyed.applyInPandasWithState(run, f"event_id long, user_id long, {out} int", schema, "append", GroupStateTimeout.EventTimeTimeout)


def _switch(upper: float, lower: float) -> Step:
    def step(batch: pd.DataFrame, before: tuple) -> tuple[list, tuple]:
        now, out = before[0], []
        for v in batch["value"]:
            now = 1 if v > upper else 0 if v < lower else now
            out.append(now)
        return out, (now,)

    return step


def _stop(stop: float, cooldown: int) -> Step:
    def step(batch: pd.DataFrame, before: tuple) -> tuple[list, tuple]:
        (peak, wait), out = before, []
        for v in batch["value"]:
            if wait > 0:
                wait, peak = wait - 1, 0.0
                out.append(0)
                continue
            peak = max(peak, v)
            fell = peak > 0 and v / peak - 1 <= -stop
            out.append(0 if fell else 1)
            if fell:
                wait, peak = cooldown, 0.0
        return out, (float(peak), int(wait))

    return step


def live_hysteresis(rows: DataFrame, upper: float, lower: float, late: str = LATE, idle_ms: int = IDLE_MS) -> DataFrame:
    """event_id, user_id, state: on above upper, off below lower, kept in between; the state lives between batches."""
    return _keyed(rows, _switch(upper, lower), (0,), "state", "state int", late, idle_ms)


def live_trailing_stop(rows: DataFrame, stop: float, cooldown: int, late: str = LATE, idle_ms: int = IDLE_MS) -> DataFrame:
    """event_id, user_id, held: 0 on a fall of `stop` from the running peak and for `cooldown` rows after it."""
    return _keyed(rows, _stop(stop, cooldown), (0.0, 0), "held", "peak double, wait int", late, idle_ms)


def _in_order(rows: DataFrame, step: Step, first: tuple, out: str, schema: str, late: str, idle_ms: int) -> DataFrame:
    """event_id, user_id and column `out`: walks a user's rows in order of event time, whatever batches they come in.

    Rows wait in the state until the watermark has passed their millisecond, when no earlier row can come any more; the
    state times out at the earliest waiting row's time, which releases them. What waits is bounded by the lateness and is
    read and written as one value of the user, not row by row. A user without a waiting row keeps its state until the
    watermark has passed its last row by idle_ms.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        us, ids, values, *now = state.get if state.exists else ([], [], [], *first)
        waiting, passed = list(zip(us, ids, values, strict=True)), state.getCurrentWatermarkMs()
        if state.hasTimedOut and not waiting:
            state.remove()
            return
        for part in () if state.hasTimedOut else parts:
            waiting += zip(part["us"].tolist(), part["event_id"].tolist(), part["value"].tolist(), strict=True)
        waiting.sort()
        n = bisect_left(waiting, passed, key=lambda w: w[0] // 1000)
        done, rest = waiting[:n], waiting[n:]
        if done:
            batch = pd.DataFrame(done, columns=["us", "event_id", "value"])
            found, now = step(batch, tuple(now))
        state.update((*([w[i] for w in rest] for i in range(3)), *now))
        wake = rest[0][0] // 1000 if rest else max(passed, done[-1][0] // 1000 if done else 0) + idle_ms
        state.setTimeoutTimestamp(max(wake, passed, 1))
        if done:
            yield pd.DataFrame({"event_id": batch["event_id"], "user_id": key[0], out: found})

    keyed = rows.withWatermark("ts", late).select("ts", "user_id", "event_id", "value", F.unix_micros("ts").alias("us")).groupBy("user_id")
    held = f"us array<long>, event_id array<long>, value array<double>, {schema}"
    return keyed.applyInPandasWithState(run, f"event_id long, user_id long, {out} int", held, "append", GroupStateTimeout.EventTimeTimeout)


def ordered_hysteresis(rows: DataFrame, upper: float, lower: float, late: str = LATE, idle_ms: int = IDLE_MS) -> DataFrame:
    """live_hysteresis over each user's rows in order of time: any split into batches within the lateness gives the same
    rows, those that the watermark has passed."""
    return _in_order(rows, _switch(upper, lower), (0,), "state", "state int", late, idle_ms)


def ordered_trailing_stop(rows: DataFrame, stop: float, cooldown: int, late: str = LATE, idle_ms: int = IDLE_MS) -> DataFrame:
    """live_trailing_stop over each user's rows in order of time; see ordered_hysteresis."""
    return _in_order(rows, _stop(stop, cooldown), (0.0, 0), "held", "peak double, wait int", late, idle_ms)


def run_to_end(rows: DataFrame, path: str) -> DataFrame:
    """Runs the stream over all that is there, into Parquet files under path, and returns what it wrote."""
    conf, store = rows.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(store)
    conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # keeps state and timers on disk
    try:
        query = rows.writeStream.format("parquet").option("path", f"{path}/out").option(
            "checkpointLocation",
            f"{path}/state"
        ).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(store, before)
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/out")
