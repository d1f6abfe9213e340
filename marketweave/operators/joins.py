"""Temporal joins: as-of in both directions, intervals, event replays, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import ROWS, kept, long_keys, renamed, same


def asof(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_time: str,
    right_time: str,
    values: list[str],
    direction: str = "backward",
    exact: bool = True,
    rows: int = ROWS
) -> DataFrame:
    """left with the values of the nearest row of right in time: the last before (backward) or the first after (forward).

    Rows of right with a null in any of the values are skipped; exact says whether equal times match. Both sides are
    put in one order per key and the last known values run along it, so that the cost is one sort. A key of more than
    `rows` rows of both sides is dealt to ranges of time; a range without a value yet takes the last of those before it.
    Null keys match null keys.
    """
    for v in values:
        right = right.where(F.col(v).isNotNull())
    backward = direction == "backward"
    payload = F.struct(*[F.col(c) for c in left.columns])
    found = F.struct(F.col(right_time).alias("matched"), *[F.col(v) for v in values])
    a = left.select(
        *on,
        F.col(left_time).cast("timestamp").alias("_t"),
        F.lit(1 if exact else 0).alias("_k"),
        payload.alias("_left"),
        F.lit(None).cast(right.select(found.alias("x")).schema["x"].dataType).alias("_right")
    )
    b = right.select(
        *on,
        F.col(right_time).cast("timestamp").alias("_t"),
        F.lit(0 if exact else 1).alias("_k"),
        F.lit(None).cast(a.schema["_left"].dataType).alias("_left"),
        found.alias("_right")
    )
    order = [F.col("_t").asc() if backward else F.col("_t").desc(), F.col("_k").asc()]
    last = F.last("_right", ignorenulls=True)
    along = lambda *by: last.over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = a.unionByName(b)
    hot = long_keys(both, on, rows)
    if hot is None:
        merged = both.withColumn("_hit", along(*on))
    else:
        short = both.join(hot, same(both, hot, on), "left_anti").withColumn("_hit", along(*on))
        long = both.join(hot, same(both, hot, on), "left_semi")
        by = [*[F.col(k) for k in on], *order, F.xxhash64("_left", "_right")]
        ranges = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        long = long.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
        long = kept(long, "as-of").withColumn("_range", F.shiftright("_id", 33))
        # one row for each range and key that meet
        ends = long.groupBy(*on, "_range").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_id"))).alias("_end"))
        before = Window.partitionBy(*on).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        carried = renamed(ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end"), [*on, "_range"])
        inside = last.over(Window.partitionBy(*on, "_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
        long = long.withColumn("_hit", inside).where(F.col("_left").isNotNull())
        long = long.join(carried, same(long, carried, [*on, "_range"])).withColumn("_hit", F.coalesce("_hit", "_carried"))
        merged = short.unionByName(long.select(*short.columns))
    merged = merged.where(F.col("_left").isNotNull())
    return merged.select("_left.*", F.col("_hit.matched").alias("matched"), *[F.col(f"_hit.{v}").alias(v) for v in values])


def disjoint(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """key, start and end of the unions of each key's overlapping spans; spans without a start or an end, or that end before they start, are none."""
    fine = spans.where(F.col(start) <= F.col(end)).groupBy(key, start).agg(F.max(end).alias(end))
    w = Window.partitionBy(key).orderBy(start)
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = fine.withColumn("_new", F.coalesce(F.col(start) > reached, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(key, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def within_span(rows: DataFrame, spans: DataFrame, key: str, at: str, start: str = "start", end: str = "end") -> DataFrame:
    """rows with alive: whether the date lies in one of the key's spans; unknown keys and missing dates are not alive.

    Overlapping spans are joined first, so a row meets one at most and repeated rows stay. Spans are spread over the
    months in which there are rows, and a row meets the few spans of its key and month, however many the key has.
    """
    month = lambda c: F.trunc(c, "month")
    ends = rows.agg(month(F.min(at)).alias("_low"), F.max(at).alias("_high"))
    s = disjoint(spans, key, start, end).select(F.col(key).alias("_key"), F.col(start).alias("_start"), F.col(end).alias("_end"))
    s = s.crossJoin(F.broadcast(ends)).where((F.col("_end") >= F.col("_low")) & (F.col("_start") <= F.col("_high")))  # one row
    months = F.sequence(month(F.greatest("_start", "_low")), month(F.least("_end", "_high")), F.expr("interval 1 month"))
    s = s.select("_key", "_start", "_end", F.explode(months).alias("_month"))
    hit = (F.col(key) == F.col("_key")) & (month(F.col(at)) == F.col("_month")) & F.col(at).between(F.col("_start"), F.col("_end"))
    return rows.join(s, hit, "left").select(*rows.columns, F.col("_key").isNotNull().alias("alive"))


def next_trading_date(events: DataFrame, calendar: DataFrame, at: str, strict: bool) -> DataFrame:
    """events with trade_date: the first date of the calendar at (or after, if strict) the event; null after its end.

    The calendar is a dimension: spread to one row per day (some 36,000 a century), with the dates on and after that
    day, it is broadcast, and each event looks its own day up. An event before the calendar looks up the day before it.
    """
    cal = calendar.select(F.col("date").alias("_c")).distinct()
    ends = cal.agg(F.date_sub(F.min("_c"), 1).alias("_low"), F.max("_c").alias("_high"))
    days = ends.select(F.explode(F.sequence("_low", "_high")).alias("_day")).join(F.broadcast(cal), F.col("_day") == F.col("_c"), "left")
    back = Window.orderBy(F.col("_day").desc())
    first = lambda last: F.last("_c", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, last))
    days = days.select("_day", first(0).alias("_on"), first(-1).alias("_after"))
    rows = events.crossJoin(F.broadcast(ends.select("_low")))  # one row
    rows = rows.withColumn("_d", F.when(F.col(at).isNotNull(), F.greatest(F.to_date(at), F.col("_low"))))
    late = F.lit(True) if strict else F.col(at).cast("timestamp") > F.to_date(at).cast("timestamp")
    found = rows.join(F.broadcast(days), F.col("_d") == F.col("_day"), "left")
    # what lies before the calendar is late in any case
    return found.select(*events.columns, F.when(late & (F.to_date(at) >= F.col("_low")), F.col("_after")).otherwise(F.col("_on")).alias("trade_date"))


def replay_delta(grid: DataFrame, events: DataFrame, seeds: list[str] | None = None) -> DataFrame:
    """grid (date, ticker) with member: whether the running sum of +1 and -1 events, plus 1 for seeds, is above 0.

    events: ticker, date (a trading date), delta.
    """
    sums = events.groupBy("date", "ticker").agg(F.sum("delta").alias("_d"))
    rows = grid.join(sums, ["date", "ticker"], "left")
    seed = F.col("ticker").isin(seeds or []).cast("int")
    running = F.sum(F.coalesce("_d", F.lit(0))).over(Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("member", running + seed > 0).drop("_d")


def replay_last(grid: DataFrame, events: DataFrame, seeds: list[str] | None = None) -> DataFrame:
    """grid with member by the last action so far (remove after add on one day); without one, by the seeds."""
    last = events.groupBy("date", "ticker").agg(F.min("delta").alias("_d"))
    rows = grid.join(last, ["date", "ticker"], "left")
    state = F.last("_d", ignorenulls=True).over(Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("member", F.coalesce(state > 0, F.col("ticker").isin(seeds or []))).drop("_d")


def first_within(starts: DataFrame, states: DataFrame, on: list[str], at: str, h: int) -> DataFrame:
    """starts with delay: places until the first row of states (rows where the target state holds) from the start on, null beyond h."""
    hit = asof(
        starts.withColumn("_t", F.timestamp_seconds(at)),
        states.select(*on, F.col(at).alias("_p"), F.timestamp_seconds(at).alias("_s")),
        on,
        "_t",
        "_s",
        ["_p"],
        "forward",
        True
    )
    return hit.withColumn("delay", F.when(F.col("_p") - F.col(at) <= h, F.col("_p") - F.col(at))).drop("_t", "_p", "matched")


def known(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))
