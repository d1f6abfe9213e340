"""Regimes, events and episodes along ordered rows of a key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import ref, trailing
from .blocks import ROWS, Scan, scan, speculate


def hysteresis(x: str, upper: float, lower: float, key: str = "ticker", order: str = "date") -> Column:
    """1 after x was above upper, 0 after it was below lower, and as it was in between and where x is missing; first 0."""
    trigger = F.when(F.col(x) > upper, 1).when(F.col(x) < lower, 0)
    return F.coalesce(F.last(trigger, ignorenulls=True).over(trailing(None, key, order)), F.lit(0))


def confirmed_hysteresis(
    df: DataFrame,
    x: str,
    upper: float,
    lower: float,
    k: int,
    name: str = "state",
    key: str = "ticker",
    order: str = "date"
) -> DataFrame:
    """hysteresis whose triggers must hold for k rows in a row."""
    w = trailing(k, key, order)
    n = F.count(F.lit(1)).over(w)
    up = (F.min(F.coalesce((F.col(x) >= upper).cast("int"), F.lit(0))).over(w) == 1) & (n == k)
    down = (F.min(F.coalesce((F.col(x) <= lower).cast("int"), F.lit(0))).over(w) == 1) & (n == k)
    df = df.withColumn("_t", F.when(up, 1).when(down, 0))
    return df.withColumn(name, F.coalesce(F.last("_t", ignorenulls=True).over(trailing(None, key, order)), F.lit(0))).drop("_t")


def tri_state(df: DataFrame, x: str, band: float, k: int, name: str = "position", key: str = "ticker", order: str = "date") -> DataFrame:
    """-1, 0 or 1: the sign of x beyond the band, taken over once it has been the same for k rows."""
    df = df.withColumn("_s", F.when(F.col(x) > band, 1).when(F.col(x) < -band, -1).otherwise(0))
    w = trailing(k, key, order)
    same = (F.min("_s").over(w) == F.max("_s").over(w)) & (F.count(F.lit(1)).over(w) == k) & (F.col("_s") != 0)
    df = df.withColumn("_t", F.when(same, F.col("_s")))
    return df.withColumn(name, F.coalesce(F.last("_t", ignorenulls=True).over(trailing(None, key, order)), F.lit(0))).drop("_s", "_t")


def quick_confirm(df: DataFrame, x: str, upper: float, lower: float, name: str = "state", key: str = "ticker", order: str = "date") -> DataFrame:
    """Confirmation whose counter restarts at one: single rows trigger, but for the first two rows of a key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    df = df.withColumn("_t", F.when(place > 2, F.when(F.col(x) > upper, 1).when(F.col(x) < lower, 0)))
    return df.withColumn(name, F.coalesce(F.last("_t", ignorenulls=True).over(trailing(None, key, order)), F.lit(0))).drop("_t")


def quadrant(macro: Column, curve: Column) -> Column:
    return 2 * macro.cast("int") + curve.cast("int")


def spans(df: DataFrame, label: str, key: str = "ticker", order: str = "date", pos: str = "pos") -> DataFrame:
    """key, label, start, end, n of each run of equal labels; a missing label is a label of its own."""
    changed = ~F.col(label).eqNullSafe(
        F.lag(label).over(Window.partitionBy(key).orderBy(order))
    ) | F.lag(F.lit(1)).over(Window.partitionBy(key).orderBy(order)).isNull()
    rows = df.withColumn("_c", changed.cast("int")).withColumn("_g", F.sum("_c").over(trailing(None, key, order)))
    return rows.groupBy(key, "_g").agg(
        F.first(label).alias(label),
        F.min(order).alias("start"),
        F.max(order).alias("end"),
        F.min(pos).alias("first"),
        F.max(pos).alias("last"),
        F.count("*").alias("n")
    ).drop("_g")


def episodes(df: DataFrame, flag: str, least: int = 1, key: str = "ticker", order: str = "date", pos: str = "pos") -> DataFrame:
    """Runs of rows where the flag holds, of at least `least` rows."""
    return spans(
        df.withColumn(flag, F.coalesce(F.col(flag), F.lit(False))),
        flag,
        key,
        order,
        pos
    ).where(F.col(flag) & (F.col("n") >= least)).drop(flag)


def merge_episodes(found: DataFrame, gap: int, key: str = "ticker") -> DataFrame:
    """Episodes with at most `gap` rows between them become one."""
    w = Window.partitionBy(key).orderBy("first")
    rows = found.withColumn(
        "_new",
        (F.coalesce(F.col("first") - F.lag("last").over(w) - 1 > gap, F.lit(True))).cast("int")
    ).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_g").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min("first").alias("first"),
        F.max("last").alias("last")
    ).withColumn("n", F.col("last") - F.col("first") + 1).drop("_g")


def bull_cycles(
    df: DataFrame,
    x: str,
    upper: float,
    lower: float,
    k: int,
    least: int,
    gap: int,
    price: str,
    key: str = "ticker",
    order: str = "date"
) -> DataFrame:
    """Confirmed bull runs, small gaps merged, of some length, with a gain from first to last row."""
    found = merge_episodes(
        episodes(confirmed_hysteresis(df, x, upper, lower, k, "_bull", key, order).withColumn("_bull", F.col("_bull") == 1), "_bull", 1, key, order),
        gap,
        key
    ).where(F.col("n") >= least)
    at = df.select(F.col(key).alias("_key"), F.col("pos").alias("_pos"), F.col(price).alias("_px"))
    first, last = at.select(
        F.col("_key").alias("_k1"),
        F.col("_pos").alias("_p1"),
        F.col("_px").alias("px_first")
    ), at.select(F.col("_key").alias("_k2"), F.col("_pos").alias("_p2"), F.col("_px").alias("px_last"))
    out = found.join(
        first,
        (F.col(key) == F.col("_k1")) & (F.col("first") == F.col("_p1"))
    ).join(last, (F.col(key) == F.col("_k2")) & (F.col("last") == F.col("_p2")))
    return out.withColumn("gain", F.try_divide("px_last", "px_first") - 1).where("gain > 0").drop("_k1", "_p1", "_k2", "_p2")


def minimum_duration(df: DataFrame, state: str, least: int, key: str = "ticker", order: str = "date", rows: int = ROWS) -> DataFrame:
    """steady: the state, but a change is put off until the last one has lasted `least` rows.

    A block's summary says, for each label and age that it may begin with, which it ends with: what follows a change
    depends on the row of the change only.
    """

    def changes(labels: np.ndarray) -> np.ndarray:
        """For each place, the next one after it with another label (the length, where there is none)."""
        n = len(labels)
        other = np.flatnonzero(labels[1:] != labels[:-1]) + 1
        return np.append(other, n)[np.searchsorted(other, np.arange(n), side="right")]

    def following(labels: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """For a state taken over at each place, the place of the next one."""
        n, place = len(labels), np.minimum(np.arange(len(labels)) + least, len(labels))
        at = np.minimum(place, n - 1)
        return np.where(place >= n, n, np.where(labels[at] != labels, place, nxt[at]))

    def first(labels: np.ndarray, nxt: np.ndarray, held, age: int) -> int:
        place = max(0, least - age)
        return len(labels) if place >= len(labels) else place if labels[place] != held else int(nxt[place])

    def summarise(c: dict) -> dict:
        labels = c[state].astype(np.int64)
        n, nxt = len(labels), changes(labels)
        last = np.arange(n)
        step = following(labels, nxt)
        for i in range(n - 1, -1, -1):
            last[i] = i if step[i] >= n else last[step[i]]
        known = [int(x) for x in np.unique(labels)]
        ways = {}
        for held in [*known, None]:
            for age in range(1, min(least, n) + 1):
                age = least - min(least, n) + age
                i = first(labels, nxt, held, age)
                ways[f"{held} {age}"] = None if i >= n else [int(labels[last[i]]), int(min(n - last[i], least))]
        at = int(last[0])
        return {"n": n, "known": known, "ways": ways, "start": [int(labels[at]), int(min(n - at, least))]}

    def fold(s: list | None, block: dict) -> list:
        if s is None:
            return block["start"]
        low = least - min(least, block["n"]) + 1
        way = block["ways"][f"{s[0] if s[0] in block['known'] else None} {s[1]}"] if s[1] >= low else None
        return way or [s[0], min(s[1] + block["n"], least)]

    def finish(c: dict, s: list | None) -> dict:
        labels = c[state].astype(np.int64)
        nxt = changes(labels)
        step, out = following(labels, nxt), np.empty(len(labels), np.int64)
        i = 0 if s is None else first(labels, nxt, *s)
        out[:i] = 0 if s is None else s[0]
        while i < len(labels):
            out[i : step[i]] = labels[i]
            i = int(step[i])
        return {"steady": out}

    return scan(df, [key], order, [state], {"steady": "int"}, Scan(None, summarise, fold, finish), rows)


def spaced(gap: int, flag: str, order: str, name: str):
    """Walks events in order: one counts if it is `gap` days or more after the last that counted. The state is the last one's day.

    How the choice goes on depends on the phase at which a block begins, so no small summary exists; see blocks.speculate.
    """

    def run(c: dict, last: int | None) -> tuple[dict, int | None]:
        day = c[order].astype("datetime64[D]").astype(np.int64)
        hits, out = np.flatnonzero([bool(h) for h in c[flag]]), np.zeros(len(day), bool)
        days = day[hits]
        k = 0 if last is None else int(np.searchsorted(days, last + gap))
        while k < len(hits):
            out[hits[k]], last = True, int(days[k])
            k = max(k + 1, int(np.searchsorted(days, last + gap)))
        return {name: out}, last

    return run


def spaced_events(df: DataFrame, flag: str, gap_days: int, key: list[str], order: str = "date", rows: int = ROWS) -> DataFrame:
    """chosen: events at least gap_days calendar days after the last one chosen, from the first on."""
    return speculate(df, key, order, [flag, order], {"chosen": "boolean"}, None, spaced(gap_days, flag, order, "chosen"), rows)


def trailing_stop(df: DataFrame, w: str, price: str, stop: float, cooldown: int, key: list[str], order: str = "date", rows: int = ROWS) -> DataFrame:
    """held, exit_flag, dd, peak: the weight, but 0 on a row whose price has fallen by `stop` from the trade's peak and for
    `cooldown` rows after it. A trade begins with a positive weight; one that begins without a price is never stopped.

    The state is whether a trade is open, its peak and the cooldown's rows left; see blocks.speculate.
    """

    def run(c: dict, state: list) -> tuple[dict, list]:
        (inside, peak, left), out = state, []
        nan = float("nan")
        for weight, px in zip(np.nan_to_num(c[w].astype(float)).tolist(), c[price].astype(float).tolist(), strict=True):
            wanted = weight > 1e-12
            if wanted and left > 0:
                weight, wanted = 0.0, False
            left = max(left - 1, 0)
            if wanted and not inside:
                inside, peak = True, px
            elif not wanted:
                inside, peak = False, nan
            fall = nan
            if inside:
                peak = px if px > peak else peak
                fall = px / peak - 1
            row = [weight, False, fall, peak]
            if inside and fall <= -stop:
                row[:2] = 0.0, True
                inside, peak, left = False, nan, cooldown
            out.append(row)
        return dict(zip(("held", "exit_flag", "dd", "peak"), map(list, zip(*out, strict=True)), strict=True)), [inside, peak, left]

    out = {"held": "double", "exit_flag": "boolean", "dd": "double", "peak": "double"}
    return speculate(df, key, order, [w, price], out, [False, float("nan"), 0], run, rows)


def kill_switch(df: DataFrame, dd: str, limit: float, lockout: int, key: str, order: str = "date", rows: int = ROWS) -> DataFrame:
    """live: false for `lockout` rows after the drawdown has passed the limit; the row that uses the lockout up is tested again.

    A block's summary says, for each number of locked rows that it may begin with, how many it ends with.
    """

    def fires(c: dict) -> tuple[np.ndarray, np.ndarray]:
        """Rows beyond the limit, and for each the number of the next one that is tested after it."""
        hits = np.flatnonzero(c[dd].astype(float) <= -limit)
        return hits, np.searchsorted(hits, hits + max(lockout, 1))

    def summarise(c: dict) -> list[int]:
        n, (hits, nxt) = len(c[dd]), fires(c)
        last = np.arange(len(hits))
        for i in range(len(hits) - 1, -1, -1):
            last[i] = i if nxt[i] >= len(hits) else last[nxt[i]]
        left = np.arange(lockout + 1)
        i = np.searchsorted(hits, np.maximum(left - 1, 0))
        fired = i < len(hits)
        end = np.maximum(left - n, 0)
        end[fired] = np.maximum(lockout - (n - 1 - hits[last[i[fired]]]), 0)
        return end.tolist()

    def finish(c: dict, left: int) -> dict:
        hits, nxt = fires(c)
        live = np.ones(len(c[dd]), bool)
        live[:left] = False
        i = int(np.searchsorted(hits, max(left - 1, 0)))
        while i < len(hits):
            live[hits[i] + 1 : hits[i] + 1 + lockout] = False
            i = int(nxt[i])
        return {"live": live}

    return scan(df, [key], order, [dd], {"live": "boolean"}, Scan(0, summarise, lambda left, ends: ends[left], finish), rows)


def acceleration(df: DataFrame, price: str, k: int, share: float, key: str = "ticker") -> DataFrame:
    """Rows whose past k-row log return is at least the key's quantile `share` of it."""
    df = df.withColumn("past", F.ln(F.col(price) / ref(price, k))).withColumn("ahead", F.ln(ref(price, -k) / F.col(price)))
    return df.withColumn("edge", F.percentile("past", F.lit(share)).over(Window.partitionBy(key))).where("past >= edge")


def event_paths(df: DataFrame, events: DataFrame, before: int, after: int, price: str, key: str = "ticker") -> DataFrame:
    """key, event, step, level: the price around each event, as a ratio to the event row's. events: key, pos."""
    at = events.select(
        F.col(key).alias("_key"),
        F.col("pos").alias("event"),
        F.explode(F.sequence(F.col("pos") - before, F.col("pos") + after)).alias("_pos")
    )
    base = df.select(F.col(key).alias("_bkey"), F.col("pos").alias("_bpos"), F.col(price).alias("_base"))
    path = at.join(df, (F.col("_key") == F.col(key)) & (F.col("_pos") == F.col("pos"))).join(
        base,
        (F.col("_key") == F.col("_bkey")) & (F.col("event") == F.col("_bpos"))
    )
    return path.select(key, "event", (F.col("_pos") - F.col("event")).alias("step"), F.try_divide(F.col(price), F.col("_base")).alias("level"))
