"""Alerts, trend episodes and exits: rules whose next step depends on the last one, run per key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import ma, staged
from .blocks import ROWS, speculate
from .regimes import spaced


def trend_episodes(
    df: DataFrame,
    start: str,
    price: str,
    window: int,
    below: int,
    cooldown: int,
    key: str = "ticker",
    order: str = "date"
) -> DataFrame:
    """key, start, end, n: from a row with the start flag to the first later row from which `below` closes in a row lie
    under their mean (the last row but `below` at the latest); no start counts until `cooldown` rows after an end.
    Starts whose end is not found are left out."""
    marked = staged(df, _m=ma(price, window, key=key, order=order), _under=F.coalesce(F.col(price) < F.col("_m"), F.lit(False)))
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(0, below - 1)
    marked = marked.withColumn("_end", (F.min(F.col("_under").cast("int")).over(ahead) == 1) & (F.count(F.lit(1)).over(ahead) == below))
    rows = marked.select(key, order, F.coalesce(F.col(start), F.lit(False)).alias("_start"), "_end")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, out, last = part.sort_values(order), [], None
        at = list(part[order])
        ends = np.flatnonzero(part["_end"].to_numpy()[: max(len(part) - below, 0)])
        for i in np.flatnonzero(part["_start"].to_numpy()):
            k = np.searchsorted(ends, i + 1)
            if (last is None or i > last + cooldown) and k < len(ends):
                last = int(ends[k])
                out.append((part[key].iloc[0], at[i], at[last], last - int(i)))
        return pd.DataFrame(out, columns=[key, "start", "end", "n"])

    return rows.groupBy(key).applyInPandas(run, f"{key} string, start date, end date, n long")


def collapse_alerts(df: DataFrame, flag: str, cooldown_days: int, key: list[str], order: str = "date", rows: int = ROWS) -> DataFrame:
    """kept: alerts more than cooldown_days calendar days after the last one kept."""
    return speculate(df, key, order, [flag, order], {"kept": "boolean"}, None, spaced(cooldown_days + 1, flag, order, "kept"), rows)


def match_alerts(events: DataFrame, alerts: DataFrame, key: str, at: str, tolerance: int) -> DataFrame:
    """key, event, alert: for each event in order, the earliest alert within the tolerance that no earlier event has used.

    at is a number, or a date (counted in days since 1970).
    """
    place = lambda df: F.unix_date(at) if dict(df.dtypes)[at] == "date" else F.col(at).cast("long")
    a = alerts.select(key, place(alerts).alias("at"), F.lit(1).alias("kind"))
    both = events.select(key, place(events).alias("at"), F.lit(0).alias("kind")).unionByName(a)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found, first, out = np.sort(rows["at"][rows.kind == 1].to_numpy()), 0, []
        for e in np.sort(rows["at"][rows.kind == 0].to_numpy()):
            # alerts before the last one used lie before this event's span, too
            i = max(first, int(np.searchsorted(found, e - tolerance)))
            hit = i < len(found) and found[i] <= e + tolerance
            out.append((rows[key].iloc[0], e, found[i] if hit else None))
            first = i + 1 if hit else first
        return pd.DataFrame(out, columns=[key, "event", "alert"]).astype({"event": "int64", "alert": "Int64"})

    return both.groupBy(key).applyInPandas(run, f"{key} string, event long, alert long")


def score_alerts(
    rows: DataFrame,
    flag: str,
    labels: DataFrame,
    tolerance: int,
    cooldown_days: int,
    key: str = "ticker",
    order: str = "date"
) -> DataFrame:
    """key, n_events, n_alerts, tp, fn, fp, precision, recall, mean_delay: collapsed alerts against labelled dates.

    labels: key and order, a row per event. Keys without event or alert have no ratio of what they lack.
    """
    kept = collapse_alerts(rows.select(key, order, flag), flag, cooldown_days, [key], order).where("kept").select(key, order)
    hits = match_alerts(labels.select(key, order), kept, key, order, tolerance)
    matched = hits.groupBy(key).agg(
        F.count("*").alias("n_events"),
        F.count("alert").alias("tp"),
        F.avg(F.col("alert") - F.col("event")).alias("mean_delay")
    )
    counts = kept.groupBy(key).agg(F.count("*").alias("n_alerts"))
    out = rows.select(key).distinct().join(matched, key, "left").join(counts, key, "left").fillna(0, ["n_events", "tp", "n_alerts"])
    out = out.withColumn("fn", F.col("n_events") - F.col("tp")).withColumn("fp", F.col("n_alerts") - F.col("tp"))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return out.withColumn("precision", ratio("tp", "n_alerts")).withColumn("recall", ratio("tp", "n_events"))


def early_exit(df: DataFrame, entries: DataFrame, h: int, price: str, window: int) -> DataFrame:
    """ticker, entry, exit, ret: exit on the first row in 1..h whose price is under its mean, else after h rows."""
    marked = staged(df, _m=ma(price, window)).select(
        F.col("ticker").alias("_t"),
        F.col("pos").alias("_p"),
        F.col(price).alias("_px"),
        (F.col(price) < F.col("_m")).alias("_below")
    )
    path = entries.select("ticker", F.col("pos").alias("entry"), F.col(price).alias("paid")).join(
        marked,
        (F.col("ticker") == F.col("_t")) & F.col("_p").between(F.col("entry") + 1, F.col("entry") + h)
    )
    out = path.groupBy("ticker", "entry", "paid").agg(F.min(F.when(F.col("_below"), F.col("_p"))).alias("broke"), F.max("_p").alias("last"))
    out = out.withColumn("exit", F.coalesce("broke", "last"))
    last = marked.select(F.col("_t").alias("_t2"), F.col("_p").alias("_p2"), F.col("_px").alias("sold"))
    return out.join(last, (F.col("ticker") == F.col("_t2")) & (F.col("exit") == F.col("_p2"))).select(
        "ticker",
        "entry",
        "exit",
        (F.try_divide("sold", "paid") - 1).alias("ret")
    )
