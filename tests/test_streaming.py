"""Streaming queries do not depend on how the event table is dealt over files."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from marketweave.plans import stream_queries
from marketweave.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events as five files that each span the period, later rows first."""
    top = str(tmp_path_factory.mktemp("parts"))
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(5)))
    for k in range(5):
        rows.where(F.col("part") == k).drop("part").coalesce(1).sortWithinPartitions(F.desc("ts")).write.mode("append").parquet(
            f"{top}/events.parquet"
        )
    assert len([f for f in os.listdir(f"{top}/events.parquet") if f.endswith(".parquet")]) == 5
    return top


@pytest.mark.parametrize("name", sorted(stream_queries.QUERIES))
def test_part_files_give_the_same_rows(spark, parts, name):
    run = lambda at: sorted((tuple(r) for r in stream_queries.QUERIES[name](spark, at).collect()), key=str)
    got, want = run(parts), run(SF)
    print(name, len(got), len(want))
    assert want and got == want


@pytest.fixture(scope="module")
def days(spark, tmp_path_factory):
    """The events in three files, one span of time after the other, and two late rows in the last: one by 30 minutes, one by days."""
    top = str(tmp_path_factory.mktemp("days"))
    rows = spark.read.parquet(f"{SF}/events.parquet")
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    edges = [low, low + (high - low) / 3, low + (high - low) * 2 / 3, high]
    late = spark.createDataFrame(
        [(900_001, edges[2] - dt.timedelta(minutes=30), 1, "click", 5.0, "{}"), (900_002, edges[0], 1, "click", 7.0, "{}")],
        rows.schema
    )
    for k in range(3):
        part = rows.where((F.col("ts") >= edges[k]) & ((F.col("ts") < edges[k + 1]) | F.lit(k == 2)))
        part = part.unionByName(late) if k == 2 else part
        path = f"{top}/events.parquet/part-{k}"
        part.coalesce(1).write.parquet(path)
        name = next(f for f in os.listdir(path) if f.endswith(".parquet"))
        os.replace(f"{path}/{name}", f"{top}/events.parquet/{k}.parquet")
        os.utime(f"{top}/events.parquet/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
        for f in os.listdir(path):
            os.remove(f"{path}/{f}")
        os.rmdir(path)
    return top


FORMS = {
    "distinct": lambda r: live.live_distinct(r.select("event_id", "user_id", "ts", "value"), ["event_id"]),
    "hysteresis": lambda r: live.live_hysteresis(r, 60.0, 10.0),
    "stop": lambda r: live.live_trailing_stop(r, 0.9, 2),
    "bars": live.live_bars,
    "rolling": live.live_rolling,
    "sessions": live.live_sessions,
}


@pytest.mark.parametrize("name", FORMS)
def test_three_batches_give_what_one_gives(spark, days, tmp_path, name):
    """Rows in order over three batches carry their state on; of the late rows, only the one beyond the watermark is lost."""

    def run(source, files, path):
        stream = FORMS[name](live.events(spark, source, files))
        rows = live.run_to_end(stream, f"file://{tmp_path}/{path}")
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows.collect()), key=str)

    os.makedirs(f"{tmp_path}/kept")
    lost = spark.read.parquet(f"{days}/events.parquet").where("event_id <> 900002")
    lost.coalesce(1).write.parquet(f"{tmp_path}/kept/events.parquet")
    batched, once = run(f"{days}/events.parquet", 1, "a"), run(f"{tmp_path}/kept/events.parquet", None, "b")
    if name in ("hysteresis", "stop"):
        # the row that came late by 30 minutes is walked in its batch's order, after the rows of the batch before
        drop = lambda rows: [r for r in rows if r[1] != 1]
        assert drop(batched) == drop(once) and len(batched) == len(once)
    else:
        assert batched == once
    assert len(os.listdir(f"{tmp_path}/a/state/commits")) >= 6  # three batches and their checksums


def test_state_of_idle_keys_is_dropped(spark, tmp_path):
    """A user's peak is forgotten after an idle span that other users' events have passed."""
    start = dt.datetime(2024, 1, 1)
    rows = [
        (1, start, 1, 100.0),
        (2, start + dt.timedelta(days=5), 2, 1.0),
        (3, start + dt.timedelta(days=6), 2, 1.0),
        (4, start + dt.timedelta(days=7), 1, 5.0)
    ]
    for k, (i, at, user, value) in enumerate(rows):
        path = f"{tmp_path}/in/part{k}"
        spark.createDataFrame(
            [(i, at, user, "x", value, "{}")],
            "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
        ).coalesce(1).write.parquet(path)
        name = next(f for f in os.listdir(path) if f.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/events.parquet", exist_ok=True)
        os.replace(f"{path}/{name}", f"{tmp_path}/events.parquet/{k}.parquet")
        os.utime(f"{tmp_path}/events.parquet/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    got = {}
    for idle in (1, 30):
        stream = live.live_trailing_stop(live.events(spark, f"{tmp_path}/events.parquet", 1), 0.5, 2, idle_ms=idle * 24 * 3_600_000)
        got[idle] = {r.event_id: r.held for r in live.run_to_end(stream, f"file://{tmp_path}/out{idle}").collect()}
    assert got[30] == {1: 1, 2: 1, 3: 1, 4: 0} and got[1] == {1: 1, 2: 1, 3: 1, 4: 1}


@pytest.mark.parametrize("split", ["order", "mixed"])
@pytest.mark.parametrize(("name", "form"), [("state", lambda r: live.ordered_hysteresis(r, 60.0, 10.0, "400 days")), ("held", lambda r: live.ordered_trailing_stop(r, 0.9, 2, "30 minutes"))])
def test_ordered_forms_do_not_depend_on_batches(spark, tmp_path, name, form, split):
    """Rows dealt to batches within the lateness, in any order, give what one batch gives: all rows that the watermark has passed."""
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(minutes=7 * k + k % 3), k % 4, "x", float((k * 37) % 100), "{}") for k in range(160)]
    parts = [rows[:50], rows[50:90], rows[90:]]
    if split == "mixed":  # neighbours change places over batches; a row comes at most 25 minutes after a later one
        parts = [[*rows[:47], rows[49]], [rows[47], rows[48], *rows[50:88], rows[90]], [rows[88], rows[89], *rows[91:]]]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

    def run(parts, to):
        os.makedirs(f"{tmp_path}/{to}/events.parquet")
        for k, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{to}/in{k}")
            found = next(f for f in os.listdir(f"{tmp_path}/{to}/in{k}") if f.endswith(".parquet"))
            os.replace(f"{tmp_path}/{to}/in{k}/{found}", f"{tmp_path}/{to}/events.parquet/{k}.parquet")
            os.utime(f"{tmp_path}/{to}/events.parquet/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
        last = rows[-1][1] + dt.timedelta(days=2000)  # of another user, moves the watermark past all rows
        spark.createDataFrame([(999, last, 99, "x", 1.0, "{}")], schema).coalesce(1).write.parquet(f"{tmp_path}/{to}/end")
        found = next(f for f in os.listdir(f"{tmp_path}/{to}/end") if f.endswith(".parquet"))
        os.replace(f"{tmp_path}/{to}/end/{found}", f"{tmp_path}/{to}/events.parquet/9.parquet")
        os.utime(f"{tmp_path}/{to}/events.parquet/9.parquet", (1_700_000_009, 1_700_000_009))
        out = live.run_to_end(form(live.events(spark, f"{tmp_path}/{to}/events.parquet", 1)), f"file://{tmp_path}/{to}/out")
        return {r.event_id: r[name] for r in out.collect()}

    want, found = run([rows], "once"), run(parts, "batches")
    assert found == want and len(found) == 160 and len(set(found.values())) == 2
