"""Ordered work on keys of any size.

A key of at most ROWS rows is one group. A longer key is cut into blocks of ROWS consecutive rows; each block is in a
group of its own, and what earlier blocks say reaches it as a state:

* scan: each block returns a summary that tells the state after it for any state before it; the summaries of a key, a
  few numbers for each block, are folded in order, and blocks are finished in parallel.
* speculate: for rules without a small summary. All blocks run from the first state; then those whose predecessor ended
  in another state than assumed run again, until none is left. Rules that forget soon need few rounds; one that never
  forgets needs as many as its longest key has blocks.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.io import kept

#: Rows of a block.
ROWS = 65_536
_ARROW = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}

State = Any
Columns = dict[str, np.ndarray]


class Scan(NamedTuple):
    """The state before a key, a block's summary, the state after a block, and a block's values. States and summaries are JSON values."""

    start: State
    summarise: Callable[[Columns], Any]
    fold: Callable[[State, Any], State]
    finish: Callable[[Columns, State], dict[str, Any]]


def same(a: DataFrame, b: DataFrame, columns: list[str], prefix: str = "_of_") -> list[Column]:
    return [a[c].eqNullSafe(b[prefix + c]) for c in columns]


def renamed(df: DataFrame, columns: list[str], prefix: str = "_of_") -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) if c in columns else F.col(c) for c in df.columns])


def long_keys(df: DataFrame, key: list[str], rows: int) -> DataFrame | None:
    """The keys (named _of_...) of more than `rows` rows: at most one for each `rows` rows of df; None without any."""
    found = kept(renamed(df.groupBy(*key).count().where(F.col("count") > rows).select(*key), key), "long-keys")
    return found if found.limit(1).count() else None


def numbered(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """df with _pos: a row's place in its key, from 0. Rows are dealt to ranges of (key, order) and sorted there, so no key is in one task."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in key], *order]
    table = kept(df.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    table = table.withColumn("_range", F.shiftright("_id", 33))
    sizes = table.groupBy(*key, "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy("_range")) - F.col("_n")
    sizes = renamed(sizes.withColumn("_before", before).drop("_n"), [*key, "_range"])
    joined = table.join(sizes, same(table, sizes, [*key, "_range"]))
    return joined.withColumn("_pos", F.col("_id") - F.col("_first") + F.col("_before")).select(*df.columns, "_pos")


def in_blocks(df: DataFrame, key: list[str], order: str | list[str], rows: int, reach: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys that fit a block, and those of longer keys with _pos and _block (None without any).

    With a reach, each block also has copies of the `reach` rows before it; these have a _pos below its first.
    """
    hot = long_keys(df, key, rows)
    if hot is None:
        return df, None
    order = [F.col(o).asc_nulls_last() for o in ([order] if isinstance(order, str) else order)]
    cold, long = df.join(hot, same(df, hot, key), "left_anti"), df.join(hot, same(df, hot, key), "left_semi")
    block = lambda p: F.floor(p / rows).cast("long")
    long = numbered(long, key, order)
    if not reach:
        return cold, long.withColumn("_block", block(F.col("_pos")))
    copies = F.explode(F.sequence(block(F.col("_pos")), block(F.col("_pos") + reach)))
    last = long.groupBy(*key).agg(F.max("_pos").alias("_last"))
    last = renamed(last, key)
    spread = long.withColumn("_block", copies).join(last, same(long, last, key)).where(F.col("_block") <= block(F.col("_last")))
    return cold, kept(spread.select(*df.columns, "_pos", "_block"), "blocks")


def columns_of(rows: pa.Table, reads: list[str]) -> Columns:
    return {c: rows.column(c).to_numpy() for c in reads}


def with_columns(rows: pa.Table, out: dict[str, str], values: dict[str, Any], inputs: list[str]) -> pa.Table:
    added = [pa.array(values[name], _ARROW[kind], from_pandas=True) for name, kind in out.items()]
    return pa.table([*[rows.column(c) for c in inputs], *added], names=[*inputs, *out])


def schema_of(df: DataFrame, columns: list[str], out: dict[str, str]) -> str:
    fields = [f for f in df.schema if f.name in columns]
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], *[f"`{k}` {v}" for k, v in out.items()]])


def in_order(rows: pa.Table, order: list[str]) -> pa.Table:
    return rows.sort_by([(o, "ascending") for o in order])


def scan(df: DataFrame, key: list[str], order: str | list[str], reads: list[str], out: dict[str, str], how: Scan, rows: int = ROWS) -> DataFrame:
    """df with the columns `out` (names and types), made from the columns `reads` of each key's rows in order; null orders come last."""
    order, inputs = [order] if isinstance(order, str) else order, df.columns
    cold, hot = in_blocks(df, key, order, rows)
    schema = schema_of(df, inputs, out)

    def whole(part: pa.Table) -> pa.Table:
        part = in_order(part, order)
        return with_columns(part, out, how.finish(columns_of(part, reads), how.start), inputs)

    done = cold.groupBy(*key).applyInArrow(whole, schema)
    if hot is None:
        return done
    hot, keyed = kept(hot, "blocks"), ", ".join(f"`{k}` {t}" for k, t in df.dtypes if k in key)

    def summary(part: pa.Table) -> pa.Table:
        part = in_order(part, ["_pos"])
        one = part.slice(0, 1).select([c for c in inputs if c in key])
        return one.append_column("_block", part.column("_block").slice(0, 1)).append_column("_text", pa.array([json.dumps(how.summarise(columns_of(part, reads)))]))

    def carry(part: pa.Table) -> pa.Table:
        part, state, states = in_order(part, ["_block"]), how.start, []
        for text in part.column("_text").to_pylist():
            states.append(json.dumps(state))
            state = how.fold(state, json.loads(text))
        return part.drop_columns(["_text"]).append_column("_state", pa.array(states, pa.string()))

    def one_block(part: pa.Table, state: pa.Table) -> pa.Table:
        part = in_order(part, ["_pos"])
        return with_columns(part, out, how.finish(columns_of(part, reads), json.loads(state.column("_state")[0].as_py())), inputs)

    summaries = kept(hot.groupBy(*key, "_block").applyInArrow(summary, f"{keyed}, _block long, _text string"), "summaries")
    states = kept(summaries.groupBy(*key).applyInArrow(carry, f"{keyed}, _block long, _state string"), "states")
    return done.unionByName(hot.groupBy(*key, "_block").cogroup(states.groupBy(*key, "_block")).applyInArrow(one_block, schema))


def speculate(
    df: DataFrame,
    key: list[str],
    order: str | list[str],
    reads: list[str],
    out: dict[str, str],
    start: State,
    run: Callable[[Columns, State], tuple[dict[str, Any], State]],
    rows: int = ROWS
) -> DataFrame:
    """df with the columns `out` of a rule that walks each key's rows: run gives a block's values and the state (JSON) after it."""
    order, inputs = [order] if isinstance(order, str) else order, df.columns
    cold, hot = in_blocks(df, key, order, rows)
    schema = schema_of(df, inputs, out)

    def whole(part: pa.Table) -> pa.Table:
        part = in_order(part, order)
        return with_columns(part, out, run(columns_of(part, reads), start)[0], inputs)

    done = cold.groupBy(*key).applyInArrow(whole, schema)
    if hot is None:
        return done
    hot, keyed = kept(hot, "blocks"), ", ".join(f"`{k}` {t}" for k, t in df.dtypes if k in key)
    blocks, at = [*key, "_block"], Window.partitionBy(*key).orderBy("_block")

    def end(part: pa.Table, state: pa.Table) -> pa.Table:
        part = in_order(part, ["_pos"])
        after = json.dumps(run(columns_of(part, reads), json.loads(state.column("_state")[0].as_py()))[1])
        return state.append_column("_end", pa.array([after], pa.string()))

    def one_block(part: pa.Table, state: pa.Table) -> pa.Table:
        part = in_order(part, ["_pos"])
        return with_columns(part, out, run(columns_of(part, reads), json.loads(state.column("_state")[0].as_py()))[0], inputs)

    narrow = hot.select(*dict.fromkeys([*key, "_pos", "_block", *reads]))
    states = kept(hot.select(*blocks).distinct().withColumn("_state", F.lit(json.dumps(start))), "states")
    todo, ended = states, None
    while True:
        only = renamed(todo.select(*blocks), blocks)
        part = narrow if ended is None else narrow.join(only, same(narrow, only, blocks), "left_semi")
        new = part.groupBy(*blocks).cogroup(todo.groupBy(*blocks)).applyInArrow(end, f"{keyed}, _block long, _state string, _end string")
        if ended is not None:
            rest = ended.join(only, same(ended, only, blocks), "left_anti")
            new = new.unionByName(rest)
        ended = kept(new, "block-ends")
        ended_ = ended.withColumn("_due", F.coalesce(F.lag("_end").over(at), F.lit(json.dumps(start))))
        todo = kept(ended_.where(F.col("_due") != F.col("_state")).select(*blocks, F.col("_due").alias("_state")), "block-states")
        if todo.limit(1).count() == 0:
            break
    states = ended.select(*blocks, "_state")
    return done.unionByName(hot.groupBy(*blocks).cogroup(states.groupBy(*blocks)).applyInArrow(one_block, schema))
