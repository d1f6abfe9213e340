"""Helpers shared by the corpus operators: cut points, joins on hot keys, flat word arrays."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds over 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys at any size.
HOT_SHARE = 500
#: Rows of a batch handed to Python; a row's text is never split.
BATCH_ROWS = 500


#: Paths of the tables that cut has written, in order.
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine, if unset, one beside the warehouse."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table into the shared folder and reads it back, which ends its lineage.

    The table outlives any executor. It stays until release drops it, or the folder's owner clears the folder.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int) -> int:
    """Drops the tables that cut has written after the first `since`, all but the last one; returns how many are left.

    For a caller that has just written a result made of them, and needs them no more.
    """
    for path in _WRITTEN[since:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN[since:] = _WRITTEN[-1:] if len(_WRITTEN) > since else []
    return len(_WRITTEN)


def drop_tables(spark: SparkSession, paths: list[str], docs: DataFrame) -> list[str]:
    """Drops those of the tables at paths that docs does not read; returns the others."""
    read = [f.rpartition("/")[0] for f in docs.inputFiles()] if paths else []
    held = [p for p in paths if any(f.endswith(f"/{p.rpartition('/')[2]}") for f in read)]
    for path in (p for p in paths if p not in held):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return held


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def hot_join(rows: DataFrame, names: DataFrame, keys: list[str], count: str, how: str = "inner", few: int = 0) -> DataFrame:
    """rows joined with names on keys, where a few keys may hold most rows.

    names has one row per key and, in column count, how many of the rows carry it. Keys with more than
    1/HOT_SHARE of all rows are under HOT_SHARE in number, so that part is broadcast whatever the size of
    the data; all other keys are joined by shuffle, where adaptive execution splits a partition that one of
    them still makes too large. Null keys match null keys. At most `few` names (narrow rows, under 100 bytes) are
    broadcast whole, so that rows are neither shuffled nor read once more for the hot keys.
    """
    total, most, n = (x or 0 for x in names.agg(F.sum(count), F.max(count), F.count("*")).first())
    names = names.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in names.columns])
    hot = names.where(F.col(count) * HOT_SHARE > F.lit(total))
    on = lambda a, b: [a[k].eqNullSafe(b[f"_{k}"]) for k in keys]
    joined = lambda a, b, how: a.join(b, on(a, b), how).drop(*[f"_{k}" for k in keys])
    if n <= few:
        return joined(rows, F.broadcast(names), how)
    if most * HOT_SHARE <= total:
        return joined(rows, names, how)
    hot_keys = F.broadcast(hot.select(*[f"_{k}" for k in keys]))
    cold = names.where(F.col(count) * HOT_SHARE <= F.lit(total))
    return joined(joined(rows, hot_keys, "left_semi"), F.broadcast(hot), how).unionByName(joined(joined(rows, hot_keys, "left_anti"), cold, how))


def sized(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df for the small side of a join: broadcast if it has at most `most` rows, else as it is, to be joined by shuffle.

    df is narrow (ids and hashes, under 100 bytes a row) and cheap to count (a table that cut has written).
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def id_crc(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(doc_id.cast("string")) % mod


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64; kept for later calls up to a bound."""
    known = _TABLES.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 19), base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if len(known) <= 1 << 22:
            _TABLES[base] = known
    return known[:n]


def flat_words(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than space and \\x09-\\x0D) of many texts as flat arrays.

    Returns a 64-bit hash, the byte length and the text's number for each word, in order, and the flat bytes.
    """
    flat = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    if lower:
        flat = LOWER[flat]
    space = SPACE[flat]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    starts = np.flatnonzero(edge == -1)
    ends = np.flatnonzero(edge == 1)
    ends = ends[ends > 0] if len(ends) and ends[0] == 0 else ends
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(flat)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_PINV, len(flat) + 1)[starts]
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return mix(hashes ^ (ends - starts).astype(np.uint64)), ends - starts, owner, flat


def windows(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside a text, and the number of each window's first word."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for j in range(n):
        factor = np.uint64((0xD1342543DE82EF95 * (2 * j + 1)) % (1 << 64) | 1)
        total += mix(hashes[j : len(hashes) - n + 1 + j] * factor)
    first = np.flatnonzero(owner[: len(total)] == owner[n - 1 :])
    return mix(total[first]), first
