"""Exact duplicates by deterministic block naming.

A text, lower-cased in A-Z only, is cut into blocks of BLOCK bytes. Sorting brings equal blocks together and gives
each distinct block an integer name. Then adjacent names are paired, distinct pairs are named in the same way, and so
on, until each text has one name. Equal names mean equal texts: names come from comparing contents, not from hashing.

Blocks are cut once and written. A block whose hash no other has is named by its own number; others are compared by
content. Blocks that hold over 1/HOT_SHARE of all blocks are named from a broadcast table of fewer than HOT_SHARE rows
(equality of contents again), the rest after one shuffle by content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_SHARE, cut, hot_join, sized, small_batches

#: Bytes of a block.
BLOCK = 4096
_OUT = "uid long, doc_id long, sha string, n int, pos int, block binary, block_hash long"


def _cut_texts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema(
            [
                ("uid", pa.int64()),
                ("doc_id", pa.int64()),
                ("sha", pa.string()),
                ("n", pa.int32()),
                ("pos", pa.int32()),
                ("block", pa.binary()),
                ("block_hash", pa.int64())
            ]
        )
        for batch in batches:
            uid, ids, texts = (c.to_pylist() for c in batch.columns)
            out: list[tuple] = []
            held = 0
            for u, d, t in zip(uid, ids, texts, strict=True):
                t = (t or b"").lower()  # of bytes: A-Z only
                sha, n = hashlib.sha256(t).hexdigest(), max(1, -(-len(t) // size))
                for i in range(n):
                    block = t[i * size : (i + 1) * size]
                    out.append((u, d, sha if not i else None, n, i, block, xxhash.xxh3_64_intdigest(block) - (1 << 63)))
                    held += len(block)
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)],
                            schema=types
                        )
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)

    return run


def _named_blocks(docs: DataFrame, size: int) -> DataFrame:
    """uid, doc_id, sha, n and the array of block names of each row."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("text").cast("binary").alias("text"))
    # numbers are given once: what is read again is what was written
    blocks = cut(rows.mapInArrow(_cut_texts(size), _OUT).withColumn("bid", F.monotonically_increasing_id()), "blocks")
    counts = cut(blocks.groupBy("block_hash").count(), "block-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    # contents are compared only where hashes are equal
    again = counts.where("count > 1").withColumn("hot", (F.col("count") * HOT_SHARE > total) & (F.col("count") > 100)).select("block_hash", "hot")
    again, keep = sized(again), ["uid", "doc_id", "sha", "n", "pos", "name"]
    alone = blocks.drop("block").join(again, "block_hash", "left_anti").withColumn("name", F.col("bid"))
    cold = blocks.join(again.where("not hot"), "block_hash").withColumn("name", F.min("bid").over(Window.partitionBy("block")))
    named = alone.select(*keep).unionByName(cold.select(*keep))
    hot = F.broadcast(again.where("hot").select("block_hash"))
    if again.where("hot").limit(1).count():
        contents = cut(
            blocks.join(hot, "block_hash").groupBy("block").agg(F.lit(1).alias("one"))
            .select("block", (-F.row_number().over(Window.orderBy("block"))).cast("long").alias("hot_name")),
            "hot-blocks",
        )
        warm = blocks.join(hot, "block_hash").join(F.broadcast(contents), "block").withColumn("name", F.col("hot_name"))
        named = named.unionByName(warm.select(*keep))
    arranged = named.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"),
    )
    return cut(arranged, "block-names")


def _name_pairs(arrays: DataFrame) -> DataFrame:
    """One round: arrays of names to arrays of half as many."""
    halves = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")),
        lambda i: F.struct(F.get("names", i * 2).alias("l"), F.coalesce(F.get("names", i * 2 + 1), F.lit(None).cast("long")).alias("r")),
    )
    pairs = cut(arrays.select("uid", F.posexplode(halves).alias("pos", "pair")).select("uid", "pos", "pair.l", "pair.r"), "pairs")
    names = cut(pairs.groupBy("l", "r").count().sortWithinPartitions("l", "r").withColumn("name", F.monotonically_increasing_id()), "pair-names")
    named = hot_join(pairs, names, ["l", "r"], "count")
    return cut(
        named.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names")),
        "name-arrays"
    )


def duplicates(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and all empty texts are equal. The row with the largest doc_id of a group stays (null
    ids rank lowest; of rows with equal id one stays, so each group keeps exactly one row). An empty table gives an
    empty result. Other columns of docs are not read. Texts of any length are named whole.
    """
    small_batches(docs.sparkSession)
    first = _named_blocks(docs.select("doc_id", "text"), block_bytes)
    arrays, done = first.select("uid", "n", "names"), []
    most = first.agg(F.max("n")).first()[0] or 1
    while most > 1:
        done.append(arrays.where(F.size("names") == 1).select("uid", F.col("names")[0].alias("name")))
        arrays = _name_pairs(arrays.where(F.size("names") > 1))
        most = -(-most // 2)
    final = arrays.select("uid", F.col("names")[0].alias("name"))
    for part in done:
        final = final.unionByName(part)
    # texts with a different number of blocks differ, and those with equal numbers are named in the same rounds
    owners = cut(
        first.select("uid", "doc_id", "sha", "n").join(final, "uid"),
        "identities"
    ) if done else first.select("uid", "doc_id", "sha", "n", F.col("names")[0].alias("name"))
    stays = F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"), F.col("uid").alias("u"), F.col("doc_id").alias("d")))
    groups = cut(owners.groupBy("n", "name").agg(stays.alias("top"), F.count("*").alias("group_size")), "groups")
    groups = groups.select("n", "name", F.col("top.d").alias("keep_id"), F.col("top.u").alias("keep_uid"), "group_size")
    out = hot_join(owners, groups, ["n", "name"], "group_size")
    return out.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """The rows of docs that stay, with all their columns; see duplicates."""
    found = cut(duplicates(docs, block_bytes), "dedup")
    # ids and texts of which a row goes, and whether one of their rows stays
    by_text = found.groupBy(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha"))
    lost = cut(by_text.agg(F.max("kept").alias("_stay"), F.min("kept").alias("_all")).where("not _all").drop("_all"), "lost")
    key = F.unhex(F.sha2(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary"), 256))
    marked = docs.withColumn("_key", key)
    marked = marked.join(sized(lost), marked["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_sha")), "left")
    # of rows with equal id and text, one stays
    once = marked.where("_stay").dropDuplicates(["doc_id", "_key"])
    return marked.where("_sha is null").select(*docs.columns).unionByName(once.select(*docs.columns))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
