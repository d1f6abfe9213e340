"""A Merkle manifest of a dataset by time-forward processing.

Leaves are ordered by a range shuffle, and their labels are positions: a node's label is (level, place), and a node of
place p sends its digest to place p // FAN of the next level. A block is FAN ** DEPTH consecutive nodes; its task takes
labels in order from a priority queue in which children have left their digests. Between blocks the queue is the
shuffle, which sorts on disk. A round turns each block into one node, until each source has one; then sources are
joined in the same way.

The sweep back takes labels in reverse: a parent leaves each child its siblings and its own proof, and blocks hand the
proofs of their roots down by a shuffle. So no source is in one task as a whole, however large.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, hot_join, id_crc

#: Nodes of a run, and levels that one block spans: FAN ** DEPTH digests are in a task at a time.
FAN, DEPTH = 3, 7
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_MESSAGE = "grp long, place long, digest binary, proof binary, subroot binary, root binary"


def digest(parts: list[bytes]) -> bytes:
    """The digest of digests, as their hexadecimal text in a row."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The digest of a document's fields, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[_field(c) for c in (doc_id, source, lang, n_chars, text)]).cast("binary"), 256))


def tampered(text: Column) -> Column:
    """The text as a tamperer leaves it: without line feeds."""
    return F.translate(text, "\n", "")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with column `at`: positions from 0 in the order of the given columns (nulls first), without a sort in one task.

    Rows are dealt to ranges and sorted there; a range's positions follow those of the ranges before it.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = cut(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("_id", 33)
    sizes = table.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row for each range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    at = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return table.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("at", at).drop("_id", "_part", "_before")


def steps(n: int) -> int:
    """Levels above n nodes until one is left."""
    found = 0
    while n > 1:
        n, found = -(-n // FAN), found + 1
    return found


def sweep(leaves: list[bytes], levels: int) -> list[list[bytes]]:
    """Digests of all levels of a block, taken in the order of their labels; children's digests wait in a priority queue."""
    queue = [(0, place, 0, d) for place, d in enumerate(leaves)]
    nodes: list[list[bytes]] = [[] for _ in range(levels + 1)]
    while queue:
        level, place = queue[0][:2]
        got = []
        while queue and queue[0][:2] == (level, place):
            got.append(heapq.heappop(queue)[3])
        nodes[level].append(digest(got) if level else got[0])
        if level < levels:
            heapq.heappush(queue, (level + 1, place // FAN, place % FAN, nodes[level][-1]))
    return nodes


def sweep_back(nodes: list[list[bytes]], proof: bytes) -> list[bytes]:
    """Proofs of a block's leaves, in order, from that of its root; labels are taken in reverse.

    A proof is one entry for each level from the leaf up: how many siblings stand to the left and to the right, a byte
    each, and their digests.
    """
    queue, out = [(1 - len(nodes), 0, proof)], [b""] * len(nodes[0])
    while queue:
        level, place, own = heapq.heappop(queue)
        if level == 0:
            out[-place] = own
            continue
        begin = -place * FAN
        run = nodes[-level - 1][begin : begin + FAN]
        for i in range(len(run)):
            entry = bytes([i, len(run) - 1 - i]) + b"".join(run[:i] + run[i + 1 :])
            heapq.heappush(queue, (level + 1, -(begin + i), entry + own))
    return out


def siblings(proof: bytes) -> list[tuple[list[bytes], list[bytes]]]:
    """Digests to the left and to the right of the path, level by level."""
    out, at = [], 0
    while at < len(proof):
        n_left, n = proof[at], proof[at] + proof[at + 1]
        found = [proof[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n)]
        out.append((found[:n_left], found[n_left:]))
        at += 2 + 32 * n
    return out


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    for left, right in siblings(proof):
        leaf = digest([*left, leaf, *right])
    return leaf


def _in_order(rows: pa.Table, depth: int) -> tuple[pa.Table, int]:
    """A block's nodes by place, and the levels that it spans."""
    rows = rows.sort_by("place")
    return rows, min(depth, steps(rows.column("total")[0].as_py()))


def _rise(depth: int):
    def run(rows: pa.Table) -> pa.Table:
        rows, levels = _in_order(rows, depth)
        grp, place, total = (rows.column(c)[0].as_py() for c in ("grp", "place", "total"))
        size, top = FAN**depth, sweep(rows.column("digest").to_pylist(), levels)[-1][0]
        return pa.table(
            {"grp": pa.array([grp], pa.int64()), "place": pa.array([place // size], pa.int64()), "total": pa.array([-(-total // size)], pa.int64()), "digest": [top]}
        )

    return run


def _proofs(nodes: pa.Table, above: pa.Table, depth: int) -> tuple[pa.Table, list[bytes], bytes, bytes]:
    nodes, levels = _in_order(nodes, depth)
    proof, subroot, root = (above.column(c)[0].as_py() for c in ("proof", "subroot", "root"))
    return nodes, sweep_back(sweep(nodes.column("digest").to_pylist(), levels), proof), subroot, root


def _hand_down(depth: int):
    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, proofs, subroot, root = _proofs(nodes, above, depth)
        same = lambda x: pa.array([x] * nodes.num_rows, pa.binary())
        return pa.table(
            {
                "grp": nodes.column("grp"), "place": nodes.column("place"), "digest": nodes.column("digest"), "proof": pa.array(proofs, pa.binary()),
                "subroot": same(subroot), "root": same(root),
            }
        )

    return run


def _verify(depth: int):
    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, proofs, subroot, root = _proofs(nodes, above, depth)
        leaf, other = (nodes.column(c).to_pylist() for c in ("digest", "other"))
        folded = [fold(o or d, p) for d, o, p in zip(leaf, other, proofs, strict=True)]
        shas = [hashlib.sha256("".join(x.hex() for left, right in siblings(p) for x in [*left, *right]).encode()).hexdigest() for p in proofs]
        return pa.table(
            {
                "doc_id": nodes.column("doc_id"), "leaf": [d.hex() for d in leaf], "subroot": [subroot.hex()] * len(leaf), "root": [root.hex()] * len(leaf),
                "proof_sha256": shas, "folded_root": [f.hex() for f in folded], "verified": [f == root for f in folded],
                "proof": pa.array(proofs, pa.binary()),
            }
        )

    return run


def _blocks(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / FAN**depth).cast("long"))


def _rounds(nodes: DataFrame, depth: int, name: str) -> list[DataFrame]:
    """The nodes of each round, the given ones first and one node for each group last."""
    out, most = [nodes], nodes.agg(F.max("total")).first()[0] or 1
    while most > 1 or len(out) == 1:
        rows = _blocks(out[-1].select("grp", "place", "total", "digest"), depth)
        out.append(cut(rows.groupBy("grp", "block").applyInArrow(_rise(depth), "grp long, place long, total long, digest binary"), name))
        most = -(-most // FAN**depth)
    return out


def _down(nodes: DataFrame, above: DataFrame, depth: int, run, schema: str) -> DataFrame:
    """Nodes with the messages of their blocks' roots; a message is for the node of its group and place."""
    messages = above.select(F.col("grp").alias("_grp"), F.col("place").alias("_block"), "proof", "subroot", "root")
    return _blocks(nodes, depth).groupBy("grp", "block").cogroup(messages.groupBy("_grp", "_block")).applyInArrow(run(depth), schema)


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof.

    A leaf is the digest of the row's doc_id, source, lang, n_chars and text, where nulls differ from empty values. In a
    source (null is one, the first) leaves ascend by doc_id, null ids first; rows of equal ids ascend by leaf, and equal
    rows are leaves of their own. folded_root is what a verifier gets who has the proof and a copy whose texts lost
    their line feeds where crc32 of the id is even; verified says whether it is the root. proof has the siblings by
    level (see sweep_back; siblings reads it). Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(*[F.col(c) for c in _FIELDS]).select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "source",
        leaf_digest(*[F.col(c) for c in _FIELDS]).alias("digest"),
        F.when((id_crc(F.col("doc_id"), 2) == 0) & F.col("text").contains("\n"), leaf_digest(*[F.col(c) for c in _FIELDS[:-1]], tampered(F.col("text")))).alias("other"),
    )
    rows = numbered(cut(rows, "leaves"), ["source", "doc_id", "digest", "uid"], "ordered-leaves").drop("uid")
    sources = cut(rows.groupBy("source").agg(F.min("at").alias("start"), F.count("*").alias("total")), "sources")
    sources = cut(numbered(sources, ["start"], "ordered-sources").withColumnRenamed("at", "grp"), "numbered-sources")
    leaves = hot_join(rows, sources, ["source"], "total").select("grp", (F.col("at") - F.col("start")).alias("place"), "total", "digest", "doc_id", "other")
    up = _rounds(cut(leaves, "labelled-leaves"), depth, "merkle-nodes")
    n_sources = sources.count()
    tops = up[-1].select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("place"), F.lit(n_sources).cast("long").alias("total"), "digest")
    over = _rounds(tops, depth, "source-nodes")
    none = F.lit(b"").cast("binary")
    down = over[-1].select("grp", "place", "digest", none.alias("proof"), none.alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(over[:-1]):
        down = cut(_down(nodes, down, depth, _hand_down, _MESSAGE), "source-proofs")
    down = down.select(F.col("place").alias("grp"), F.lit(0).cast("long").alias("place"), "proof", F.col("digest").alias("subroot"), "root")
    for nodes in reversed(up[1:-1]):
        down = cut(_down(nodes, down, depth, _hand_down, _MESSAGE), "block-proofs")
    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof binary"
    return _down(up[0], down, depth, _verify, out)


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in _FIELDS[:-1]) + " || {})"
_TEXT = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_LEAF.format(_TEXT.format("text"))} AS leaf, {_LEAF.format(_TEXT.format("replace(text, chr(10), '')"))} AS bare,
         list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT),
           lambda crc, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
             lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END, xor(crc, b)), 4294967295::UBIGINT) & 1 = 1 AS even
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g
  FROM d
), up(g, lv, place, digest, n) AS (
  SELECT g, 0, place, leaf, n FROM leaves
  UNION ALL
  SELECT g, lv + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), max((n + 2) // 3) FROM up WHERE n > 1 GROUP BY g, lv, place // 3
), subroots AS (
  SELECT g, lv, digest, count(*) OVER () AS n FROM up WHERE n = 1
), top(lv, place, digest, n) AS (
  SELECT 0, g, digest, n FROM subroots
  UNION ALL
  SELECT lv + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), max((n + 2) // 3) FROM top WHERE n > 1 GROUP BY lv, place // 3
), path(g, place, lv, spot, beyond) AS (
  SELECT g, place, 0, place, false FROM leaves
  UNION ALL
  SELECT p.g, p.place, CASE WHEN p.beyond OR p.lv < s.lv THEN p.lv + 1 ELSE 0 END, CASE WHEN p.beyond OR p.lv < s.lv THEN p.spot // 3 ELSE p.g END, p.beyond OR p.lv >= s.lv
  FROM path p JOIN subroots s ON s.g = p.g WHERE NOT p.beyond OR p.lv < (SELECT max(lv) FROM top)
), around AS (
  SELECT p.g, p.place, p.beyond, p.lv, coalesce(string_agg(u.digest, '' ORDER BY u.place) FILTER (u.place < p.spot), '') AS l,
         coalesce(string_agg(u.digest, '' ORDER BY u.place) FILTER (u.place > p.spot), '') AS r
  FROM path p JOIN (SELECT g, lv, place, digest, n, false AS beyond FROM up UNION ALL SELECT NULL, lv, place, digest, n, true FROM top) u
    ON u.beyond = p.beyond AND (p.beyond OR u.g = p.g) AND u.lv = p.lv AND u.place // 3 = p.spot // 3 AND u.n > 1
  GROUP BY ALL
), proofs AS (
  SELECT g, place, sha256(string_agg(l || r, '' ORDER BY beyond, lv)) AS proof_sha256, list(l ORDER BY beyond, lv) AS ls, list(r ORDER BY beyond, lv) AS rs
  FROM around GROUP BY g, place
), folded(g, place, i, digest) AS (
  SELECT g, place, 0, CASE WHEN even THEN bare ELSE leaf END FROM leaves
  UNION ALL
  SELECT f.g, f.place, i + 1, sha256(p.ls[i + 1] || digest || p.rs[i + 1]) FROM folded f JOIN proofs p USING (g, place) WHERE i < len(p.ls)
)
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = t.digest AS verified
FROM leaves JOIN subroots s USING (g) LEFT JOIN proofs p USING (g, place) JOIN folded f ON f.g = leaves.g AND f.place = leaves.place AND f.i = coalesce(len(p.ls), 0),
     (SELECT digest FROM top WHERE n = 1) t
"""
