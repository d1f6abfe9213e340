"""Near duplicates among embeddings: a navigable small-world graph per shard, every vector searched in every shard.

Equal vectors are taken together first. The different ones are dealt to shards by their hash, and each shard builds a
graph (hnsw.build) whose nodes are balls: a vector and those within half the linking angle of it, which are all linked
with each other. A pair of shards is one task: the balls of each are searched in the other's graph. A beam is doubled
for each query whose last result could still be linked, and for all queries until audits pass: planted neighbours at
the linking cosine while the graph is built, and brute force over a few queries of each task. Where a beam would hold
half a shard, the shard is scanned, so a crowd of any size is found whole.

Pairs of balls found are decided by the triangle inequality where it can, else by cosines in double precision. Tasks
give back a count for each vector and a spanning forest of the links that they found, never pairs of a crowd.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hnsw
from .common import cut, hot_join, mix
from .near_dedup import components

#: Least cosine of a link.
COSINE = 0.95
#: Shards at least; vectors and bytes of vectors of a shard at most.
SHARDS, SHARD_ROWS, SHARD_BYTES = 6, 32_768, 64_000_000
#: Beam of a search at first, queries of an audit, and the share of planted neighbours that a graph must find.
BEAM, AUDIT, RECALL = 16, 512, 0.999
#: Bytes of a graph that are in one row.
PIECE = 8_000_000
#: What single precision may take from a similarity, and double precision from an angle or a cosine.
ROUNDING, FINE = 1e-5, 1e-9


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes with a 128-bit key; both are null for vectors that link with nothing."""
    for batch in batches:
        ids, lists = batch.columns
        values, ends = lists.values, np.asarray(lists.offsets)
        flat = values.to_numpy(zero_copy_only=False)
        bad = np.append(0, np.cumsum(~np.isfinite(flat)))
        raw = []
        for i, null in enumerate(lists.is_null().to_pylist()):
            begin, end = int(ends[i]), int(ends[i + 1])
            fine = not null and bad[end] == bad[begin] and flat[begin:end].any()
            raw.append((flat[begin:end] + flat.dtype.type(0)).tobytes() if fine else None)  # -0.0 is 0.0
        keys = [None if x is None else xxhash.xxh3_128_digest(x) for x in raw]
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "key", "vector"])


def scaled(raw: np.ndarray) -> np.ndarray:
    """Vectors in double precision, each times a power of two that keeps its squares in range."""
    return np.ldexp(raw.astype(np.float64), -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine of two vectors, with exactly rounded sums."""
    xx, yy, xy = (math.fsum((a * b).tolist()) for a, b in ((x, x), (y, y), (x, y)))
    return xy / math.sqrt(xx * yy)


class Shard:
    """A shard's vectors (nodes first), how often each occurs, its graph, and its balls: bounds and radius of each node's members."""

    def __init__(self, parts: dict[str, np.ndarray], least: float):
        self.uid, self.times, self.beam, self.least = parts["uid"], parts["times"], int(parts["beam"]), least
        self.exact = scaled(parts["raw"])
        self.unit = self.exact / np.linalg.norm(self.exact, axis=1, keepdims=True)
        layers = [parts[f"layer{i}"] for i in range(int(parts["layers"]))]
        self.n = len(layers[0]) if layers else 0
        self.graph = hnsw.Graph(self.unit[: self.n].astype(np.float32), layers)
        self.stray = parts["stray"]
        order = np.argsort(parts["holder"], kind="stable")
        self.members, self.first = order, np.searchsorted(parts["holder"][order], np.arange(self.n + 1))
        to_node = np.einsum("kd,kd->k", self.unit, self.unit[parts["holder"]])
        angle = np.where(np.arange(len(self.uid)) < self.n, 0, np.arccos(np.clip(to_node, -1, 1)))
        self.radius = np.zeros(self.n)
        np.maximum.at(self.radius, parts["holder"], angle)
        self.count = np.zeros(len(self.uid), np.int64)

    def ball(self, node: int) -> np.ndarray:
        return self.members[self.first[node] : self.first[node + 1]]


def _built(uid: np.ndarray, times: np.ndarray, keys: list[bytes], raw: np.ndarray, least: float) -> dict[str, np.ndarray]:
    """The arrays of a shard, with the beam at which its graph passes the audit of planted neighbours."""
    name = np.frombuffer(b"".join(k[:8] for k in keys), dtype="<u8")
    order = np.argsort(name, kind="stable")
    uid, times, raw, name = uid[order], times[order], raw[order], name[order]
    exact = scaled(raw)
    unit = (exact / np.linalg.norm(exact, axis=1, keepdims=True)).astype(np.float32)
    graph, nodes, holder = hnsw.build(unit, hnsw.levels(name), math.cos(math.acos(least) / 2) + ROUNDING)
    rest = np.setdiff1d(np.arange(len(uid)), nodes)
    order = np.concatenate([nodes, rest])
    # planted neighbours: nodes turned by the linking angle towards directions drawn from their keys
    some = np.arange(min(len(nodes), AUDIT))
    toward = (mix(np.add.outer(name[nodes[some]], np.arange(1, unit.shape[1] + 1, dtype=np.uint64))) >> np.uint64(11)).astype(np.float64) / (1 << 53) - 0.5
    own = graph.vectors[some]
    toward -= (toward * own).sum(axis=1, keepdims=True) * own
    toward /= np.maximum(np.linalg.norm(toward, axis=1, keepdims=True), 1e-12)
    planted, beam = (least * own + math.sqrt(1 - least * least) * toward).astype(np.float32), BEAM
    reached = lambda queries, ids, beam: (graph.search(queries, beam)[0] == ids[:, None]).any(axis=1)
    while beam < len(nodes) and reached(planted, some, beam).mean() < RECALL:
        beam *= 2
    # nodes that a search for themselves does not reach are compared with every query
    every = np.arange(len(nodes))
    stray = every[~reached(graph.vectors, every, beam)]
    parts = {"uid": uid[order], "times": times[order], "raw": raw[order], "holder": holder[order], "stray": stray, "beam": np.array(beam)}
    return parts | {"layers": np.array(len(graph.layers)), **{f"layer{i}": x.astype(np.int32) for i, x in enumerate(graph.layers)}}


def _build(least: float, kind: str):
    def run(rows: pa.Table) -> pa.Table:
        shard, width = rows.column("shard")[0].as_py(), rows.column("width")[0].as_py()
        raw = np.frombuffer(b"".join(rows.column("vector").to_pylist()), dtype=kind).reshape(rows.num_rows, -1)
        parts = _built(rows.column("uid").to_numpy(), rows.column("n").to_numpy(), rows.column("key").to_pylist(), raw, least)
        out = io.BytesIO()
        np.savez(out, **parts)
        data = out.getvalue()
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return pa.table(
            {
                "width": pa.array([width] * len(pieces), pa.int32()), "shard": pa.array([shard] * len(pieces), pa.int32()),
                "piece": pa.array(range(len(pieces)), pa.int32()), "data": pa.array(pieces, pa.binary()),
            }
        )

    return run


def _near_balls(q: Shard, g: Shard) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of q's balls and g's balls that may hold a link, each pair once, some queries at a time."""
    wide, queries, theta = g.radius.max(initial=0), q.graph.vectors, math.acos(g.least)
    bound = lambda extra: np.cos(np.minimum(theta + extra, math.pi)) - ROUNDING
    need = bound(q.radius + wide)

    def scan(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, node = np.nonzero(queries[rows] @ g.graph.vectors[nodes].T >= need[rows, None])
        return rows[at], nodes[node]

    def searched(rows: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs found, and the queries whose last result could still be linked."""
        ids, sims = g.graph.search(queries[rows], beam)
        at, place = np.nonzero(sims >= need[rows, None])
        more = scan(rows, g.stray)
        pairs = np.unique(np.stack([np.append(rows[at], more[0]), np.append(ids[at, place], more[1])]), axis=1)
        return pairs[0], pairs[1], sims[:, -1] >= need[rows]

    # brute force over some queries; the beam is doubled until all of their neighbours are found
    beam, every = g.beam, np.arange(g.n)
    audit = np.arange(min(q.n, AUDIT))
    true = set(zip(*map(np.ndarray.tolist, scan(audit, every)), strict=True))
    while true and beam * 2 < g.n:
        a, b, full = searched(audit, beam)
        if true <= set(zip(a.tolist(), b.tolist(), strict=True)) | {p for p in true if full[p[0]]}:
            break
        beam *= 2
    step = max(16, hnsw.MARKS // max(g.n, 1))
    for begin in range(0, q.n, step):
        left, wider = np.arange(begin, min(begin + step, q.n)), beam
        while len(left):
            if wider * 2 >= g.n:
                a, b, full = *scan(left, every), np.zeros(len(left), bool)
            else:
                a, b, full = searched(left, wider)
            done = ~np.isin(a, left[full])
            a, b = a[done], b[done]
            near = np.einsum("kd,kd->k", queries[a], g.graph.vectors[b]) >= bound(q.radius[a] + g.radius[b])
            yield a[near], b[near]
            left, wider = left[full], wider * 2


def _count(a: Shard, x: np.ndarray, b: Shard, y: np.ndarray, mutual: bool) -> bool:
    """Adds the links between a's vectors x and b's vectors y to the counts; whether there are any."""
    found = False
    step = max(1, 4_000_000 // max(len(y), 1))
    for begin in range(0, len(x), step):
        some = x[begin : begin + step]
        cos = a.unit[some] @ b.unit[y].T
        near = cos >= a.least
        for i, j in zip(*np.nonzero(np.abs(cos - a.least) < FINE), strict=True):
            near[i, j] = cosine(a.exact[some[i]], b.exact[y[j]]) >= a.least
        a.count[some] += near @ b.times[y]
        if mutual:
            b.count[y] += a.times[some] @ near
        found = found or bool(near.any())
    return found


def _decide(a: Shard, b: Shard, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Counts the links between the balls i of a and j of b; the pairs of balls that have some."""
    linked: list[tuple[int, int]] = []
    single = (a.first[i + 1] - a.first[i] == 1) & (b.first[j + 1] - b.first[j] == 1)
    x, y = i[single], j[single]
    for begin in range(0, len(x), 65_536):
        p, q = x[begin : begin + 65_536], y[begin : begin + 65_536]
        cos = np.einsum("kd,kd->k", a.unit[p], b.unit[q])
        near = cos >= a.least
        for k in np.flatnonzero(np.abs(cos - a.least) < FINE):
            near[k] = cosine(a.exact[p[k]], b.exact[q[k]]) >= a.least
        p, q = p[near], q[near]
        np.add.at(a.count, p, b.times[q])
        np.add.at(b.count, q, a.times[p])
        linked += zip(p.tolist(), q.tolist(), strict=True)
    theta = math.acos(a.least)
    for p, q in zip(i[~single].tolist(), j[~single].tolist(), strict=True):
        x, y = a.ball(p), b.ball(q)
        angle = np.arccos(np.clip(a.unit[x] @ b.unit[q], -1, 1))
        sure, open_ = angle + b.radius[q] <= theta - FINE, np.abs(angle - b.radius[q]) <= theta + FINE
        if sure.any():
            a.count[x[sure]] += b.times[y].sum()
            b.count[y] += a.times[x[sure]].sum()
        rest = x[open_ & ~sure]
        if bool(len(rest) and _count(a, rest, b, y, True)) or sure.any():
            linked.append((p, q))
    return linked


def _compare(least: float):
    """Of one or two shards: a row (a, null, n) for each vector a with n links, and rows (a, b, 0) that join all linked vectors."""

    def run(rows: pa.Table) -> pa.Table:
        held: dict[int, list] = {}
        for s, k, data in zip(*(rows.column(c).to_pylist() for c in ("shard", "piece", "data")), strict=True):
            held.setdefault(s, []).append((k, data))
        shards = [Shard(dict(np.load(io.BytesIO(b"".join(x for _, x in sorted(held[s]))))), least) for s in sorted(held)]
        a, b = shards[0], shards[-1]
        edges: list[tuple[int, int]] = []
        root: dict[tuple[int, int], tuple[int, int]] = {}

        def find(x: tuple[int, int]) -> tuple[int, int]:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        def join(i: np.ndarray, j: np.ndarray) -> None:
            for p, q in _decide(a, b, i, j):
                x, y = find((0, p)), find((0 if a is b else 1, q))
                if x != y:
                    root[x] = y
                    edges.append((int(a.uid[p]), int(b.uid[q])))

        if a is not b:
            met = np.zeros((a.n, b.n // 8 + 1), np.uint8)
            for i, j in _near_balls(a, b):
                np.bitwise_or.at(met, (i, j >> 3), (1 << (j & 7)).astype(np.uint8))
                join(i, j)
            for j, i in _near_balls(b, a):
                new = (met[i, j >> 3] >> (j & 7).astype(np.uint8)) & 1 == 0
                join(i[new], j[new])
        elif len(rows) and rows.column("l")[0].as_py() == rows.column("r")[0].as_py():
            met = np.zeros((a.n, a.n // 8 + 1), np.uint8)
            for i, j in _near_balls(a, a):
                i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
                new = (met[i, j >> 3] >> (j & 7).astype(np.uint8)) & 1 == 0
                i, j = np.unique(np.stack([i[new], j[new]]), axis=1)
                np.bitwise_or.at(met, (i, j >> 3), (1 << (j & 7)).astype(np.uint8))
                join(i, j)
            for node in np.flatnonzero(np.diff(a.first) > 1):
                x = a.ball(node)
                a.count[x] += a.times[x].sum() - a.times[x]
                edges += [(int(a.uid[node]), int(a.uid[m])) for m in x if m != node]
        n = [(int(s.uid[k]), None, int(s.count[k])) for s in {id(s): s for s in shards}.values() for k in np.flatnonzero(s.count)]
        out = [*n, *((x, y, 0) for x, y in edges)]
        return pa.table({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate(("a", "b", "n"))})

    return run


def links(vectors: DataFrame, least: float = COSINE, shards: int = SHARDS) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    n_links counts the other rows whose cosine is at least the given one, in double precision; component_id is the
    least vec_id that links lead to, the row's own included, and kept says whether it is the row's own. Vectors that
    are null, empty or zero, or hold a null or non-finite component, link with nothing, and vectors of different
    lengths do not link. Rows of equal vectors are linked, rows of equal ids are rows of their own. Null ids come last:
    a component of null ids alone has a null component_id, and a row with a null id is not kept. Other columns are not
    read; an empty table gives an empty result. Crowds of near copies cost their balls; only vectors that lie between
    the linking angle and half of it can cost a comparison for each pair, which is made inside tasks.
    """
    spark = vectors.sparkSession
    double = "double" in dict(vectors.dtypes)["embedding"]
    rows = cut(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if double else "array<float>").alias("embedding"))
        .mapInArrow(_read, "vec_id long, key binary, vector binary"),
        "vectors",
    )
    different = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    different = cut(different.withColumn("uid", F.monotonically_increasing_id()), "different-vectors")
    n, size = different.agg(F.count("*"), F.sum(F.length("vector"))).first()
    n_shards = max(shards, -(-n // SHARD_ROWS), -(-(size or 0) // SHARD_BYTES))
    kind, wide = ("<f8", 8) if double else ("<f4", 4)
    dealt = different.select(
        "uid", "key", "n", "vector", (F.length("vector") / wide).cast("int").alias("width"), F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int").alias("shard")
    )
    graphs = dealt.repartitionByRange(n_shards, "width", "shard").groupBy("width", "shard").applyInArrow(
        _build(least, kind), "width int, shard int, piece int, data binary"
    )
    graphs = cut(graphs, "graphs")
    pairs = graphs.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    pairs = pairs.select("width", F.least("shard", "other").alias("l"), F.greatest("shard", "other").alias("r"), "shard", "piece", "data")
    found = pairs.repartitionByRange(n_shards * (n_shards + 1) // 2, "width", "l", "r").groupBy("width", "l", "r").applyInArrow(
        _compare(least), "a long, b long, n long"
    )
    found = cut(found, "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b is not null").select("a", "b"))
    known = different.select("uid", "key", "least_id", "n")
    of = cut(known.join(roots.withColumnRenamed("key", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid")), "vector-roots")
    names = cut(of.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("m")), "vector-components")
    named = hot_join(of, names, ["root"], "m").join(counts, "uid", "left")
    named = cut(named.select("key", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "named-vectors")
    out = hot_join(rows.select("vec_id", "key"), named, ["key"], "n", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), fine AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM pairs GROUP BY a
)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON least.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
