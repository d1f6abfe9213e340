"""Ranked search of many items at once by shared subexpressions.

A document's score for an item is a sum over the item's terms, and items share terms. Terms that are in the same items
become one class; then pairs of classes, and of pairs, that stand together in several items are mined, most frequent
first, until no pair is shared. Each is a node of a graph whose sinks are the items. For a block of documents the classes
are accumulated once, then each node of the graph is one addition of two rows, level by level, whoever shares it.

Documents are cut into terms once for each block of items, which leaves the occurrences of the block's terms only. A
task keeps the best documents of each item as it goes, and two windows choose among the tasks' best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, cut, flat_words, small_batches

#: Documents of an item that are returned.
TOP = 50
#: Terms of the items of a block, about: its vocabulary and its graph are held by each task.
BLOCK_TERMS = 131_072
#: Later units of an item that a unit is paired with while shared pairs are mined.
REACH = 64
#: Numbers of the accumulators that a task holds at a time, and bytes of text that are cut into terms together.
CELLS, STEP = 2_000_000, 2_000_000
#: Parts in which the tasks' best documents of an item meet first.
PARTS = 32
#: Bytes of terms stand for themselves, A-Z lower-cased; all others are spaces.
_TERM = np.full(256, 32, np.uint8)
for _part in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _TERM[_part] = LOWER[_part]
_TERM_BYTES = _TERM.tobytes()


class Plan(NamedTuple):
    """kind: each term's class; classes: how many there are; left, right: of the nodes after them; ends: the bounds of levels; roots: of the items."""

    kind: np.ndarray
    classes: int
    left: np.ndarray
    right: np.ndarray
    ends: list[int]
    roots: np.ndarray


def _shared_pairs(items: list[np.ndarray], n: int) -> list[tuple[int, int]]:
    """Pairs of units that at least two items hold, those of half the largest count or more, no unit twice."""
    keys = [np.concatenate([i[:-k] * n + i[k:] for k in range(1, min(len(i), REACH + 1))]) for i in items if len(i) > 1]
    found, count = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    often = count >= max(2, count.max(initial=0) // 2)
    used, out = set(), []
    for key in found[often][np.lexsort((found[often], -count[often]))].tolist():
        pair = divmod(key, n)
        if not used & set(pair):
            used |= set(pair)
            out.append(pair)
    return out


def share(terms: np.ndarray, items: np.ndarray, n_terms: int, n_items: int) -> Plan:
    """The graph for items that hold terms: pairs of a term and an item, each once, both numbered from 0; each item holds a term."""
    # terms of the same items are one class, named by a sum of its items' random numbers
    name = np.zeros(n_terms, np.uint64)
    np.add.at(name, terms, np.random.default_rng(7).integers(0, 1 << 63, n_items, dtype=np.uint64)[items])
    kind = np.unique(name, return_inverse=True)[1]
    pairs = np.unique(np.stack([items, kind[terms]]), axis=1)
    popular = np.bincount(pairs[1])
    order = np.lexsort((pairs[1], -popular[pairs[1]], pairs[0]))
    units = np.split(pairs[1][order], np.searchsorted(pairs[0], np.arange(1, n_items)))
    classes = int(kind.max(initial=-1)) + 1
    nodes: dict[tuple[int, int], int] = {}
    node = lambda a, b: nodes.setdefault((min(a, b), max(a, b)), classes + len(nodes))
    while pairs_ := _shared_pairs(units, classes + len(nodes)):
        n = classes + len(nodes)
        partner = np.full(n, -1)
        into = np.full(n, -1)
        for a, b in pairs_:
            partner[a], partner[b] = b, a
            into[a] = into[b] = node(a, b)
        for k, own in enumerate(units):
            both = np.isin(partner[own], own)
            if both.any():
                # the node takes the place of the first of the two
                new = np.where(both, into[own], own)
                units[k] = new[np.sort(np.unique(new, return_index=True)[1])]
    roots = []
    for own in units:
        rest = own.tolist()
        while len(rest) > 1:
            rest = [node(*rest[i : i + 2]) if i + 1 < len(rest) else rest[i] for i in range(0, len(rest), 2)]
        roots.append(rest[0])
    # children come before their nodes; nodes are renumbered level by level
    level = np.zeros(classes + len(nodes), np.int64)
    for (a, b), k in nodes.items():
        level[k] = max(level[a], level[b]) + 1
    order = np.argsort(level, kind="stable")
    number = np.empty_like(order)
    number[order] = np.arange(len(order))
    ends = np.cumsum(np.bincount(level)).tolist()
    both = np.array(list(nodes), np.int64).reshape(-1, 2)[order[classes:] - classes]
    return Plan(kind, classes, number[both[:, 0]], number[both[:, 1]], ends, number[np.array(roots, np.int64)])


def accumulate(plan: Plan, term: np.ndarray, doc: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores of all items (rows) for all documents (columns), from the values of terms in documents."""
    sums = np.zeros((plan.classes + len(plan.left), n_docs), np.int64)
    np.add.at(sums, (plan.kind[term], doc), value)
    for begin, end in zip(plan.ends, plan.ends[1:], strict=False):
        some = slice(begin - plan.classes, end - plan.classes)
        np.add(sums[plan.left[some]], sums[plan.right[some]], out=sums[begin:end])
    return sums[plan.roots]


def _terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all terms, and their texts' numbers."""
    hashes, _, owner, _ = flat_words([t.translate(_TERM_BYTES) for t in texts], lower=False)
    return hashes, owner


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uid, texts = (c.to_pylist() for c in batch.columns)
        hashes, owner = _terms([t or b"" for t in texts])
        pairs = np.unique(np.stack([owner.astype(np.int64), hashes.view(np.int64)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(uid, np.int64)[pairs[0]]), pa.array(pairs[1])], names=["uid", "term"])


def _occurrences(vocabulary: np.ndarray):
    """Of each document: its terms, and the numbers of those of the vocabulary (sorted hashes) with their occurrences."""
    mark = np.zeros(1 << 20, bool)
    mark[(vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.columns[0], batch.columns[1].to_pylist()
            begin = size = 0
            for i, t in enumerate(raw):
                size += len(t or b"")
                if size < STEP and i + 1 < len(raw):
                    continue
                texts = [x or b"" for x in raw[begin : i + 1]]
                hashes, owner = _terms(texts)
                n = np.bincount(owner, minlength=len(texts))
                likely = mark[(hashes >> np.uint64(44)).astype(np.int64)]
                hashes, owner = hashes[likely], owner[likely].astype(np.int64)
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                hit = vocabulary[at] == hashes
                key, tf = np.unique(owner[hit] * len(vocabulary) + at[hit], return_counts=True)
                of, term = np.divmod(key, len(vocabulary))
                ends = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=len(texts)))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[begin : i + 1], pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64))),
                    ],
                    names=["doc_id", "n", "terms", "tf"],
                )
                begin, size = i + 1, 0

    return run


def _best(item: np.ndarray, score: np.ndarray, null: np.ndarray, doc: np.ndarray, top: int) -> np.ndarray:
    """Positions of each item's best rows, in order: higher scores, then lower ids, null ids last."""
    order = np.lexsort((doc, null, -score, item))
    first = np.searchsorted(item[order], item[order], side="left")
    return order[np.arange(len(order)) - first < top]


def _kept(held: list[np.ndarray], top: int) -> list[np.ndarray]:
    best = _best(*held, top)
    return [x[best] for x in held]


def _score(plan: Plan, weight: np.ndarray, n_docs: int, n_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64)]  # item, score, null id, id
        least = np.ones(len(plan.roots), np.int64)
        step = max(1, CELLS // (plan.classes + len(plan.left)))
        for batch in batches:
            ids, n, terms, tfs = batch.columns
            null = np.array(ids.is_null())
            doc_id, n, ends = ids.fill_null(0).to_numpy(), n.to_numpy(), np.asarray(terms.offsets)
            base = ends[0]
            term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
            doc = np.repeat(np.arange(len(n)), np.diff(ends))
            m = 50 + (50 * n[doc] * n_docs) // n_terms
            value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            for begin in range(0, len(n), step):
                end = min(begin + step, len(n))
                part = slice(ends[begin] - base, ends[end] - base)
                scores = accumulate(plan, term[part], doc[part] - begin, value[part], end - begin)
                item, at = np.nonzero(scores >= least[:, None])
                held = [np.append(x, y) for x, y in zip(held, (item, scores[item, at], null[begin + at], doc_id[begin + at]), strict=True)]
                if len(held[0]) > 4 * top * len(plan.roots):
                    held = _kept(held, top)
                    count = np.bincount(held[0], minlength=len(least))
                    full = np.flatnonzero(count == top)
                    least[full] = held[1][np.cumsum(count)[full] - 1]
        item, score, null, doc_id = _kept(held, top)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(doc_id, pa.int64(), mask=null), pa.array(score)], names=["item", "doc_id", "score"]
        )

    return run


def _in_order(*by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))


def _block(docs: DataFrame, pairs: DataFrame, total: tuple[int, int] | None, top: int) -> tuple[DataFrame, tuple[int, int]]:
    """uid, rank, doc_id, score of one block's items, and the corpus's numbers of documents with terms and of terms."""
    held = pairs.toPandas()  # at most about BLOCK_TERMS rows, or one item
    vocabulary = np.unique(held["term"].to_numpy().view(np.uint64))
    uids, item = np.unique(held["uid"].to_numpy(), return_inverse=True)
    term = np.searchsorted(vocabulary, held["term"].to_numpy().view(np.uint64))
    plan = share(term, item, len(vocabulary), len(uids))
    found = cut(docs.mapInArrow(_occurrences(vocabulary), "doc_id long, n long, terms array<int>, tf array<long>"), "occurrences")
    if total is None:
        total = found.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for t, n in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row for each of the block's terms
        df[t] = n
    weight = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    best = found.where(F.size("terms") > 0).mapInArrow(_score(plan, weight, *total, top), "item long, doc_id long, score long")
    parted = best.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).withColumn("rank", _in_order("item", "part")).where(F.col("rank") <= top)
    ranked = parted.withColumn("rank", _in_order("item")).where(F.col("rank") <= top)
    names = docs.sparkSession.createDataFrame([(k, int(u)) for k, u in enumerate(uids)], "item long, uid long")
    return ranked.join(names, "item").select("uid", "rank", "doc_id", "score"), tuple(total)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """One row for each of the `top` best documents of each row of items: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters and digits and of all other code points beyond ASCII, A-Z lower-cased, in whole
    texts; a term counts once in an item. Documents with a score above 0 are ranked from 1, equal scores by ascending
    doc_id, null ids last. Null and empty texts have no terms: such documents count for nothing and such items have no
    rows. Each row of items is an item of its own, also where ids repeat, and so is each document. Empty tables give an
    empty result; other columns are not read. Items beyond block_terms terms are taken in blocks, each of which reads
    the documents once; an item of more terms than that is whole, in a block of its own size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = cut(items.select(F.monotonically_increasing_id().alias("uid"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")), "items")
    terms = cut(items.select("uid", "text").mapInArrow(_item_terms, "uid long, term long"), "item-terms")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    blocks = -(-terms.count() // block_terms)
    out, total = None, None
    for k in range(blocks):
        some = terms.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == k)
        if blocks > 1 and some.limit(1).count() == 0:
            continue
        ranked, total = _block(docs, some, total, top)
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out.join(items.select("uid", "item_id"), "uid").select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (
  SELECT doc_id, {_TERMS} AS terms FROM documents
), words AS (
  SELECT doc_id, unnest(terms) AS term FROM d
), counts AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), total AS (
  SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0
), wanted AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), weights AS (
  SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, total GROUP BY term, n
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(terms) * n) // l))))::BIGINT AS score
  FROM wanted JOIN counts USING (term) JOIN weights USING (term) JOIN d USING (doc_id), total GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""
