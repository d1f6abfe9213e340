"""Near duplicates by ProbMinHash, banding and exact verification.

Each distinct text (its words, A-Z lower-cased) becomes a weighted set of five-word shingles. Every shingle sends a
Poisson process of arrivals at a rate of its weight; an arrival goes to a random register, and a register keeps the
shingle of its earliest arrival. A shingle stops as soon as its next arrival is later than the latest register. Two
texts agree in a register with the probability Jaccard similarity of their weighted sets, which for unit weights (the
default) is the Jaccard similarity of the sets. Bands of registers give candidates, which are verified on shingles.

Buckets never become all pairs. A bucket first gives, for each member, a pair with the bucket's most popular member
and one with a neighbour. Verified pairs are joined into components. Members of one component need no further look.
Where a bucket's members lie in different components, small buckets list these pairs (a bounded number for each
member). Members of large ones are put into buckets again, by their rarest shingles (prefixes, with an exact bound);
of these the small list pairs, and in large ones blocks of members are compared inside tasks, which give back only
links that join components. So each pair of texts that share a bucket is decided, by one way or another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, flat_words, hot_join, mix, sized, small_batches, windows

#: Words of a shingle and least similarity of near duplicates.
WORDS, SIMILARITY = 5, 0.8
#: What floating point may take from a weighted similarity: pairs at the threshold itself are links.
ROUNDING = 1e-9
#: What sums of shares may be off by; prefixes are longer by that.
SLACK = 1e-6
#: BANDS bands of ROWS registers: a pair at 0.8 is a candidate with probability 1 - (1 - 0.8**4)**24 = 0.999997.
BANDS, ROWS = 24, 4
#: Members of a part of a bucket, about, in which neighbours are looked for before the parts' first members meet, and
#: pairs that share one copy of a popular text's shingles.
PART, COPY_PAIRS = 256, 1024
#: Members of a bucket up to which its pairs are listed, and members of a block in larger ones.
SMALL, BLOCK = 32, 512
#: Keys of 16 bytes that are broadcast at most (32 MB); more are joined by shuffle.
MOST_BROADCAST = 1_000_000
#: Popular texts (a key and a number each) that are broadcast at most; there is one for COPY_PAIRS pairs at most.
MOST_POPULAR = 300_000
#: Bands, texts and shingles (a key and its counts each) that are broadcast whole at most; more are joined by hot_join.
MOST_NAMES = 300_000
#: Links that a task turns into stars together.
CHUNK = 500_000
#: A text is handled whole; batches are split so that about this many bytes are sketched, or cut into words, together.
_STEP, _WORD_STEP = 3_000_000, 250_000


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of many texts: hash and text number; those of short texts come last.

    Texts of fewer words than a shingle have one shingle of all their words; texts without a word have none.
    """
    hashes, _, owner, _ = flat_words(texts, lower=True)
    found, first = windows(hashes, owner, words)
    of = owner[first]
    n = np.bincount(owner, minlength=len(texts))
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        ends = np.cumsum(n)
        own = np.array(
            [
                mix(
                    np.array([sum(int(h) * (2 * j + 3) for j, h in enumerate(hashes[ends[i] - n[i] : ends[i]])) % (1 << 64)], dtype=np.uint64)
                )[0] for i in short
            ],
            dtype=np.uint64
        )
        found, of = np.concatenate([found, own]), np.concatenate([of, short])
    return found, of


def distinct(found: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles, by text and hash, and how often each occurs."""
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return found[at], of[at], np.diff(np.append(at, len(found)))


def weighed(found: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles and how often each occurs, in any order; few shingles occur again, and only these are grouped."""
    key = mix(found + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.sort(key)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(again):
        return found, of, np.ones(len(found))
    repeated = again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key
    f, o, n = distinct(found[repeated], of[repeated])
    once = ~repeated
    return np.concatenate([found[once], f]), np.concatenate([of[once], o]), np.concatenate([np.ones(once.sum()), n])


def signatures(found: np.ndarray, of: np.ndarray, weight: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """ProbMinHash registers (texts x registers) of weighted shingles; 0 where a text has no shingle."""
    times = np.full(n_texts * registers, np.inf)
    owner = np.zeros(n_texts * registers, dtype=np.uint64)
    element, text, rate, clock = found, of, weight.astype(np.float64), np.zeros(len(found))
    state = mix(found + np.uint64(0x632BE59BD9B4E019))
    latest = np.full(n_texts, np.inf)
    while len(element):
        # the next arrival of each shingle that is still running
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
        clock = clock - np.log1p(-(state >> np.uint64(11)).astype(np.float64) / (1 << 53)) / rate
        slot = text * registers + (mix(state ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(times, slot, clock)
        won = clock == times[slot]
        owner[slot[won]] = element[won]
        # only texts with running shingles can have changed
        running = np.flatnonzero(np.bincount(text, minlength=n_texts))
        latest[running] = times.reshape(n_texts, registers)[running].max(axis=1)
        on = clock < latest[text]
        element, text, rate, clock, state = element[on], text[on], rate[on], clock[on], state[on]
    return owner.reshape(n_texts, registers)


def _parts(texts: list[bytes], step: int = _STEP) -> Iterator[tuple[int, list[bytes]]]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= step:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def text_key(text: bytes) -> bytes:
    """128 bits that name the sequence of a text's words."""
    return xxhash.xxh3_128_digest(b" ".join(text.lower().split()))


def _sketch(bands: int, rows: int, words: int, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = np.array([mix(np.array([j * 2 + 1], dtype=np.uint64))[0] | np.uint64(1) for j in range(rows)], dtype=np.uint64)
        for batch in batches:
            ids, raw = (c.to_pylist() for c in batch.columns)
            for begin, texts in _parts([t or b"" for t in raw]):
                # a shingle that occurs again repeats its own arrivals, which changes no register
                every = [(f, o + at) for at, some in _parts(texts, _WORD_STEP) for f, o in [shingles(some, words)]]
                found, of = (np.concatenate(x) for x in zip(*every, strict=True))
                weight = np.ones(len(found))
                if counted:
                    found, of, weight = weighed(found, of)
                registers = signatures(found, of, weight, len(texts), bands * rows)
                keys = (mix(registers.reshape(len(texts), bands, rows)) * spread).sum(axis=2, dtype=np.uint64)
                keys = mix(keys + mix(np.arange(1, bands + 1, dtype=np.uint64))).view(np.int64)
                some = np.bincount(of, minlength=len(texts)) > 0
                lists = [k if s else [] for k, s in zip(keys.tolist(), some.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[begin : begin + len(texts)], pa.int64()),
                        pa.array([text_key(t) for t in texts], pa.binary()),
                        pa.array(lists, pa.list_(pa.int64()))
                    ],
                    names=["doc_id", "key", "bands"]
                )

    return run


def _shingle_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _parts([t or b"" for t in batch.columns[0].to_pylist()], _WORD_STEP):
                found, of, times = distinct(*shingles(texts, words))
                n = np.bincount(of, minlength=len(texts))
                sets = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(found.view(np.int64)))
                # texts without a repeated shingle have an empty list of times
                uneven = np.zeros(len(texts), dtype=bool)
                uneven[of[times > 1]] = True
                many = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(n * uneven)), pa.int32()),
                    pa.array(times[uneven[of]].astype(np.int32))
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([text_key(t) for t in texts], pa.binary()), sets, many],
                    names=["key", "shingles", "times"]
                )

    return run


def probability_jaccard(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray) -> float:
    """Sum over shared i of 1 / sum over j of max(p_j / p_i, q_j / q_i), for sorted elements x, y of weights p, q."""
    every = np.union1d(x, y)
    u, v = np.zeros(len(every)), np.zeros(len(every))
    u[np.searchsorted(every, x)], v[np.searchsorted(every, y)] = p, q
    both = np.flatnonzero((u > 0) & (v > 0))
    # with r_j = q_j / p_j in order, the maximum is the p part up to r_i and the q part above it
    ratio = np.divide(v, u, out=np.full(len(every), np.inf), where=u > 0)
    order = np.argsort(ratio)
    below, above = np.append(0, np.cumsum(u[order])), np.append(np.cumsum(v[order][::-1])[::-1], 0)
    at = np.searchsorted(ratio[order], ratio[both], side="right")
    return float((1 / (below[at] / u[both] + above[at] / v[both])).sum())


def _weighted_similarity(sa: pd.Series, ta: pd.Series, sb: pd.Series, tb: pd.Series) -> pd.Series:
    """The similarity of each pair with multiplicities (an empty list: all are 1); 0 where there are no arrays."""
    times = lambda s, t: np.asarray(t, dtype=float) if len(t) else np.ones(len(s))
    of = lambda x, p, y, q: 0.0 if x is None else probability_jaccard(x, times(x, p), y, times(y, q))
    return pd.Series([of(*pair) for pair in zip(sa, ta, sb, tb, strict=True)], dtype=float)


def _first_pairs(members: DataFrame) -> DataFrame:
    """(a, b) with a < b: each member of a bucket with the bucket's most popular one and with a neighbour.

    Popular are texts that share buckets with many others. members: band, key, popular, n (the bucket's members).
    """
    tops = cut(members.groupBy("band").agg(F.max(F.struct("popular", "key")).alias("top"), F.count("*").alias("n")), "tops")
    star = hot_join(members.drop("n"), tops, ["band"], "n", few=MOST_NAMES).select(F.col("top.key").alias("a"), F.col("key").alias("b"))
    # neighbours by popularity: inside parts of a bucket, and from part to part
    salted = members.withColumn("salt", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / PART)))
    order = [F.col("popular").desc(), F.col("key")]
    near = salted.select("band", "key", "n", "popular", F.lag("key").over(Window.partitionBy("band", "salt").orderBy(*order)).alias("before"))
    heads = near.where("before is null").withColumn("salt", F.pmod(F.xxhash64("key", F.lit(1)), F.ceil(F.col("n") / PART / PART)))
    heads = heads.select("key", F.lag("key").over(Window.partitionBy("band", "salt").orderBy(*order)).alias("before"))
    chain = near.select("before", "key").unionByName(heads.select("before", "key")).where("before is not null")
    pairs = star.unionByName(chain.select(F.col("before").alias("a"), F.col("key").alias("b"))).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sets_of(docs: DataFrame, keys: DataFrame, words: int, counted: bool) -> DataFrame:
    """key, shingles (and times) of the texts whose keys are given, a row for each text."""
    sets = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(
        _shingle_sets(words),
        "key binary, shingles array<long>, times array<int>"
    )
    if not counted:
        sets = sets.select("key", "shingles")
    if keys.count() <= MOST_BROADCAST:
        keys = F.broadcast(keys)
    return cut(sets.join(keys, "key", "left_semi").dropDuplicates(["key"]), "shingles")


def _dealt(pairs: DataFrame, texts: DataFrame, side: str, other: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """pairs and texts with a number of the copy of side's text that a pair meets, and the columns that join them."""
    many = pairs.groupBy(side).agg(F.ceil(F.count("*") / COPY_PAIRS).cast("int").alias("copies")).where("copies > 1")
    many = cut(many, "popular")
    n = many.limit(MOST_POPULAR + 1).count()
    if not n:
        return pairs, texts, [side]
    few, copies, copy = F.broadcast(many) if n <= MOST_POPULAR else many, F.coalesce("copies", F.lit(1)), f"copy_{side}"
    pairs = pairs.join(few, side, "left").withColumn(copy, F.pmod(F.xxhash64(other), copies).cast("int")).drop("copies")
    texts = texts.join(few, side, "left").withColumn(copy, F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    return pairs, texts, [side, copy]


def _verified(held: DataFrame, pairs: DataFrame, similarity: float, counted: bool) -> DataFrame:
    """The pairs whose shingle sets (or multisets, if counted) have at least the given similarity."""
    columns = lambda x: [F.col("key").alias(x), *[F.col(c).alias(f"{c[0]}{x}") for c in held.columns if c != "key"]]
    left, right = held.select(*columns("a")), held.select(*columns("b"))
    # a popular text stands in very many pairs, on either side: its shingles are shipped once for each COPY_PAIRS of them
    pairs, left, on_a = _dealt(pairs, left, "a", "b")
    pairs, right, on_b = _dealt(pairs, right, "b", "a")
    both = pairs.join(left, on_a).join(right, on_b)
    shared = F.size(F.array_intersect("sa", "sb"))
    near = shared >= similarity * (F.size("sa") + F.size("sb") - shared)
    if counted:
        # where no shingle of either text occurs again, the weighted similarity is that of the sets, and Python sees no array
        uneven = (F.size("ta") > 0) | (F.size("tb") > 0)
        weighted = F.pandas_udf(_weighted_similarity, "double")(*[F.when(uneven, F.col(c)) for c in ("sa", "ta", "sb", "tb")])
        near = F.when(uneven, weighted >= similarity - ROUNDING).otherwise(near)
    return both.where(near).select("a", "b")


def _contracted(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """key, root for each key of the batches' links (a, b): root is the least key that these links lead to."""
    both = pa.concat_arrays([b.column(k) for k in (0, 1) for b in batches]).dictionary_encode()
    order = pc.array_sort_indices(both.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = root = np.arange(len(order))
    u, v = np.split(rank[both.indices.to_numpy()], 2)
    while len(u):
        # the greater root of a link's ends is hung below the lesser one, then all paths are flattened
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root = up
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    keys = both.dictionary.take(order)
    return pa.RecordBatch.from_arrays([keys, keys.take(pa.array(root))], names=["key", "root"])


def _forests(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield _contracted(held)
                held, n = [], 0
        if n:
            yield _contracted(held)

    return run


def components(links: DataFrame) -> DataFrame:
    """(key, root) for each key in links (a, b): root is the least key of the component.

    Each task turns CHUNK of its links at a time into stars: a root for each key. A key then has at most a root for
    each chunk, so no group is large, however many links a key has. Roots that share a key are linked, and these
    links, between fewer and fewer keys, are treated likewise until each key has one root. The greatest key is never a
    root, so this ends; graphs that fit a chunk end there.
    """
    kind = links.schema["a"].dataType.simpleString()
    stars = links.where("a <> b").select("a", "b").mapInArrow(_forests(CHUNK), f"key {kind}, root {kind}")
    roots = stars.groupBy("key").agg(F.collect_set("root").alias("roots"))
    roots = cut(roots.select("key", F.array_min("roots").alias("root"), F.when(F.size("roots") > 1, F.col("roots")).alias("roots")), "stars")
    again = cut(roots.select(F.col("root").alias("a"), F.explode("roots").alias("b")).where("a <> b"), "root-links")
    roots = roots.drop("roots")
    if again.limit(1).count() == 0:
        return roots
    above = components(again).where("key <> root").select(F.col("key").alias("root"), F.col("root").alias("top"))
    if above.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        named = roots.join(F.broadcast(above), "root", "left")
    else:
        above = cut(above.join(roots.groupBy("root").agg(F.count("*").alias("n")), "root"), "roots-above")
        named = hot_join(roots, above, ["root"], "n", "left")
    return cut(named.select("key", F.coalesce("top", "root").alias("root")), "components")


def _open_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """band, key, root, n, most, largest: members of the buckets whose members lie in several components."""
    labelled = members.select("band", "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    parts = labelled.groupBy("band", "root").agg(F.count("*").alias("m"))
    bands = parts.groupBy("band").agg(
        F.count("*").alias("parts"),
        F.sum("m").alias("n"),
        F.max(F.struct(F.col("m").alias("m"), F.col("root").alias("r"))).alias("top")
    ).where("parts > 1")
    bands = cut(bands.select("band", "n", F.col("top.m").alias("most"), F.col("top.r").alias("largest")), "open-bands")
    return cut(hot_join(labelled, bands, ["band"], "n", few=MOST_NAMES), "open-buckets")


def _small(inside: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs of different components in buckets of at most SMALL members, without those tested: under SMALL for each member."""
    few = inside.where(F.col("n") <= SMALL)
    left = few.select(F.col("band").alias("lband"), F.col("key").alias("lkey"), F.col("root").alias("lroot"))
    pairs = few.join(left, (F.col("band") == F.col("lband")) & (F.col("root") < F.col("lroot")))
    pairs = pairs.select(F.least("key", "lkey").alias("a"), F.greatest("key", "lkey").alias("b")).distinct()
    return pairs.join(tested, ["a", "b"], "left_anti")


def _prefixes(inside: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """band, key: members of large buckets by the shingles (as bands) of which any two near duplicates share one.

    Shares of a text's weights sum to 1, and the sum over common shingles of the lesser share bounds the similarity from
    above. With shingles from the rarest to the commonest, a text's prefix ends where what follows weighs less than the
    similarity; two texts whose prefixes have nothing in common share less than that. Texts that only have a common
    line or passage between them meet no more, unless it makes up most of either.
    """
    some = held.join(sized(cut(inside.where(F.col("n") > SMALL).select("key").distinct(), "crowd")), "key", "left_semi")
    ones = F.array_repeat(F.lit(1), F.size("shingles"))
    times = F.when(F.size("times") > 0, F.col("times")).otherwise(ones) if "times" in held.columns else ones
    total = F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x)
    each = some.select("key", F.col("shingles").alias("band"), times.alias("times")).withColumn("total", total)
    each = each.select("key", "total", F.explode(F.arrays_zip("band", "times")).alias("x"))
    each = cut(each.select("key", "x.band", (F.col("x.times") / F.col("total")).alias("share")), "shares")
    # a shingle of one text only comes first in its order and meets nothing
    shared = cut(each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "frequencies")
    commonest = Window.partitionBy("key").orderBy(F.desc("n"), F.desc("band")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = hot_join(each, shared, ["band"], "n", few=MOST_NAMES).withColumn("rest", F.sum("share").over(commonest))
    return cut(rest.where(F.col("rest") >= similarity - SLACK).select("band", "key"), "prefixes")


def _compare(similarity: float, counted: bool):
    """Links between a group's rows of side 0 and its rows of side 1, one for each row and component that it meets."""

    def run(rows: pa.Table) -> pa.Table:
        side, keys, roots = (rows.column(c).to_pylist() for c in ("side", "key", "root"))
        sets = rows.column("shingles").to_numpy(zero_copy_only=False)
        times = rows.column("times").to_numpy(zero_copy_only=False) if counted else None
        left, right = ([i for i, x in enumerate(side) if x == k] for k in (0, 1))
        a, b = [], []
        if left and right:
            size = np.array([len(sets[i]) for i in right])
            names, ids = np.unique(np.concatenate([sets[i] for i in right]), return_inverse=True)
            starts, mark = np.cumsum(size) - size, np.zeros(len(names))
            of = lambda i: times[i] if counted and len(times[i]) else np.ones(len(sets[i]))
            even = np.array([not counted or not len(times[i]) for i in right])
            share = None if even.all() and all(
                not counted or not len(times[i]) for i in left
            ) else np.concatenate([of(i) / of(i).sum() for i in right])
            for i in left:
                at = np.minimum(np.searchsorted(names, sets[i]), len(names) - 1)
                both = names[at] == sets[i]
                mark[at[both]] = 1
                shared = np.add.reduceat(mark[ids], starts)
                # where no shingle of either text occurs again, the weighted similarity is that of the sets
                plain = even if not counted or not len(times[i]) else np.zeros(len(right), dtype=bool)
                near = np.flatnonzero(plain & (shared >= similarity * (len(sets[i]) + size - shared)))
                if (~plain & (shared > 0)).any():
                    # the common mass m bounds the similarity from above, and m / (2 - m) bounds it from below
                    mark[at[both]] = (of(i) / of(i).sum())[both]
                    mass = np.add.reduceat(np.minimum(mark[ids], share), starts)
                    sure = ~plain & (mass / (2 - mass) >= similarity)
                    open_ = np.flatnonzero(~plain & ~sure & (mass >= similarity - ROUNDING))
                    exact = [k for k in open_ if probability_jaccard(sets[i], of(i), sets[right[k]], of(right[k])) >= similarity - ROUNDING]
                    near = np.concatenate([near, np.flatnonzero(sure), np.array(exact, dtype=np.int64)])
                mark[at[both]] = 0
                for root, j in {roots[right[k]]: right[k] for k in near}.items():
                    if root != roots[i]:
                        a.append(min(keys[i], keys[j]))
                        b.append(max(keys[i], keys[j]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _large(inside: DataFrame, held: DataFrame, similarity: float, counted: bool) -> DataFrame:
    """Links between different components in buckets of more than SMALL members.

    What lies outside a bucket's largest component is compared with all its members, block against block: tasks get two
    blocks of about BLOCK members each, and give back no pairs but the links that join components.
    """
    many, sets = inside.where(F.col("n") > SMALL).join(held, "key"), [c for c in held.columns if c != "key"]
    rows_of = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    outside, every = rows_of(F.col("n") - F.col("most")), rows_of(F.col("n"))
    part = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    left = many.where("root <> largest").select(
        "band",
        part(outside).alias("l"),
        F.explode(F.sequence(F.lit(0), every - 1)).alias("r"),
        F.lit(0).alias("side"),
        "key",
        "root",
        *sets
    )
    right = many.select(
        "band",
        F.explode(F.sequence(F.lit(0), outside - 1)).alias("l"),
        part(every).alias("r"),
        F.lit(1).alias("side"),
        "key",
        "root",
        *sets
    )
    return left.unionByName(right).groupBy("band", "l", "r").applyInArrow(_compare(similarity, counted), "a binary, b binary").distinct()


def _classes(
    docs: DataFrame,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    counted: bool = False
) -> DataFrame:
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sketched = cut(
        docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
            _sketch(bands, rows, words, counted),
            "doc_id long, key binary, bands array<long>"
        ).withColumn("uid", F.monotonically_increasing_id()),
        "sketches"
    )
    # equal texts have equal bands, so copies go while a text is still one row
    texts = sketched.select("key", "bands").dropDuplicates(["key"])
    members = cut(texts.select("key", F.explode(F.array_distinct("bands")).alias("band")), "bands")
    shared = cut(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = cut(hot_join(members, shared, ["band"], "n", few=MOST_NAMES), "buckets")
    popular = members.groupBy("key").agg(F.sum("n").alias("popular"))
    members = cut(members.join(popular, "key"), "members")
    pairs = cut(_first_pairs(members), "pairs")
    held = _sets_of(docs, popular.select("key"), words, counted)
    links = cut(_verified(held, pairs, similarity, counted), "links")
    roots = components(links)
    inside = _open_buckets(members, roots)
    open_pairs = _small(inside, pairs)
    finer = None
    if inside.where(F.col("n") > SMALL).limit(1).count():
        # members of large buckets meet again by shingles that a link between them can't do without
        finer = _open_buckets(_prefixes(inside, held, similarity), roots)
        open_pairs = open_pairs.unionByName(_small(finer, pairs)).distinct()
    more = _verified(held, cut(open_pairs, "pairs"), similarity, counted)
    if finer is not None and finer.where(F.col("n") > SMALL).limit(1).count():
        more = more.unionByName(_large(finer, held, similarity, counted))
    more = cut(more, "links")
    if more.limit(1).count():
        # the roots so far stand for the links that gave them
        roots = components(roots.select(F.col("key").alias("a"), F.col("root").alias("b")).unionByName(more))
    copies = roots.join(sketched.groupBy("key").agg(F.count("*").alias("n")), "key")
    owned = hot_join(sketched.select("doc_id", "key", "uid"), cut(copies, "copies"), ["key"], "n", "left")
    owned = cut(owned.select("doc_id", "uid", "key", F.coalesce("root", "key").alias("root")), "owned")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("o"), F.col("uid").alias("u"), F.col("doc_id").alias("d")))
    texts = owned.groupBy("root", "key").agg(first.alias("top"), F.count("*").alias("n")).groupBy("root").agg(
        F.min("top").alias("top"),
        F.sum("n").alias("class_size"),
        F.count("*").alias("n_texts")
    )
    named = cut(texts.select("root", F.col("top.d").alias("class_id"), F.col("top.u").alias("keep_uid"), "class_size", "n_texts"), "classes")
    out = hot_join(owned, named, ["root"], "class_size")
    return out.select("doc_id", "key", "class_id", "class_size", "n_texts", (F.col("uid") == F.col("keep_uid")).alias("kept"))


def classes(
    docs: DataFrame,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    counted: bool = False
) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size, n_texts, kept.

    Texts are in one class when a chain of links joins them; a link is a similarity of at least the given one. Texts
    with equal words are always in one class, as are null, empty and blank texts. class_id is the least doc_id of the
    class, whose row is the one kept (null ids rank last; of rows with equal id one stays); n_texts counts the class's
    different texts. counted weighs shingles by their multiplicity and verifies the probability Jaccard similarity;
    otherwise weights are 1. Other columns are not read; an empty table gives an empty result.
    """
    return _classes(docs, words, similarity, bands, rows, counted).drop("key")


def _key_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: text_key((t or "").encode()))


def drop_near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    counted: bool = False
) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each class; see classes."""
    small_batches(docs.sparkSession)
    found = cut(_classes(docs, words, similarity, bands, rows, counted), "near-dedup")
    # ids of which a row goes; where several rows have one id, their words tell which of them stays
    lost = cut(
        found.groupBy(F.col("doc_id").alias("_id")).agg(F.max("kept").alias("_stay"), F.min("kept").alias("_all")).where("not _all").drop("_all"),
        "lost"
    )
    marked = docs.join(sized(lost), docs["doc_id"].eqNullSafe(F.col("_id")), "left")
    stay = cut(
        found.where("kept").join(sized(lost.where("_stay")), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(
            F.col("doc_id").alias("_kept"),
            F.col("key").alias("_kept_key"),
            F.lit(True).alias("_found")
        ),
        "stay"
    )
    all_stay = marked.where("_stay is null").select(*docs.columns)
    if stay.limit(1).count() == 0:
        return all_stay
    some = marked.where("_stay").withColumn("_key", F.pandas_udf(_key_of, "binary")("text"))
    some = some.join(sized(stay), F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_key") == F.col("_kept_key"))).dropDuplicates(["_id", "_key"])
    return all_stay.unionByName(some.select(*docs.columns))
