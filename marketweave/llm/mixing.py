"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents, in a hashed order, form a stream of words; a source's target is the number of words to take
from the front of that stream, which starts again at its end (at most MAX_REPEATS times over). The words taken are cut
into blocks. A tree splits the exact block quotas of all sources among the output shards: at each node, the left half's
share of every source is drawn from the multivariate hypergeometric distribution, and the right half gets the rest. A
shard then owns a range of each source's permuted block numbers, so that shards are disjoint and together complete; the
permutation is a keyed swap-or-not shuffle, exact for any number of blocks. Inside a shard, blocks and documents are
ordered by a hash. All steps are DataFrame operations, and all draws come from hashes of the seed, so that reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, sized

#: Words of a block, and rows of a part of a source's stream, about; parts are what a task sorts.
BLOCK_WORDS, PART_ROWS = 4096, 10_000
#: Weights by the source's place in code point order, repeating, and how often a source may be repeated (fixed values).
WEIGHTS, MAX_REPEATS = (1, 2, 3), 3
#: Words that an output shard holds at most, about.
SHARD_WORDS = 50_000_000
#: Rounds of the permutation of block numbers.
ROUNDS = 64


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and \\x09-\\x0D; 0 for null."""
    # every word, with the white space around it, becomes one letter
    letters = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")
    return F.coalesce(F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.length(letters)), F.lit(0)).cast("long")


def sources(sizes: DataFrame, share: float = 1.0, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target: share of all sizes, dealt by weight, no source above repeats times its size.

    With the sources in order of repeats * size / weight, those at their limit are the first k, and all others get the
    rest in proportion to their weights: the result of resharing the excess until none is above. One row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * repeats
    order = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(every) * share - F.coalesce(F.sum(limit).over(before), F.lit(0))
    ) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the level that holds if all before this row are at their limits; the first row below its limit has the final one
    table = table.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= limit)
    final = F.coalesce(
        F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(
            Window.orderBy(
                limit / F.col("weight"),
                F.col("source").asc_nulls_last()
            ).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ),
        F.lit(float("inf"))
    )
    return table.withColumn("final", final).select(
        "source",
        "source_size",
        F.least(F.col("weight") * F.col("final"), limit.cast("double")).alias("target")
    )


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, exact to about 1e-9 (after a shift by 8)."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    for k in range(1, 9):
        series = series - F.log(n.cast("double") + k)
    return series


def _hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """Quantile u of the number of good ones among draws from total (by inversion, within 9 standard deviations)."""
    mean = draws * good / F.greatest(total, F.lit(1))
    deviation = F.sqrt(mean * (total - good) / F.greatest(total, F.lit(1)) * (total - draws) / F.greatest(total - 1, F.lit(1)))
    low = F.greatest(F.lit(0), draws + good - total, F.floor(mean - 9 * deviation) - 2).cast("long")
    high = F.least(good, draws, F.ceil(mean + 9 * deviation) + 2).cast("long")
    base = _log_factorial(good) + _log_factorial(total - good) + _log_factorial(draws) + _log_factorial(total - draws) - _log_factorial(total)
    chance = lambda k: F.exp(
        base - _log_factorial(k) - _log_factorial(good - k) - _log_factorial(draws - k) - _log_factorial(total - good - draws + k)
    )
    start = F.struct(F.lit(0.0).alias("sum"), low.alias("k"))
    return F.aggregate(
        F.sequence(low, high),
        start,
        lambda s, k: F.struct((s["sum"] + chance(k)).alias("sum"), F.when(s["sum"] <= u, k).otherwise(s["k"]).alias("k")),
        lambda s: F.least(s["k"], high)
    )


def split(table: DataFrame, shards: int, seed: int) -> DataFrame:
    """source and the array of its block quotas by shard, from the column blocks, by the splitting tree."""
    every = F.array_sort(
        F.collect_list(
            F.struct(
                F.coalesce("source", F.lit("")).alias("o"),
                F.col("source").isNull().alias("z"),
                F.col("source").alias("source"),
                F.col("blocks").cast("long").alias("q")
            )
        )
    )
    node = table.groupBy().agg(every.alias("quotas")).select(F.lit(0).alias("first"), F.lit(shards).alias("n"), "quotas")
    width = shards
    while width > 1:
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda s, x: s + x["q"])
        left_n = F.floor((F.col("n") + 1) / 2).cast("int")
        node = node.withColumn("total", total).withColumn("left_n", left_n).withColumn(
            "want",
            F.floor(F.col("total") * F.col("left_n") / F.col("n")).cast("long")
        )
        # one source after the other: its part of what is still wanted, given what is left
        start = F.struct(F.col("total").alias("rest"), F.col("want").alias("want"), F.array().cast("array<bigint>").alias("took"))

        def step(s: Column, x: Column) -> Column:
            took = F.when(s["rest"] <= 0, F.lit(0).cast("long")).otherwise(
                _hypergeometric(s["rest"], x["q"], s["want"], _unit(F.lit(seed), F.col("first"), F.col("n"), x["o"], x["z"]))
            )
            return F.struct((s["rest"] - x["q"]).alias("rest"), (s["want"] - took).alias("want"), F.concat(s["took"], F.array(took)).alias("took"))

        node = node.withColumn("left", F.when(F.col("n") > 1, F.aggregate("quotas", start, step, lambda s: s["took"])))
        own = F.when(
            F.col("n") > 1,
            F.array(
                F.struct(F.col("first").alias("first"), F.col("left_n").alias("n"), F.lit(True).alias("is_left")),
                F.struct((F.col("first") + F.col("left_n")).alias("first"), (F.col("n") - F.col("left_n")).alias("n"), F.lit(False).alias("is_left"))
            )
        ).otherwise(F.array(F.struct("first", "n", F.lit(None).cast("boolean").alias("is_left"))))
        node = node.withColumn("child", F.explode(own))
        part = lambda x, t: F.struct(
            x["o"].alias("o"),
            x["z"].alias("z"),
            x["source"].alias("source"),
            F.when(F.col("child.is_left").isNull(), x["q"]).when(F.col("child.is_left"), t).otherwise(x["q"] - t).alias("q")
        )
        node = node.select(
            "child.first",
            "child.n",
            F.zip_with("quotas", F.coalesce("left", F.transform("quotas", lambda x: x["q"])), part).alias("quotas")
        )
        node = cut(node, "split")
        width = (width + 1) // 2
    leaves = node.select("first", F.explode("quotas").alias("x"))
    return leaves.groupBy(F.col("x.source").alias("source")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "x.q"))), lambda x: x["q"]).alias("quotas")
    )


def permuted(block: Column, blocks: Column, key: Column) -> Column:
    """A permutation of 0 ... blocks - 1 that looks random: the swap-or-not shuffle of Hoang, Morris and Rogaway.

    In each round, a number and its mirror image around a keyed point change places or not, by a keyed bit of the pair.
    """

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r), blocks) - x, blocks)
        bit = F.xxhash64(key, r, F.greatest(x, mirror)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), block.cast("long"), swap)


def _lay(docs: DataFrame, share: float, weights: tuple[int, ...], repeats: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents of docs (with a uid) on their source's streams, and the table of sources.

    Documents: uid, doc_id, source, size, source_size, target, words, blocks, at: the place of the first word.
    """
    rows = docs.select("uid", "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("order"))
    measured = cut(rows, "sizes")
    # so many parts that each has about PART_ROWS rows even of a source that has all; a power of two of them, 256 at least
    bits = max(8, math.ceil(math.log2(max(1, measured.count() / PART_ROWS))))
    measured = measured.withColumn("part", F.shiftrightunsigned("order", 64 - bits))
    targets = sources(measured, share, weights, repeats).withColumn("words", F.round("target").cast("long"))
    targets = cut(targets.withColumn("blocks", F.ceil(F.col("words") / BLOCK_WORDS)), "targets")
    # where a part of a stream begins, then where a document begins in its part
    parts = measured.groupBy("source", "part").agg(F.sum("size").alias("part_words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.withColumn("begin", F.coalesce(F.sum("part_words").over(before), F.lit(0)))
    plan = begins.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    plan = cut(
        plan.select(F.col("source").alias("_source"), F.col("part").alias("_part"), "begin", "source_size", "target", "words", "blocks"),
        "stream-parts"
    )
    inner = Window.partitionBy("source", "part").orderBy("order", "uid").rowsBetween(Window.unboundedPreceding, -1)
    laid = measured.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = laid.join(sized(plan, 200_000), laid["source"].eqNullSafe(plan["_source"]) & (laid["part"] == plan["_part"]))
    placed = placed.withColumn("at", F.col("begin") + F.col("inner"))
    return placed.select("uid", "doc_id", "source", "size", "source_size", "target", "words", "blocks", "at"), targets


def _passes(repeats: int, of: Callable[[Column, Column, Column], Column]) -> Column:
    """Array of of(pass, low, high): the document's stretch of the repeated stream in each pass, up to the source's words."""

    def one(p: Column) -> Column:
        low = F.col("at") + p * F.col("source_size")
        return of(p, low, F.least(low + F.col("size"), F.col("words")))

    return F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), one)


def _dealt(laid: DataFrame, targets: DataFrame, repeats: int, seed: int, shards: int | None) -> DataFrame:
    """uid and segments of the documents that the mix takes: block by block, with the shard that gets each."""
    if shards is None:
        total = targets.agg(F.sum("words")).first()[0] or 0
        shards = 1 << max(4, math.ceil(math.log2(max(1, total / SHARD_WORDS))))
    quotas = split(targets.select("source", "blocks"), shards, seed).select("source", F.posexplode("quotas").alias("shard", "q"))
    # a shard's range of permuted numbers in each source, filed under the cells of `width` numbers that it touches
    order = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = quotas.withColumn("end", F.sum("q").over(order)).withColumn("begin", F.col("end") - F.col("q")).where("q > 0")
    ranges = ranges.join(targets.select(F.col("source").alias("_source"), "blocks"), F.col("source").eqNullSafe(F.col("_source")))
    width = lambda blocks: F.greatest(F.ceil(blocks / F.lit(shards)), F.lit(1))
    cells = F.explode(F.sequence(F.floor(F.col("begin") / width(F.col("blocks"))), F.floor((F.col("end") - 1) / width(F.col("blocks")))))
    ranges = cut(ranges.select("_source", "begin", "end", "shard", cells.alias("_cell")), "shard-ranges")

    def stretch(p: Column, low: Column, high: Column) -> Column:
        first, last = F.floor(low / BLOCK_WORDS).cast("long"), F.floor((high - 1) / BLOCK_WORDS).cast("long")
        numbers = F.when(high > low, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        begin, end = (lambda b: F.greatest(low, b * BLOCK_WORDS)), (lambda b: F.least(high, (b + 1) * BLOCK_WORDS))
        return F.transform(
            numbers,
            lambda b: F.struct(p.cast("int").alias("pass"), (begin(b) - low).alias("start"), (end(b) - begin(b)).alias("words"), b.alias("block"))
        )

    each = laid.select("uid", "source", "blocks", F.explode(F.flatten(_passes(repeats, stretch))).alias("s")).select("uid", "source", "blocks", "s.*")
    each = each.withColumn("to", permuted(F.col("block"), F.col("blocks"), F.xxhash64(F.lit(seed), "source")))
    each = each.withColumn("cell", F.floor(F.col("to") / width(F.col("blocks"))))
    on = each["source"].eqNullSafe(ranges["_source"]) & (
        each["cell"] == ranges["_cell"]
    ) & (each["to"] >= ranges["begin"]) & (each["to"] < ranges["end"])
    found = each.join(sized(ranges, 200_000), on)
    place = F.xxhash64(F.lit(seed), "block", "source", "uid").alias("place")
    return found.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pass", "start", "words", "shard", place))).alias("segments"))


def _numbered(docs: DataFrame, name: str, *columns: str) -> DataFrame:
    """The given columns of docs (all, if none is given) with a number for each row, as a table: rows keep their numbers."""
    return cut(docs.select(*columns, F.monotonically_increasing_id().alias("uid")), name)


def _mixed(numbered: DataFrame, share: float, weights: tuple[int, ...], repeats: int, seed: int, shards: int | None) -> DataFrame:
    laid, targets = _lay(numbered, share, weights, repeats, seed)
    laid = cut(laid, "laid")
    dealt = _dealt(laid, targets, repeats, seed, shards)
    taken = F.aggregate(_passes(repeats, lambda p, low, high: F.greatest(high - low, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    out = laid.withColumn("taken", taken).join(dealt.withColumnRenamed("uid", "_uid"), F.col("uid") == F.col("_uid"), "left")
    segments = F.coalesce("segments", F.array().cast(dealt.schema["segments"].dataType)).alias("segments")
    return out.select("uid", "doc_id", "source", "size", "source_size", "target", "taken", segments)


def mix(
    docs: DataFrame,
    share: float = 1.0,
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = MAX_REPEATS,
    seed: int = 0,
    shards: int | None = None
) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, segments.

    segments is an array of (pass, start, words, shard, place): the words taken of this document, block by block, the
    shard that gets them and the place in that shard's order; taken is the sum of their words. Null texts have size 0
    and take nothing; rows with a null source form a source of their own, the last one. Rows with equal doc_id and text
    are laid one after the other. A source's words are taken exactly, up to rounding its target to a whole number.
    The table of sources is sorted in one task: it has a row per source, not per document. Other columns are not read;
    an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("uid"))
    return _mixed(rows, share, weights, repeats, seed, shards).drop("uid")


def write_shards(
    docs: DataFrame,
    path: str,
    share: float = 1.0,
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = MAX_REPEATS,
    seed: int = 0,
    shards: int | None = None
) -> None:
    """Writes the mix as Parquet, a folder per shard, each in the shard's own order: doc_id, pass, start, words, text.

    A row of docs gives its own pieces, whatever other rows have its doc_id. A shard is sorted in one task: it has
    about SHARD_WORDS words, or those that shards asks for. Null and empty texts give nothing; an empty table writes no
    folder. docs is written once more with numbered rows, as a text must be found again.
    """
    numbered = _numbered(docs, "numbered", "doc_id", "source", "text")
    mixed = _mixed(numbered, share, weights, repeats, seed, shards).select(F.col("uid").alias("_uid"), "segments").where(F.size("segments") > 0)
    joined = numbered.join(mixed, F.col("uid") == F.col("_uid")).withColumn(
        "all_words",
        F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    )
    piece = lambda s: F.array_join(F.slice("all_words", s["start"].cast("int") + 1, s["words"].cast("int")), " ")
    pieces = F.transform(
        "segments",
        lambda s: F.struct(
            s["shard"].alias("shard"),
            s["place"].alias("place"),
            s["pass"].alias("pass"),
            s["start"].alias("start"),
            s["words"].alias("words"),
            piece(s).alias("text")
        )
    )
    cuts = joined.select("doc_id", pieces.alias("pieces")).select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*")
    cuts.repartition("shard").sortWithinPartitions("shard", "place", "pass", "start").write.partitionBy("shard").parquet(path)


def mixture(docs: DataFrame, share: float = 1.0, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, seed: int = 0) -> DataFrame:
    """The rows of docs that the mix takes, whole and with all their columns, once for each time they are taken.

    The tree deals each pass's words, block by block, as in mix. A pass takes a document whole if at least half of its
    words were dealt, into the shard that got the first of them, at that place. Only the document at the end of a source's
    words is dealt in part, so that a source's words come within half a document of its target. Rows come by shard, each
    shard in its own order. Repeated rows and rows of one doc_id are each counted for themselves. docs is written once more
    with numbered rows, so that each row is found again. Rows without words are not taken; an empty table gives an empty
    result.
    """
    numbered = cut(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("uid")), "numbered")
    rows = numbered.select("uid", *[F.col(f"row.{c}").alias(c) for c in ("doc_id", "source", "text")])
    laid, targets = _lay(rows, share, weights, repeats, seed)
    laid = cut(laid, "laid")
    dealt = _dealt(laid, targets, repeats, seed, None).withColumnRenamed("uid", "_uid")

    def whole(p: int) -> Column:
        pieces = F.filter("segments", lambda s: s["pass"] == p)
        words = F.aggregate(pieces, F.lit(0).cast("long"), lambda n, s: n + s["words"])
        return F.when((words > 0) & (words * 2 >= F.col("size")), F.struct(F.get(pieces, F.lit(0))["shard"].alias("shard"), F.get(pieces, F.lit(0))["place"].alias("place")))

    copies = F.array_compact(F.array(*[whole(p) for p in range(repeats)]))
    found = laid.select("uid", "size").join(dealt, F.col("uid") == F.col("_uid")).select("_uid", copies.alias("_copies")).where(F.size("_copies") > 0)
    taken = numbered.join(sized(cut(found, "copies"), 300_000), F.col("uid") == F.col("_uid")).withColumn("_copy", F.explode("_copies"))
    return taken.repartition("_copy.shard").sortWithinPartitions("_copy.shard", "_copy.place").select("row.*")
