"""Dealing of blocks, shards on disk and whole-document mixtures against plain counting."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marketweave.llm import mixing

DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 37, 64, 1000, 4096])
def test_block_numbers_are_permuted(spark, n):
    rows = spark.range(n).select(
        "id",
        mixing.permuted(F.col("id"), F.lit(n), F.lit(11).cast("long")).alias("to"),
        mixing.permuted(F.col("id"), F.lit(n), F.lit(12).cast("long")).alias("other")
    ).orderBy("id").collect()
    to = [r.to for r in rows]
    assert sorted(to) == list(range(n)) == sorted(r.other for r in rows)
    if n >= 37:
        steps = Counter((b - a) % n for a, b in zip(to, to[1:], strict=False))
        assert steps.most_common(1)[0][1] < 0.15 * n + 4  # neither a rotation nor a reversal
        assert to != [r.other for r in rows]
        # neighbours part: of 16 shards that own ranges, few neighbours share one
        same = sum(a * 16 // n == b * 16 // n for a, b in zip(to, to[1:], strict=False))
        assert same < 0.2 * n + 4


def rows_of(k):
    return [
        (
            i % 7 if i % 5 else None,
            " ".join(f"w{i}_{j}" for j in range(i % 40)) if i % 11 else None,
            f"s{i % 3}" if i % 13 else None
        ) for i in range(k)
    ]


@pytest.mark.parametrize("shards", [None, 3, 1000])
def test_shards_hold_each_piece_once(spark, tmp_path, monkeypatch, shards):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 16)
    rows = rows_of(300) + [(1, "same text under one id", "s1")] * 9  # repeated ids and repeated rows
    docs = spark.createDataFrame(rows, DOCS).withColumn("uid", F.lit(3)).withColumn("shard", F.lit(1))
    path = str(tmp_path / "out")
    mixing.write_shards(docs, path, shards=shards)
    mixed = mixing.mix(docs, shards=shards).collect()
    want = Counter((r.doc_id, s["pass"], s.start, s.words, s.shard) for r in mixed for s in r.segments)
    got = spark.read.parquet(path).collect()
    assert Counter((r.doc_id, r["pass"], r.start, r.words, r.shard) for r in got) == want
    assert all(len(r.text.split()) == r.words for r in got)
    # each word of a text comes as often as passes take it, and no more than three times
    times = Counter(w for r in got for w in r.text.split() if "_" in w)
    assert times and max(times.values()) <= 3
    assert sum(r.words for r in got) == sum(r.taken for r in mixed)
    targets = {r.source: r.target for r in mixed}
    taken = defaultdict(int)
    for r in mixed:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 0.5 for s, t in targets.items())
    per_shard = Counter()
    for r in got:
        per_shard[r.shard] += r.words
    assert len(per_shard) <= (shards or 16)


def test_mixture_gives_exact_copies(spark):
    rows = [(1, "a b c d e f", "s")] * 3 + [
        (i, " ".join(f"w{j}" for j in range(6)), f"t{i % 2}") for i in range(10, 60)
    ] + [(None, None, None), (5, "", "s")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("uid", F.lit("x")).withColumn("row", F.lit(1)).withColumn("times", F.lit(2))
    mixed = mixing.mix(docs).collect()
    got = mixing.mixture(docs)
    assert got.columns == docs.columns
    out = got.collect()
    sizes = {r.source: 0 for r in mixed}
    for r in out:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for r in mixed:
        assert abs(sizes[r.source] - r.target) <= 3.5, r.source  # half a document of 6 words
    assert Counter(r.doc_id for r in out)[1] <= 9 and all(n <= 3 for i, n in Counter(r.doc_id for r in out).items() if i != 1)
    again = Counter((r.doc_id, r.text, r.source) for r in mixing.mixture(docs).collect())
    assert again == Counter((r.doc_id, r.text, r.source) for r in out)
    assert mixing.mixture(docs.where("false")).count() == 0 and mixing.mix(docs.where("false")).count() == 0


def test_mixture_meets_the_targets_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    targets = {
        r.source: (r.target, r.longest) for r in mixing.mix(docs).groupBy("source").agg(
            F.first("target").alias("target"),
            F.max("size").alias("longest")
        ).collect()
    }
    got = {r.source: r.words for r in mixing.mixture(docs).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("words")).collect()}
    assert all(abs(got.get(s, 0) - t) <= longest / 2 + 1 for s, (t, longest) in targets.items())


def test_mixture_comes_in_the_shards_that_the_tree_deals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 16)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(1 + i % 37)), f"s{i % 3}") for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    dealt = {}
    for r in mixing.mix(docs).collect():
        for p in {s["pass"] for s in r.segments}:
            pieces = [s for s in r.segments if s["pass"] == p]
            if sum(s.words for s in pieces) * 2 >= r.size:
                dealt.setdefault(r.doc_id, []).append((pieces[0].shard, pieces[0].place))
    got = mixing.mixture(docs).withColumn("part", F.spark_partition_id()).collect()
    assert Counter(r.doc_id for r in got) == Counter({i: len(x) for i, x in dealt.items()})
    order = defaultdict(list)
    for r in got:
        order[r.part].append(r.doc_id)
    shards = defaultdict(list)
    for shard, _, i in sorted((shard, place, i) for i, x in dealt.items() for shard, place in x):
        shards[shard].append(i)
    assert len(shards) == 16
    for ids in order.values():  # a part has whole shards, one after the other, each in its own order
        while ids:
            shard = next(k for k, own in shards.items() if ids[: len(own)] == own)
            ids = ids[len(shards.pop(shard)) :]
    assert not shards
