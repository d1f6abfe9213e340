"""Learned operators against plain statements: naive Bayes by dictionaries, the network text by text, decision lists row by row."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketweave.llm import common, language_id, quality_classifier, quality_rules

SF = "/root/testdata/sf0.001"


def grams(text):
    t = [c + 32 if 65 <= c <= 90 else c for c in map(ord, text)]
    out = Counter()
    for n in language_id.ORDERS:
        for i in range(len(t) - n + 1):
            code = 0
            for c in t[i : i + n]:
                code = (code * int(language_id._BASE) + c + 1) % 2**64
            out[code * int(language_id._SPREAD) % 2**64 * language_id.BUCKETS >> 64] += 1
    return out


def test_posteriors_equal_those_of_dictionaries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500").orderBy("doc_id").limit(60)
    extra = spark.createDataFrame(
        [(10_000, "a", "en"), (10_001, None, None), (10_002, "!!", "en"), (10_003, "é", "fr")],
        "doc_id long, text string, lang string"
    )
    table = docs.select("doc_id", "text", "lang").unionByName(extra)
    rows = [tuple(r) for r in table.collect()]
    counts = defaultdict(Counter)
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None and t is not None:
            counts[lang].update(grams(t))
    logs = {}
    for lang, c in counts.items():
        total = sum(c.values()) + 0.5 * language_id.BUCKETS
        logs[lang] = lambda g, c=c, total=total: round(math.log((c[g] + 0.5) / total) * 2**20) / 2**20
    got = {r.doc_id: r for r in language_id.identify(table).collect()}
    for i, t, _ in rows:
        if t is None or not any(ch.isalpha() for ch in t):
            assert got[i].lang_pred == "und"
            continue
        score = {lang: sum(n * logs[lang](g) for g, n in grams(t).items()) for lang in sorted(counts)}
        best = max(score.values())
        chance = {lang: math.exp(s - best) for lang, s in score.items()}
        top = max(chance, key=lambda k: (chance[k], [-ord(x) for x in k]))
        assert got[i].lang_pred == top and got[i].score == pytest.approx(chance[top] / sum(chance.values()), rel=1e-3)


def test_equal_posteriors_give_the_first_language(spark):
    rows = [(i, "the same words", lang) for i, lang in enumerate(["xx", "aa", "mm"] * 8)]
    learned = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    got = language_id.predict(spark.createDataFrame([(1, "the same"), (2, "zzz")], "doc_id long, text string"), learned, F.lit(False)).collect()
    assert {r.lang_pred for r in got} == {"aa"} and all(r.score == pytest.approx(1 / 3) for r in got)


def plain_score(net, text):
    """The network on one text by loops over its chunks: embed, filter, pool over the whole text, combine."""
    stride, size = quality_classifier.STRIDE, max(2, -(-(len(text) + 1) // quality_classifier.STRIDE))
    flat = (b"\0" + text).ljust(size * stride, b"\0")
    pooled = np.zeros(len(net["bias"]))
    for at in range(0, len(flat) - stride, stride):
        a, b = (np.concatenate([net["embed"][c] for c in flat[k : k + stride]]) for k in (at, at + stride))
        pooled = np.maximum(pooled, a @ net["first"] + b @ net["second"] + net["bias"])
    return 1 / (1 + np.exp(-(pooled @ net["out"] + net["shift"])))


def test_network_scores_equal_loops(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    net = quality_classifier.train(docs, labels)
    odd = spark.createDataFrame(
        [(-1, ""), (-2, None), (-3, "x"), (-4, "é" * 3), (-5, "y" * 7), (-6, "z" * 8), (-7, "last chunk counts" * 9 + "!")],
        "doc_id long, text string"
    )
    table = docs.select("doc_id", "text").orderBy("doc_id").limit(40).unionByName(odd)
    got = {r.doc_id: r for r in quality_classifier.score(table, net).collect()}
    for i, t in table.collect():
        assert got[i].score == pytest.approx(plain_score(net, (t or "").encode()), abs=1e-4)
        assert got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_training_bytes_are_bounded(spark, monkeypatch):
    rows = [(i, "w" * (50 + i)) for i in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(
        [(i, i % 2, 0) for i in range(200)],
        "doc_id long, quality int, toxic int"
    )
    seen = []
    monkeypatch.setattr(quality_classifier, "SAMPLE_BYTES", 3000)
    monkeypatch.setattr(quality_classifier, "fit", lambda texts, y, **k: seen.append(texts) or {})
    quality_classifier.train(docs, labels)
    assert 1000 < sum(map(len, seen[0])) <= 3000


def test_kept_is_what_the_rules_say_row_by_row(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.train(docs, labels)
    names = list(quality_rules.FEATURES)
    base = quality_rules.statistics(docs).select(
        "doc_id",
        quality_rules.base_failed().alias("failed"),
        *[quality_rules.feature(n).alias(n) for n in names]
    ).toPandas()
    x, want = base[names].to_numpy(dtype=float), np.zeros(len(base), dtype=int)
    for k in reversed(range(len(rules))):  # the first rule that holds decides
        want[quality_rules._hits(rules[k], x, names)] = k + 1
    want[base.failed] = 0
    got = {r.doc_id: (r.kept, r.rule) for r in quality_rules.judge(docs, labels).collect()}
    assert rules and got == {int(i): (bool(not f and w == 0), int(w)) for i, f, w in zip(base.doc_id, base.failed, want, strict=True)}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert np.mean([got[i][0] for i in good if i in got]) > 0.9


def test_repeated_ids_do_not_crowd_out_others(spark):
    docs = spark.createDataFrame([(1, f"row {k} " * 30) for k in range(300)] + [(2, "other text " * 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.train(docs, labels, sample=2) == quality_rules.train(docs.dropDuplicates(["doc_id"]), labels, sample=2)


def test_tables_are_dropped_once_used(spark):
    before = len(common._WRITTEN)
    a = common.cut(spark.range(3), "first")
    b = common.cut(a.where("id > 0"), "second")
    assert common.release(spark, before) == before + 1 and b.count() == 2
    with pytest.raises(Exception, match="(?i)not.*exist"):
        a.count()
