"""What joins on hot keys read, and which tables the pipeline's stages leave."""

import os

import corpus_pipeline
from marketweave.llm import common, near_dedup
from pyspark.sql import functions as F


def documents(spark, n=60):
    line = " ".join(f"w{j}" for j in range(12))
    rows = [(i, f"{line} " + " ".join(f"d{i % 50}x{j}" for j in range(9 + i % 7)), "en", "ab"[i % 2], 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")


def tables():
    return {p.rpartition("/")[2] for p in common._WRITTEN if os.path.exists(p.removeprefix("file:"))}


def test_few_names_are_joined_without_a_second_read_of_the_rows(spark):
    rows = spark.createDataFrame([(1, i) for i in range(900)] + [(k, 0) for k in range(2, 60)] + [(None, 5)], "k int, id int")
    names = rows.groupBy("k").agg(F.count("*").alias("n"), F.lit("x").alias("name"))
    for how in ("inner", "left"):
        few, many = (common.hot_join(rows, names.where("k is null or k < 50"), ["k"], "n", how, few=m) for m in (100, 0))
        assert sorted(few.collect(), key=str) == sorted(many.collect(), key=str)
        plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" in plan(many) and "LeftAnti" not in plan(few)


def test_bands_of_all_texts_are_joined_once(spark, monkeypatch):
    plans = {}

    def seen(df, name):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return common.cut(df, name)

    monkeypatch.setattr(near_dedup, "cut", seen)
    assert near_dedup.classes(documents(spark)).count() == 60
    # the common line makes a band hot
    assert "LeftAnti" not in plans["buckets"] and "LeftSemi" not in plans["buckets"]


def test_classes_are_the_same_by_broadcast_and_by_shuffle(spark, monkeypatch):
    docs = documents(spark)
    few = sorted(near_dedup.classes(docs, counted=True).collect(), key=str)
    monkeypatch.setattr(near_dedup, "MOST_NAMES", 0)
    assert few == sorted(near_dedup.classes(docs, counted=True).collect(), key=str)


def test_a_stage_drops_the_tables_of_the_stages_before_it(spark, tmp_path):
    docs = documents(spark)
    mine = tables()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = tables()
        out = stage(spark, docs, "")
        if k:
            assert not (before - mine) & tables()
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert mine <= tables()


def test_a_stage_keeps_tables_that_its_documents_read(spark):
    docs = corpus_pipeline.STAGES[2][1](spark, documents(spark), "")
    want = sorted(r.doc_id for r in docs.collect())
    out = corpus_pipeline.STAGES[4][1](spark, docs, "")
    assert sorted(r.doc_id for r in out.collect()) == want
