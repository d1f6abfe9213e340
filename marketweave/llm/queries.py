"""The corpus operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_text, language_id, merkle, mixing, near_dedup, quality_classifier, quality_rules, ranked_search, secret_scan, url_filter, vector_links


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    shards = F.size(F.array_distinct(F.transform("segments", lambda s: s["shard"])))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("segments").alias("n_segments"), shards.alias("n_shards"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents"), counted=True)


def op11_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.links(_table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents")).drop("proof")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_url_filter, op3_html_extraction, op4_source_mixing, op5_exact_dedup,
        op6_quality_classifier, op7_bpe, op8_quality_rules, op9_language_id, op10_minhash_near_dedup, op11_vector_links,
        op12_merkle_manifest, op13_ranked_search,
    )
}

ORACLE_SQL = {
    "op2_url_filter": url_filter.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op11_vector_links": vector_links.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_ranked_search": ranked_search.ORACLE,
}
