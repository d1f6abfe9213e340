"""The corpus pipeline: language ID, exact dedup, near dedup, mixing and BPE, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from marketweave.llm import bpe, common, exact_dedup, language_id, mixing, near_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that the stages called so far have written and that are not dropped yet.
_HELD: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """The stage, which first drops the tables of the stages before it, but for those that its documents still read.

    A stage's result is written before the next stage starts, which then reads that and none of those tables.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _HELD[:] = common.drop_tables(spark, _HELD, docs)
        before = set(common._WRITTEN)
        out = stage(spark, docs, sf_dir)
        _HELD.extend(p for p in common._WRITTEN if p not in before)
        return out

    return run


@_tidy
def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; null texts and texts without a letter go."""
    return language_id.keep_known(docs)


@_tidy
def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the row with the largest doc_id; of rows of that id, one."""
    return exact_dedup.drop_duplicates(docs)


@_tidy
def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least doc_id."""
    return near_dedup.drop_near_duplicates(docs, counted=True)


@_tidy
def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents up to their source's target, up to three times over; documents without words are not taken."""
    return mixing.mixture(docs)


@_tidy
def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row, repeated ones too."""
    return bpe.digests(docs)


STAGES = [("language_id", _language), ("exact_dedup", _exact), ("minhash_near_dedup", _near), ("source_mixing", _mix), ("bpe_encode", _encode)]
#: Naive Bayes, sketches and hashed orders have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each other stage's result is written to the shared folder and read again.

    Once a stage's result is written, the tables that it was made of are dropped, its predecessor's among them. Null texts and ids, repeated rows and
    columns beyond those of documents pass through as each stage's operator states; an empty table gives an empty result.
    """
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(common._WRITTEN)
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), f"stage-{name}")
        common.release(spark, start)
    return STAGES[-1][1](spark, docs, sf_dir)
