"""The corpus pipeline: quality rules, language, near duplicates, packing, in this order over the documents table."""

from __future__ import annotations

from functools import wraps
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession

from tessellon.llm import jaccard, langid, packing, quality
from tessellon.llm.common import materialise, remove_table, small_batches, tables

#: Near duplicates: shingles of so many words, and a similarity of at least so many percent.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: For each thread's run over an input folder, and each stage function, what deletes the tables that the stage read: its rows are written when the next one begins.
_spent: dict = {}


def _after(before: str | None):
    """A stage that deletes the working tables of the one before it."""

    def wrap(apply):
        @wraps(apply)
        def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            small_batches(spark)
            own = (get_ident(), sf_dir)
            if spent := _spent.pop((*own, before), None):
                spent(docs)
            with tables(spark) as _spent[*own, apply.__name__]:
                return apply(spark, docs, sf_dir)

        return stage

    return wrap


@_after(None)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their group's robust ellipsoid go."""
    return quality.keep(docs)


@_after("quality_rules")
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told, by distance from every centroid, go."""
    return langid.keep(docs)


@_after("language")
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    return jaccard.keep_one(docs, percent=NEAR_PERCENT, words=NEAR_WORDS)


@_after("near_duplicates")
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of the documents that are left, in length buckets and batches."""
    return packing.packed(docs)


STAGES = [("quality", quality_rules), ("language", language), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Robust estimates, centroids and dynamic programming have no SQL; each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage returns is written as Parquet and read again as the next one's docs."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
            if before is not None:
                remove_table(before)
            before = docs
    return docs
