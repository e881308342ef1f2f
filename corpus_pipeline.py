"""A training corpus from raw documents: five stages, each stored before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomwerk.llm import decontaminate, langid, mixing, near_dups, sharding
from bomwerk.llm.tables import read, stored
from bomwerk.session import tune

SHARDS = 40


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those it rejects go."""
    tune(spark)
    dictionaries = langid.train(docs.select("doc_id", "text", "lang"))
    return langid.classify(docs, dictionaries).where(~F.col("rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the lowest id."""
    tune(spark)
    return near_dups.deduplicated(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    tune(spark)
    return decontaminate.decontaminated(docs, read(spark, folder, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix takes it: up to three times, or not at all."""
    tune(spark)
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents with their size, shard and slot."""
    tune(spark)
    return sharding.assign(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
    ("shards", shards),
]

# Compression, darts and templates have no SQL; tests compare the stages with plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents in ``folder``."""
    docs = read(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, folder)
