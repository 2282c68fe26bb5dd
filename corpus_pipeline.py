"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing and
sharding, each stage reading what the one before it kept.

Edge cases: a null or empty text, or one without a letter, has no language and goes in
the first stage, so does every document when no row names its language. Null ``doc_id``,
``lang`` or ``source`` are values like any other. Rows that repeat a document are one of
its near-duplicate group and one of them stays; mixing may then take a document several
times. An empty table gives no rows in every stage; without a benchmark or labels nothing
is removed for them. Extra columns pass all stages; the last one replaces columns that
have its names. Very long texts are handled by the stages' operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadpulse.llm import decontam, language, mixing, sharding, simhash
from roadpulse.llm.common import prepare, read_table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not found go."""
    prepare(spark)
    return language.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    prepare(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the target weights of the domains ask."""
    return mixing.mixed(docs, read_table(spark, sf_dir, "labels"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard and its place in it."""
    prepare(spark)
    return sharding.shard(docs, map_path=sharding.map_folder(spark, sf_dir, "pipeline"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_to_targets),
    ("sharding", shards),
]

# Learned and hashed stages are not SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages; each result but the last is written to
    the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
