"""From raw documents to sharded training documents, one stage after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet to the shared folder and reread as the next stage's documents. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.llm import decontaminate, minhash, mixing, sharding, toxicity  # noqa: E402
from millrace.llm.common import Scratch  # noqa: E402
from millrace.llm.queries import table  # noqa: E402


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain does not reject."""
    judged = toxicity.judge(docs, table(spark, sf_dir, "labels"))
    return judged.filter("NOT rejected").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(docs, percent=85)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents free of benchmark passages."""
    return decontaminate.remove_documents(decontaminate.find(docs, table(spark, sf_dir, "benchmark"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target share asks for, up to three times."""
    return mixing.repeat(mixing.mix(mixing.measure(docs))).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each kept document goes: its shard among eight and its place in it."""
    return sharding.assign(docs, shards=8)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("near-dedup", one_of_each),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]

# Sampled and learned decisions have no SQL; the tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written once and the one before it deleted."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir), f"pipeline-{name}")
        scratch.free(keep=1)
    return docs
