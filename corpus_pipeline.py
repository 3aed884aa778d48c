"""Corpus pipeline: five text operators in a row, each on the documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starloom.llm.common import Scratch, table
from starloom.llm.decontamination import decontaminate
from starloom.llm.mixing import repeat
from starloom.llm.neardup import keep_one
from starloom.llm.quality_model import keep_good
from starloom.llm.token_store import public_tokenizer, read_documents, write_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer rejects go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words, similarity 0.8 or more."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least a twentieth of their words under benchmark windows go; the others stay as they are."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until each source comes near its target."""
    return repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as Re-Pair compressed token shards, read back."""
    return read_documents(write_shards(docs, public_tokenizer()))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: A trained scorer and a tokenizer decide what comes out, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read back as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
