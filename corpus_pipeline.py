"""A training-corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet
in the shared folder and reads it back as the next stage's ``docs``. A stage's own tables in that folder are deleted
when the next stage starts, as its result has been written by then.

Defined cases, in all stages: a null id is an id like others and stays with its row; a null text counts as empty and
stays null (a text without words can still go as a near-duplicate of others without words); a null in any other column
is carried; repeated rows are rows like others until near-dedup, where one row of them stays; very long texts
are read whole; of ties the least id stays; an empty table goes through as one; columns beyond those of documents
are carried up to packing, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import free, materialize, read_documents, recorded, release
from textloom.llm.latent import decontaminate
from textloom.llm.lines import dedup_lines
from textloom.llm.packing import pack_texts
from textloom.llm.simhash import keep_first
from textloom.llm.toxicity import drop_toxic

_left: list[str] = []


def _stage(f):
    """Free what the stage before has left; note what this one leaves."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free(spark, *_left)
        release(spark)
        with recorded() as paths:
            out = f(spark, docs, sf_dir)
        _left[:] = paths
        return out

    return run_stage


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; without labels of both classes none does."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line leave the texts; every document stays, one without lines as an empty text."""
    return dedup_lines(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id; texts without words are a group."""
    return keep_first(docs, wordless=True)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; with an empty benchmark none does."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, in pieces, with their places in bins; an empty text is a piece of one separator."""
    return pack_texts(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The stages hash, compress and search; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if hasattr(before, "table_path"):
            free(spark, before)
    free(spark, *_left)
    _left.clear()
    return docs
