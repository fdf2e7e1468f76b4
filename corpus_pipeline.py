"""A corpus pipeline: quality rules, line dedup, near duplicates, substring dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm.common import Scratch, documents, labels
from turnloom.llm.lines import indexed, lines_removed
from turnloom.llm.near import one_of_each
from turnloom.llm.packing import packed
from turnloom.llm.rules import accepted, fit_decision_list
from turnloom.llm.substrings import repeats_removed


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return accepted(docs, fit_decision_list(docs, labels(spark, sf_dir)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go."""
    return lines_removed(docs, indexed(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word windows that start earlier go."""
    return repeats_removed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document that is left is packed."""
    return packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("length_packing", packing),
]

#: Learned rules and the bucket search are not expressible in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each stage's result written and read again."""
    scratch = Scratch(spark)
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs)
    return docs
