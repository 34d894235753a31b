"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept. All but the last return the columns
of ``documents``; where a stage changes a text, ``n_chars`` follows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontamination, line_dedup, near_duplicates, packing, quality_rules
from quillspark.llm.common import table, written
from quillspark.llm.queries import tokenizer_path


def rule_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or score below the threshold go."""
    return quality_rules.keep(docs, quality_rules.fitted(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go."""
    return line_dedup.without_boilerplate(docs, length_col="n_chars")


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return near_duplicates.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go, and with them documents that mostly consist of them."""
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"), length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of at most 2048 tokens."""
    return packing.packed(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", rule_quality),
    ("line dedup", dedup_lines),
    ("near-duplicates", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't express the n-gram model and the tokenizer; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
