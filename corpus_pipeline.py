"""Corpus pipeline: each stage applies one corpus operator to all documents
that its predecessor kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes
it as Parquet in the shared checkpoint folder and reads it back as the next
stage's input, so lineage ends at every stage. All stages but the last return
the columns of ``documents``. Column names that begin with ``__`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import decontaminate, mixture, ngram_join, pii, quality
from tallyframe.llm.common import written
from tallyframe.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and lie within the robust distance
    limit of their language and source; the others go."""
    return quality.keep_good(docs, ["lang", "source"])


def ngram_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a similarity of 0.8 or
    more over five-word shingles: the one with the smallest id."""
    return ngram_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item; the others go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked by kind; ``n_chars``
    follows a changed text."""
    return pii.mask(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them: none, one or
    two rows each."""
    return mixture.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_dedup", ngram_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: The robust estimate, the similarity groups and the CRF are iterative, so no
#: single SQL statement yields the rows; tests/llm holds them against brute force.
ORACLE_SQL = None
