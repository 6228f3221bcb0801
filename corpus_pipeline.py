"""From raw documents to a training mix: five stages, each written before the next reads it.

Quality rules drop what they reject, the n-gram Jaccard join keeps one document of each
group, decontamination drops documents with benchmark passages, the secret scan blanks
out what it finds, and the last stage draws the mix of sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillbook.llm import decontamination, mixing, near_duplicates, quality, secrets
from tillbook.llm.common import ready, table
from tillbook.operators.staging import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return quality.clean(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return near_duplicates.clean(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the times each is read and the words that gives."""
    ready(spark)
    return mixing.drawn(docs).select("row.*", "times", "taken")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("mixing sources", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


# The join and the outlier test are iterative, so the stages are tested against
# brute-force versions instead.
ORACLE_SQL = None
