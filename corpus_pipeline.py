"""From raw documents to packed training sequences, in five stages.

Each stage's result is written as Parquet in the shared folder and read again by the next, and removed once
that one is written. All stages but the last return the columns of ``documents``, whatever others it has.
Null and empty texts have no words, so the first stage drops them; null ids, repeated rows, ties and very
long texts are as each operator states; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandflow.llm import mixing, packing, quality, secrets, simhash
from strandflow.session import discard, materialize, ship, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed rules, or whose score passes their stratum's proven cutoff, go; without labels only the former."""
    ship(spark)
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that of the smallest id."""
    ship(spark)
    return simhash.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a marker; all documents stay."""
    ship(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, whole; null sources are one source."""
    ship(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null or empty text has its end token alone."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("mix", mix_sources),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
