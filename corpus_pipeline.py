"""From raw documents to shards of a good, deduplicated, decontaminated and mixed corpus.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's rows as Parquet
to the shared folder and reads them again for the next.

All stages judge rows, not ids: an id may be null or repeated, any column may be null, texts may be empty or
of any length, and columns beyond those of ``documents`` pass through whatever their names (but ``shard`` and
``slot``, which the last stage sets). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bondweave.llm import decontam, mixing, near_copies, quality, sharding
from bondweave.llm._common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep; labels of documents no longer here go unused.

    Null and empty texts have no words and go; repeated rows stay or go together.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts whose five-word shingles are similar by 0.8 or more.

    The row of the least id stays, ties by hash; a null id stays only if its class has no other. Rows equal in all
    columns are one. Null texts and those without a word are one class.
    """
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; null and empty texts have none and stay, repeated rows go together."""
    return decontam.drop_contaminated_texts(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once, or up to three times.

    Null sources are a source of their own; null and empty texts have size 0; of equal rows as many come as the target asks for.
    """
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their shard and slot; nulls hash like values, rows equal in all columns get slots of their own."""
    return sharding.shard(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can express neither the forest nor the hashes; tests run each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
