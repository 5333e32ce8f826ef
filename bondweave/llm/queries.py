"""One query for each operator: it applies the operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, extraction, hard_negatives, language, mixing, periodic_runs, quality, secrets, sharding, simhash, urls, warc
from ._common import table
from .oracles import ORACLES


def op1_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_digest(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs, bits=language.WHOLE))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(found.fp).alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source", "source_size", "target", "taken")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rules_frame(spark))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], rows.schema))
    return chat.chat_digest(chat.format_turns(chat.canonical_turns(chat.in_many_layouts(chat.records_of_rows(rows)))))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(spark, warc.archived(table(spark, sf_dir, "pages")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(hard_negatives.integer_vectors(rows), F.col("id") % 100 == 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents"))
    return periodic_runs.runs_digest(periodic_runs.runs_of_texts(docs))


def digest_op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2's deal: rows and gapless slots of each shard, and the bytes of all."""
    d = op2_sharding(spark, sf_dir)
    each = d.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.sum("size").alias("_b"))
    total = each.agg(F.sum("_b").alias("bytes"))  # one row
    return each.drop("_b").join(F.broadcast(total))


def digest_op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def digest_op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = op7_mixing(spark, sf_dir)
    return d.groupBy("source").agg(F.max("source_size").alias("source_size"), F.round(F.max("target"), 3).alias("target"))


def digest_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_quality(spark, sf_dir).drop("kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (op1_extraction, op2_sharding, op3_decontamination, op4_language, op5_secrets, op6_simhash, op7_mixing, op8_url_filter, op9_quality, op10_chat, op11_warc, op12_hard_negatives, op13_periodic_runs)
    return {f.__name__: f for f in (*numbered, digest_op2, digest_op5, digest_op7, digest_op9)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
