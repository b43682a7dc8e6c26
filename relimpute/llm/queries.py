"""The registered queries of this folder."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relimpute.llm import conversation_repair, cross_polytope, decontaminate, hard_negatives, jaccard, language_id, language_model, licenses, line_dedup, packing, token_counts, toxicity, vector_dedup
from relimpute.plans.registry import Registry

suite = Registry()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@suite.add("op1_language_id")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.language_id(table(spark, folder, "documents"), folds=4, held_out=2)


@suite.add("op2_line_dedup", line_dedup.SQL)
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_dedup_digest(table(spark, folder, "documents"), min_docs=10)


@suite.add("op3_license_scan")
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A document lies in the folder of its source."""
    docs = table(spark, folder, "documents")
    return licenses.license_scan(docs.select("doc_id", "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")))


@suite.add("op4_packing")
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=2048)


@suite.add("op5_vector_dedup", vector_dedup.SQL)
def op5_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.vector_dedup(table(spark, folder, "embeddings"), least=0.9)


@suite.add("op6_jaccard_join", jaccard.SQL)
def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, folder, "documents"), k=5, percent=75)


@suite.add("op7_decontamination", decontaminate.SQL)
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontaminate_digest(table(spark, folder, "documents"), table(spark, folder, "benchmark"), size=10)


@suite.add("op8_lm_scores")
def op8_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.lm_scores(table(spark, folder, "documents"), folds=7, held_out=2)


@suite.add("op9_token_counts")
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@suite.add("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), folds=5, held_out=0)


@suite.add("op11_conversation_repair", conversation_repair.SQL)
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.conversation_repair(table(spark, folder, "conversations"))


@suite.add("op12_hard_negatives", hard_negatives.SQL)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of rows whose id is divisible by 7 are moved on by one first."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), every=50)


@suite.add("op13_nearest_neighbours")
def op13_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return cross_polytope.nearest(table(spark, folder, "embeddings"), every=50, k=5)


suite.add("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
