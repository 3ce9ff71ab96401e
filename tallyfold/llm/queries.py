"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import (decontam, filter_audit, html, jaccard, langid, neardup, packing, pieces, pii, quality, sharding,
                           substring, trie)
from tallyfold.llm.common import fold, table


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"))
    return (docs.select("doc_id", fold("doc_id", quality.FOLDS, quality.HELD_OUT).alias("held_out"),
                        quality.score(model).alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(table(spark, folder, "documents"))


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.sharded(table(spark, folder, "documents"), shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.predicted(langid.learn(docs))
    return (docs.select("doc_id", fold("doc_id", langid.FOLDS, langid.HELD_OUT).alias("held_out"),
                        found.alias("found"))
            .select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")))


def op5_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.joined(table(spark, folder, "documents"))


def op6_personal(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(table(spark, folder, "documents"))


def op7_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.linked(table(spark, folder, "embeddings"))


def op8_passages(spark: SparkSession, folder: str) -> DataFrame:
    return substring.grouped(table(spark, folder, "documents"))


def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extracted(table(spark, folder, "pages"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, folder, "conversations"))


def op12_pieces(spark: SparkSession, folder: str) -> DataFrame:
    found = pieces.decoded(pieces.encoded(table(spark, folder, "documents")))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), pieces.ids_digest().alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(filter_audit.flagged(table(spark, folder, "documents"), table(spark, folder, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality, "op2_packing": op2_packing, "op3_sharding": op3_sharding,
    "op4_language": op4_language, "op5_jaccard": op5_jaccard,
    "op6_personal": op6_personal, "op7_embeddings": op7_embeddings,
    "op8_passages": op8_passages, "op9_main_text": op9_main_text, "op10_decontamination": op10_decontamination,
    "op11_conversation_trie": op11_conversation_trie, "op12_pieces": op12_pieces,
    "op13_filter_audit": op13_filter_audit}
ORACLE: dict[str, str] = {"op11_conversation_trie": trie.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
