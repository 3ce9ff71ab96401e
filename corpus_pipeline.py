"""The corpus pipeline: five stages over ``documents``, each working on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread for the next.  All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import decontam, jaccard, packing, pii, quality
from tallyfold.llm.common import importable, stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(model) >= F.lit(0.5))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row: that with the smallest id, of its texts that of the least class.

    If no id repeats or is null, only ids of what goes are joined back; else rows are named by id, class and text.  Rows
    of one id with different texts are different documents, only equal ones are reduced.
    """
    importable(spark)
    base, groups = jaccard.labelled(docs)
    if base.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        gone = jaccard.named(base, groups).where("doc_id <> component_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    key = ["no_id", "own_id", "n", "c1", "c2", "text_hash"]
    rows = (docs.select(F.struct(*docs.columns).alias("row"), jaccard.set_key("text").alias("k"))
            .select("row", F.col("row.doc_id").isNull().alias("no_id"),
                    F.coalesce(F.col("row.doc_id").cast("long"), F.lit(0)).alias("own_id"), "k.*",
                    F.xxhash64("row.text").alias("text_hash")))
    rows = stored(rows, "keyed-rows")
    chosen = (rows.select(*key).where("n > 0").join(groups.select(*jaccard.SET_KEY, "label"), jaccard.SET_KEY)
              .groupBy("label").agg(F.min(F.struct(*key)).alias("key")).select("key.*"))
    bare = rows.where("n = 0")
    kept = (rows.join(chosen, key, "left_semi").dropDuplicates(key)
            .unionByName(bare.where("not no_id").dropDuplicates(key)).unionByName(bare.where("no_id")))
    return kept.select("row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    found = decontam.with_leaks(rows, table(spark, sf_dir, "benchmark"), "row.text")
    return found.where(F.size("leaks") == 0).select("row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows the text."""
    importable(spark)
    clean = pii.redacted(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.char_length("text").cast(kind))
    return clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    importable(spark)
    return packing.packed_documents(docs)


STAGES = [("quality", keep_quality), ("near copies", drop_near_copies), ("benchmark", drop_benchmark),
          ("personal data", redact), ("packing", pack)]
ORACLE_SQL = None  # learned models and bin packing have no SQL form; tests compare stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
