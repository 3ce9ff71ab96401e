"""Row numbers without sending all rows through one task.

Rows are counted per block (a file split, an output file or a sorted partition), the counts
are summed up over the preceding blocks, and each row adds its place within its block.  Only
the block counts, a few bytes per block, meet in a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.names import col
from tallyfold.session import shared_dir
from tallyfold.sources.scan import BLOCK, FILE, SEQ, WHOLE_FILE

FIRST_RECORD = 2  # row 1 is the header


def offsets(counts: DataFrame, order: Sequence[Column], within: Sequence[str] = ()) -> DataFrame:
    """Replace ``n`` (rows per block) by ``offset`` (rows in the blocks before)."""
    before = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")


def with_row_numbers(rows: DataFrame, all_rows: DataFrame, alias: str = "row_no") -> DataFrame:
    """Give scanned rows their place in their list, counting the header as row 1.

    ``rows`` may be any selection of ``all_rows`` that kept the provenance columns.  The
    record numbers of a delimited list restart in no particular place per split, so they are
    taken relative to the smallest of the split; a Parquet list knows its row indexes.
    """
    whole = F.col(BLOCK) == WHOLE_FILE
    counts = (all_rows.where(~whole).groupBy(FILE, BLOCK)
              .agg(F.min(SEQ).alias("first"), F.count(F.lit(1)).alias("n")))
    placed = offsets(counts, [F.col(BLOCK)], [FILE])
    place = F.col(SEQ) - F.coalesce("first", F.lit(0)) + F.coalesce("offset", F.lit(0))
    # Rows of Parquet lists share one block and have no partner, so they stay out of the join.
    split = rows.where(~whole).join(placed, [FILE, BLOCK], "left").withColumn(alias, place + F.lit(FIRST_RECORD))
    known = rows.where(whole).withColumn(alias, F.col(SEQ) + F.lit(FIRST_RECORD))
    return split.drop("first", "offset", BLOCK, SEQ).unionByName(known.drop(BLOCK, SEQ))


def ascending(names: Sequence[str]) -> list[Column]:
    """Sort order of results: ascending, missing values last."""
    return [col(n).asc_nulls_last() for n in names]


def with_ordinals(df: DataFrame, by: Sequence[str], alias: str = "ordinal") -> DataFrame:
    """Number all rows 1, 2, ... in the order of ``by``.

    The sorted rows are kept in a checkpoint because counting and numbering must see the
    very same partitions.  ``by`` should identify rows: equal rows share a sort partition.
    """
    shared_dir(df.sparkSession)
    placed = (df.orderBy(*ascending(by)).checkpoint()
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    numbered = placed.join(offsets(counts, [F.col("_part")]), "_part")
    return numbered.withColumn(alias, F.col("_place") + F.col("offset") + 1).drop("_part", "_place", "offset")


def with_stored_ordinals(stored: DataFrame, selected: DataFrame, alias: str = "ordinal") -> DataFrame:
    """Number rows of a sorted table by where its files keep them.

    ``stored`` is read from the sorted Parquet table with ``stored_place`` columns;
    ``selected`` is any selection of it.
    """
    counts = stored.groupBy("_name").agg(F.count(F.lit(1)).alias("n"))
    part = F.regexp_extract("_name", r"part-(\d+)", 1).cast("int")
    numbered = selected.join(offsets(counts, [part, F.col("_name")]), "_name")
    return numbered.withColumn(alias, F.col("_index") + F.col("offset") + 1).drop("_name", "_index", "offset")


def stored_place() -> list[Column]:
    """Where a row of a Parquet table lies: file and index within it."""
    return [F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_index")]
