"""Sharding by a k-d tree over metadata, balanced in bytes.

Documents with equal texts are one unit and stay together.  A unit is a point: size, smallest id, source, language
(the latter two by hash).  Every node of the tree is split along its widest dimension at the weighted median of its
units' bytes; the median is found by a histogram that is refined where the half falls, for all nodes of a level in one
grouped sum.  Splitting ends when a leaf holds one share of the target.  All steps are DataFrame expressions; a
histogram has at most ``BINS`` rows for each node, and ties are broken by a hash of the text, so one value that a third
of all units share is split like any other.

Defined results: a null text has no bytes and counts as equal to an empty one; null metadata are a value of their own;
repeated rows are separate rows of one unit; no rows give no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import stored

BINS_LOG2 = 12
RANGE_LOG2 = 60  #: coordinates: 29 bits of place, 31 bits that break ties
CLOSE = 1e-4  #: of a node's bytes: how far from the half a cut may be
PER_CHUNK = 20_000  #: rows numbered together
UNIT = ["size", "text_crc32", "text_hash"]
DIMENSIONS = ("d0", "d1", "d2", "d3")


def measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    # Bytes of UTF-8; 1 more for each row.
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
                       F.xxhash64("source").alias("source"), F.xxhash64("lang").alias("lang"))


def _units(rows: DataFrame) -> DataFrame:
    """One row for each text, its dimensions as coordinates from 0 to 2^RANGE_LOG2."""
    units = (rows.groupBy(*UNIT).agg(F.sum("size").alias("bytes"), F.min("doc_id").cast("long").alias("id"),
                                     F.min("source").alias("source"), F.min("lang").alias("lang")))
    units = stored(units.select(*UNIT, "bytes", F.col("size").alias("v0"), F.coalesce("id", F.lit(-1)).alias("v1"),
                                F.coalesce("source", F.lit(0)).alias("v2"), F.coalesce("lang", F.lit(0)).alias("v3")),
                   "units")
    ends = units.agg(*(f(F.col(f"v{i}").cast("double")).alias(f"{n}{i}") for i in range(4)
                       for n, f in (("lo", F.min), ("hi", F.max)))).first()
    tie = F.shiftrightunsigned(F.xxhash64("text_hash", "text_crc32"), 33)

    def coordinate(i: int):
        lo, hi = ends[f"lo{i}"] or 0.0, ends[f"hi{i}"] or 0.0
        share = (F.col(f"v{i}").cast("double") - lo) / (hi - lo) if hi > lo else F.lit(0.0)
        return (F.floor(share * ((1 << 29) - 1)).cast("long") * (1 << 31) + tie).alias(f"d{i}")

    return units.select(*UNIT, "bytes", *(coordinate(i) for i in range(4)))


def _cuts(placed: DataFrame) -> DataFrame:
    """For every node to be split: its dimension and the coordinate below which its units go left."""
    spread = [(F.max(d) - F.min(d)).alias(f"s_{d}") for d in DIMENSIONS]
    nodes = placed.where("leaves > 1").groupBy("node", "leaves").agg(F.sum("bytes").alias("total"), *spread)
    widest = F.greatest(*(F.col(f"s_{d}") for d in DIMENSIONS))
    dim = F.coalesce(*(F.when(F.col(f"s_{d}") == widest, i + 1) for i, d in enumerate(DIMENSIONS)))
    goal = F.col("total") * F.floor(F.col("leaves") / 2) / F.col("leaves")
    state = stored(nodes.select("node", "total", dim.alias("dim"), goal.alias("goal"),
                                F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("below")), "nodes")
    here = F.element_at(F.array(*DIMENSIONS), F.col("dim"))
    for level in range(math.ceil(RANGE_LOG2 / BINS_LOG2)):
        width = max(0, RANGE_LOG2 - BINS_LOG2 * (level + 1))
        units = placed.join(state, "node").withColumn("c", here)
        units = units.where((F.col("c") >= F.col("lo")) & (F.col("c") < F.col("lo") + (1 << (width + BINS_LOG2))))
        bins = (units.groupBy("node", "total", "dim", "goal", "below",
                              (F.shiftright(F.col("c") - F.col("lo"), width) * (1 << width) + F.col("lo")).alias("bin"))
                .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("units")))
        up_to = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.col("below") + F.sum("bytes").over(up_to))
        # The bin in which the goal falls: the first that reaches it.
        state = stored(bins.where("upto >= goal").groupBy("node", "total", "dim", "goal")
                       .agg(F.min_by(F.struct("bin", "upto", "bytes", "units"), "bin").alias("x"))
                       .select("node", "total", "dim", "goal", F.col("x.bin").alias("lo"),
                               (F.col("x.upto") - F.col("x.bytes")).alias("below"), F.col("x.bytes").alias("bytes"),
                               F.col("x.units").alias("units")), "nodes")
        open_nodes = state.where(f"units > 1 and bytes > total * {CLOSE}").count()
        if not open_nodes or not width:
            break
        state = state.drop("bytes", "units")
    # Cut before or after the bin, whichever is nearer to the goal.
    after = F.col("below") + F.col("bytes") - F.col("goal") <= F.col("goal") - F.col("below")
    return state.select("node", "dim", (F.col("lo") + F.when(after, 1 << width).otherwise(0)).alias("cut"))


def tree(units: DataFrame, shards: int) -> DataFrame:
    """Units with their shard, from 0."""
    # Stored, as joins on a constant would become products.
    placed = stored(units.withColumns({"node": F.lit(0).cast("long"), "leaves": F.lit(shards).cast("long")}), "placed")
    here = F.element_at(F.array(*DIMENSIONS), F.col("dim"))
    for _ in range(math.ceil(math.log2(max(1, shards)))):
        left = F.floor(F.col("leaves") / 2)
        goes_left = here < F.col("cut")
        # A node is named by its first leaf, so leaves need no numbering of their own.
        placed = stored(placed.join(_cuts(placed), "node", "left").select(
            *UNIT, "bytes", *DIMENSIONS,
            F.when(F.col("cut").isNull() | goes_left, F.col("node")).otherwise(F.col("node") + left).alias("node"),
            F.when(F.col("cut").isNull(), F.col("leaves")).when(goes_left, left)
            .otherwise(F.col("leaves") - left).alias("leaves")), "placed")
    return placed.select(*UNIT, "bytes", F.col("node").cast("int").alias("shard"))


def numbered(rows: DataFrame, chunk_rows: int = PER_CHUNK) -> DataFrame:
    """Gapless numbers from 0 within each shard; no window sees a whole shard."""
    rows = stored(rows, "sharded")
    chunks = max(1, math.ceil(rows.count() / chunk_rows))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(chunks)))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = (rows.groupBy("shard", "chunk").count()
              .withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", *UNIT)
    return (rows.withColumn("place", F.row_number().over(inside) - 1).join(counts, ["shard", "chunk"])
            .withColumn("slot", (F.col("first") + F.col("place")).cast("long"))
            .drop("first", "place", "count", "chunk"))


def sharded(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Shard and slot of every document; ``target_bytes`` asks for as many shards as the total needs."""
    rows = measured(docs)
    units = _units(rows)
    if shards is None:
        total = units.agg(F.sum("bytes")).first()[0] or 0
        shards = max(1, math.ceil(total / (target_bytes or 128 << 20)))
    placed = tree(units, shards)
    found = (rows.join(placed.select(*UNIT, "shard"), UNIT)
             .select("doc_id", "size", "text_crc32", "text_hash", "shard"))
    return numbered(found)
