"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import math
import os
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.session import work_dir

BATCH_KEY, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; absent elsewhere


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package where the driver found it.

    Only matters when the package is run from its source folder; on a cluster it is installed on the executors.
    Rows are handed to Python ``BATCH`` bytes at a time where the session keeps Spark's default: a batch stands in memory
    several times over, in the JVM and in the worker, and its results beside it.
    """
    if spark.conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH)
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the folder shared by all executors and read back: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: str, folds: int, fold_no: int) -> Column:
    """Whether crc32 of the key's text leaves ``fold_no``; a null key is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold_no, F.lit(False))


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_part))


def give_back() -> None:
    """Hand freed memory back to the machine: Python workers live on and share it with Spark."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_batches(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterable[tuple[int, pa.Array]]:
    """Slices of a text column of about ``most_bytes`` (at least one text each), with the first row's number.

    What was freed on the way is handed back after the last one.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, used = 0, 0
    for i, n in enumerate(sizes):
        if i > start and used + n > most_bytes:
            yield start, texts.slice(start, i - start)
            start, used = i, 0
        used += int(n)
    if start < len(sizes):
        yield start, texts.slice(start)
    give_back()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component = smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al.): every step is one grouped minimum and one join,
    the number of rows never exceeds twice the edges, and the number of rounds grows with the logarithm of the
    longest path.  Each round is stored in the shared folder.  Smallest nodes and nodes without an edge are not
    returned; null ends and loops are ignored.
    """
    links = (edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
             .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    links = stored(links, "links")
    seen = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        other = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        small = down.join(low, "u").select(other.alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        links = stored(small, "links")
        row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == seen:
            return links.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
        seen = (row.n, row.h)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
