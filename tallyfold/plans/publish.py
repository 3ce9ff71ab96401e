"""Writing results: each run writes a version of its own, and a pointer says which one counts.

A target folder holds versions ``v-<run>`` and, in ``_tallyfold``, pointers numbered 1, 2, ...  Data is written once, to
its final place, and never renamed.  A version is published by creating the next pointer, a small file whose creation
fails if another run was faster; readers follow the highest pointer that is complete.  So at any moment, whatever was
interrupted, they see one whole result: the last one or the one before.

Runs on one target come one after the other: a publication clears what earlier runs left behind half-finished, and
versions older than the one before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.names import col
from tallyfold.sources import storage
from tallyfold.sources.catalog import CSV, PARQUET, Dialect, InputError
from tallyfold.spec import Spec

POINTERS = "_tallyfold"  # folder of the pointers, in every target; Spark's scans skip it
VERSION = "v-"
KEPT = 2  # versions that stay: readers of the one before are not interrupted


def guard_paths(spark: SparkSession, input_dir: str, output: str | None = None, report_dir: str | None = None) -> None:
    """Refuse folders that lie in each other, and an output that is not this engine's to replace.

    A result inside the input would be counted by the next run; replacing an output that holds
    the input or the report would delete them.
    """
    paths = {n: storage.qualified(spark, p) + "/"
             for n, p in (("input", input_dir), ("output", output), ("report", report_dir)) if p is not None}
    for a, b in combinations(paths, 2):
        if paths[a].startswith(paths[b]) or paths[b].startswith(paths[a]):
            raise InputError(f"{a} and {b} must not lie in each other: {paths[a]}, {paths[b]}")
    if output is not None and storage.exists(spark, output) and not _replaceable(spark, output):
        raise InputError(f"output {output} exists and was not published by this engine")


def _replaceable(spark: SparkSession, target: str) -> bool:
    held = storage.entries(spark, target) if storage.is_directory(spark, target) else None
    return held is not None and (not held or any(e.name == POINTERS and not e.is_file for e in held))


def write_result(df: DataFrame, path: str, kind: str = PARQUET, dialect: Dialect = Dialect(),
                 mode: str = "overwrite", partition_by: Sequence[str] = ()) -> str:
    """Write a table, replacing what was there; missing parent folders are created."""
    if kind == PARQUET:
        df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    elif kind == CSV:
        plain = [_plain(df, f) for f in df.schema]
        (df.select(*plain).write.mode(mode).partitionBy(*partition_by)
         .options(sep=dialect.sep, quote=dialect.quote, escape=dialect.quote, header=True, encoding="UTF-8",
                  emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
         .csv(path))
    else:
        raise ValueError(f"unknown format {kind}")
    return path


def _plain(df: DataFrame, field: T.StructField):
    # A fixed-scale decimal as text would carry its padding zeros along.
    if not isinstance(field.dataType, T.DecimalType) or field.dataType.scale == 0:
        return col(field.name)
    return F.regexp_replace(col(field.name).cast("string"), r"\.?0+$", "").alias(field.name)


def default_output(input_dir: str, spec: Spec) -> str:
    """A folder next to the input, named after the spec and its suffix."""
    parent, slash, _ = input_dir.rstrip("/").rpartition("/")
    name = re.sub("_+", "_", re.sub(r"[^A-Za-z0-9_-]+", "_", spec.name.strip())).strip("_")
    return f"{parent}{slash}merged_{name or 'result'}{spec.suffix}"


def begin(spark: SparkSession, target: str, run_id: str) -> str:
    """Claim the target and name the folder of this run's version."""
    if storage.exists(spark, target) and not _replaceable(spark, target):
        raise InputError(f"output {target} was not published by this engine")
    storage.make_directory(spark, f"{target}/{POINTERS}")
    return f"{target}/{VERSION}{run_id}"


def abandon(spark: SparkSession, target: str, version: str) -> None:
    """Remove a version that is not to be published, and a target that never held anything else."""
    storage.delete(spark, version)
    if _pointers(spark, target):
        return
    if {e.name for e in storage.entries(spark, target)} <= {POINTERS}:
        storage.delete(spark, target)


def publish(spark: SparkSession, target: str, version: str, kind: str = PARQUET, schema: T.StructType | None = None,
            dialect: Dialect = Dialect()) -> None:
    """Make a finished version the one that readers see, then clear what no reader can need."""
    schema = schema or spark.read.parquet(storage.literal(version)).schema
    found = {"version": version.rpartition("/")[2], "format": kind, "schema": schema.jsonValue(), "sep": dialect.sep,
             "quote": dialect.quote}
    number = max(_pointers(spark, target), default=0) + 1
    while not storage.create_file(spark, _pointer(target, number), json.dumps(found).encode()):
        number += 1
    _clear(spark, target)


def current(spark: SparkSession, target: str) -> dict | None:
    """What the highest complete pointer says, with ``path``; None if nothing was ever published there."""
    return next(iter(_complete(spark, target).values()), None)


def published(spark: SparkSession, target: str) -> DataFrame:
    """The published result of a target, as it is now."""
    found = current(spark, target)
    if found is None:
        raise InputError(f"nothing was published in {target}")
    return read_version(spark, found["path"], found["format"], T.StructType.fromJson(found["schema"]),
                        Dialect(sep=found["sep"], quote=found["quote"]))


def read_version(spark: SparkSession, path: str, kind: str, schema: T.StructType, dialect: Dialect) -> DataFrame:
    """Delimited results are read as the texts they are."""
    names = [col(f.name) for f in schema]
    if kind == PARQUET:
        return spark.read.schema(schema).parquet(storage.literal(path)).select(*names)
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    return (spark.read.schema(texts).options(sep=dialect.sep, quote=dialect.quote, escape=dialect.quote, header=True,
                                             multiLine=True).csv(storage.literal(path)).select(*names))


def _pointer(target: str, number: int) -> str:
    return f"{target}/{POINTERS}/{number:020d}"


def _pointers(spark: SparkSession, target: str) -> list[int]:
    if not storage.exists(spark, f"{target}/{POINTERS}"):
        return []
    return [int(e.name) for e in storage.entries(spark, f"{target}/{POINTERS}") if e.is_file and e.name.isdigit()]


def _complete(spark: SparkSession, target: str) -> dict[int, dict]:
    """The newest complete pointers, at most ``KEPT``: one that was cut off in writing, or whose version is gone, says
    nothing."""
    found: dict[int, dict] = {}
    for number in sorted(_pointers(spark, target), reverse=True):
        try:
            told = json.loads(storage.read_file(spark, _pointer(target, number)))
        except ValueError:
            continue
        told["path"] = f"{target}/{told['version']}"
        if storage.exists(spark, told["path"]):
            found[number] = told
        if len(found) == KEPT:
            break
    return found


def _clear(spark: SparkSession, target: str) -> None:
    kept = _complete(spark, target)
    versions = {told["version"] for told in kept.values()}
    for e in storage.entries(spark, target):
        if e.name.startswith(VERSION) and e.name not in versions:
            storage.delete(spark, e.path)
    for number in _pointers(spark, target):
        if number < min(kept):
            storage.delete(spark, _pointer(target, number))
