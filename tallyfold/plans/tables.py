"""Checking tables that are there already, as a folder of lists would be."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.names import col, normalize_name
from tallyfold.operators import numbering, validate
from tallyfold.plans import report
from tallyfold.sources.catalog import CATALOG_SCHEMA, Dialect, decoded_name
from tallyfold.sources.scan import BAD_TEXT, BLOCK, FILE, MALFORMED, SEQ, UNCLOSED, cells
from tallyfold.spec import Spec

INSIDE = {FILE, BLOCK, SEQ, MALFORMED, BAD_TEXT, UNCLOSED}  # names of columns that travel along


@dataclass(frozen=True)
class Validation:
    """Findings about tables; everything is lazy, nothing runs until a table is used."""

    issues: DataFrame       # every finding with list, column, row and value
    status: DataFrame       # one row per table: rows, errors, warnings, status
    rows: DataFrame         # converted rows of all tables that have the required columns, with ``list_id``
    valid: DataFrame        # those of tables without an error


def validate_tables(tables: Mapping[str, DataFrame], spec: Spec, *, strict: bool = False,
                    dialect: Dialect = Dialect()) -> Validation:
    """Check every table against the spec, each for itself, with all findings of all of them.

    A table without a required column, or with one twice, is not looked into.  Rows are numbered as they come, from 2
    on as in a list with a header; for a number to mean something, the table must have an order of its own.
    """
    if not tables:
        raise ValueError("no tables to validate")
    taken = {*INSIDE, "list_id"} & set(spec.required)
    if taken:
        raise ValueError(f"columns of these names cannot be validated as tables: {sorted(taken)}")
    spark = next(iter(tables.values())).sparkSession
    found = {name: _names(df) for name, df in tables.items()}
    doubled = {n for n, names in found.items() if max(Counter(names).values(), default=0) > 1}
    catalog = spark.createDataFrame(
        [(name, name, list(names), "duplicate_column" if name in doubled else None) for name, names in found.items()],
        CATALOG_SCHEMA)
    load = validate.load_issues(catalog)
    columns = validate.escalate(
        validate.column_issues(catalog.where(F.col("load_rule").isNull()), spec), strict)
    complete = [n for n in tables if n not in doubled and set(spec.required) <= set(found[n])]
    read = [_placed(n, tables[n], found[n], spec, dialect) for n in complete]
    issues, rows = load.unionByName(columns), _no_rows(spark, spec, dialect)
    counts, sizes = report.issue_counts(issues), rows.select("list_id", F.lit(0).alias("rows"))
    if read:
        every = reduce(DataFrame.unionByName, read)
        name = decoded_name(FILE)
        bad = numbering.with_row_numbers(validate.cell_issues(every, spec, [FILE, BLOCK, SEQ]), every)
        issues = issues.unionByName(bad.select(*validate.issue(
            name, "cell", "error", F.col("rule"), F.col("column_name"), F.col("row_no"), F.col("bad_value"))))
        rows = validate.typed_rows(every.withColumn("list_id", name), spec, ["list_id"])
        # How many, but not where, comes from one pass of counters.
        sizes = validate.list_profile(every, spec)
        in_cells = validate.cell_issue_counts(sizes, spec).groupBy("list_id").agg(
            F.sum("n").alias("errors"), F.lit(0).cast("bigint").alias("warnings"))
        counts = counts.unionByName(in_cells).groupBy("list_id").agg(
            *[F.sum(c).alias(c) for c in ("errors", "warnings")])
    status = report.list_status(catalog, counts, sizes)
    good = status.where("errors = 0").select("list_id")
    return Validation(issues, status, rows, rows.join(good, "list_id", "left_semi"))


def _names(df: DataFrame) -> tuple[str, ...]:
    return tuple(normalize_name(n) for n in df.columns)


def _placed(name: str, df: DataFrame, names: tuple[str, ...], spec: Spec, dialect: Dialect) -> DataFrame:
    """Cells of one table, each row with the partition it stands in and its place there."""
    held = dict(zip(names, df.columns))
    df = df.drop(*INSIDE & set(df.columns))
    flags = (MALFORMED, BAD_TEXT, UNCLOSED)
    at = df.withColumns({FILE: F.lit(quote(name)), BLOCK: F.spark_partition_id().cast("bigint"),
                         SEQ: F.monotonically_increasing_id(), **{c: F.lit(False) for c in flags}})
    return cells(at, spec, [FILE, BLOCK, SEQ, *flags], dialect, {n: held[n] for n in spec.required})


def _no_rows(spark: SparkSession, spec: Spec, dialect: Dialect) -> DataFrame:
    texts = spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in spec.required]))
    typed = validate.typed_rows(cells(texts, spec, dialect=dialect), spec)
    return typed.select(F.lit("").alias("list_id"), *[col(n) for n in spec.required])
