"""Validation of tables that are there already."""

import pytest
from conftest import base_spec, rows
from pyspark.sql import functions as F

from tallyfold import Column, Rule, consolidate, validate_tables

SCHEMA = "berth string, hydrant string, opened string, cubic string"
FOUND = ["list_id", "severity", "rule", "column_name", "row_no", "bad_value"]


def test_tables_are_judged_each_for_itself(spark, spec):
    good = spark.createDataFrame([("east", "4", "2", "31.5"), ("north", "1", None, "8.125")], SCHEMA)
    bad = spark.createDataFrame([("east", "4", "2", "much"), (None, "x", "1", "1"), ("w", "1", "1.5", None)], SCHEMA).coalesce(1)
    typed = spark.createDataFrame([(4, "east", 6.25, 1, "Ito")], "hydrant bigint, `berth ` string, cubic double, opened int, inspector string")
    found = validate_tables({"good": good, "bad": bad, "typed": typed, "lacking": good.drop("cubic", "opened"),
                             "twice": good.withColumn(" berth", F.lit("x"))}, spec)
    assert sorted(rows(found.issues, *FOUND), key=str) == sorted([
        ("bad", "error", "wrong_type", "cubic", 2, "much"), ("bad", "error", "missing_value", "berth", 3, None),
        ("bad", "error", "wrong_type", "hydrant", 3, "x"), ("bad", "error", "wrong_type", "opened", 4, "1.5"),
        ("bad", "error", "missing_value", "cubic", 4, None), ("typed", "warning", "unknown_column", "inspector", None, None),
        ("lacking", "error", "missing_column", "cubic", None, None),
        ("lacking", "error", "missing_column", "opened", None, None),
        ("twice", "error", "duplicate_column", None, None, None)], key=str)
    assert sorted(rows(found.status)) == [("bad", None, 5, 0, "error"), ("good", 2, 0, 0, "ok"),
                                          ("lacking", None, 2, 0, "error"), ("twice", None, 1, 0, "error"),
                                          ("typed", 1, 0, 1, "warning")]
    assert sorted(rows(consolidate(found.valid, spec))) == [(1, "north", 8.125, 0), (4, "east", 37.75, 3)]
    strict = validate_tables({"good": good, "typed": typed}, spec, strict=True)
    assert [r.list_id for r in strict.valid.select("list_id").distinct().collect()] == ["good"]


def test_rows_are_numbered_over_partitions(spark, spec):
    df = spark.range(0, 5000, 1, 16).select(F.lit("w").alias("berth"), F.col("id").alias("hydrant"), F.lit(1).alias("opened"),
                                            F.when(F.col("id") % 611 == 0, "x").otherwise("1").alias("cubic"))
    found = validate_tables({"a": df, "b %41+ü/": df.limit(0), "c": df.where("id < 0")}, spec)
    assert sorted(rows(found.issues, "list_id", "row_no")) == [("a", i + 2) for i in range(0, 5000, 611)]
    assert sorted(rows(found.status, "list_id", "rows", "status")) == [("a", None, "error"), ("b %41+ü/", 0, "ok"), ("c", 0, "ok")]


def test_nothing_to_read(spark, spec):
    with pytest.raises(ValueError, match="no tables"):
        validate_tables({}, spec)
    found = validate_tables({"a": spark.range(3)}, spec)
    assert found.rows.columns == ["list_id", *spec.required] and found.valid.count() == 0
    assert found.issues.where("rule = 'missing_column'").count() == 4


def test_names_that_are_used_inside_do_not_clash(spark):
    names = ["_file", "_block", "_seq", "list_id"]
    spec = base_spec(columns=tuple(Column(n, "int") for n in names), keys=tuple(names[:3]), rules=(Rule("list_id", "sum"),),
                     order=tuple(names), sort_by=(), bounds={})
    with pytest.raises(ValueError, match="list_id"):
        validate_tables({"a": spark.createDataFrame([(1, 2, 3, 4)], ", ".join(f"{n} int" for n in names))}, spec)
