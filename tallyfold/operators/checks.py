"""Checks on the merged result before anyone may see it."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallyfold.functions import exact
from tallyfold.functions.names import col
from tallyfold.operators.consolidate import TOTAL_TYPE, Spans, addend, is_free, result_order, sum_type, total
from tallyfold.operators.numbering import ascending, with_ordinals
from tallyfold.operators.validate import free_total, issue, stacked_totals
from tallyfold.spec import Spec

ALIKE = "_tallyfold_alike"  # rows with the same keys


def control_totals(rows: DataFrame, spec: Spec, spans: Spans | None = None) -> DataFrame:
    """Exact total of every summed column, with the row count: (column_name, total, rows).

    A total that cannot be held is NULL, never 0.
    """
    return measured_totals(rows, spec, spans).select("column_name", "total", "rows")


def measured_totals(rows: DataFrame, spec: Spec, spans: Spans | None = None) -> DataFrame:
    """Control totals with what it takes to compare doubles of any size (see ``stacked_totals``)."""
    return stacked_totals(rows.agg(*_totals(rows, spec, spans)), spec.columns_with("sum"))


def _totals(rows: DataFrame, spec: Spec, spans: Spans | None) -> list[Column]:
    types = {f.name: f.dataType for f in rows.schema}
    found = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(spec.columns_with("sum")):
        if is_free(spec, n, types[n]):
            value = F.nanvl(col(n).cast("double"), F.lit(None).cast("double"))
            found += free_total(i, value, (spans or {}).get(n, exact.USUAL))
        else:
            found.append(total(addend(spec, n, types[n]), sum_type(spec, n, types[n])).alias(f"t{i}"))
    return found


def result_profile(merged: DataFrame, spec: Spec, spans: Spans | None = None) -> DataFrame:
    """One row about a merged result, from one pass: rows, control totals, values out of range."""
    outside = [F.count_if(violated) for _, _, violated in range_rules(spec)]
    return merged.agg(*_totals(merged, spec, spans), sum(outside, F.lit(0)).cast("bigint").alias("outside"))


def reconcile(before: DataFrame, after: DataFrame) -> DataFrame:
    """Compare control totals; columns present on one side only are left out.

    Totals agree if they are equal at two decimals.  Doubles of any size may also differ by what rounding each merged
    value to a double can make up.  A total that could not be held is NULL and agrees with nothing.
    """
    measured = {"digits", "slack"} <= set(before.columns) & set(after.columns)
    more = ["digits", "slack"] if measured else []
    b = before.select("column_name", F.col("total").cast(TOTAL_TYPE).alias("sum_before"),
                      F.col("rows").alias("rows_in"), *[F.col(c).alias(f"{c}_before") for c in more])
    a = after.select("column_name", F.col("total").cast(TOTAL_TYPE).alias("sum_after"),
                     F.col("rows").alias("rows_out"), *more)
    passed = F.coalesce(F.col("sum_before") == F.col("sum_after"), F.lit(False))
    if measured:
        gap = exact.nearest(F.zip_with("digits_before", "digits", lambda x, y: x - y), exact.ALL[0])
        passed = passed | F.coalesce(F.abs(gap) <= F.col("slack"), F.lit(False))
    return b.join(a, "column_name").select(
        "column_name", "sum_before", "sum_after", passed.alias("passed"),
        "rows_in", "rows_out", (F.col("rows_in") - F.col("rows_out")).alias("duplicates_merged"))


def residual_duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations held by more than one row, once each, with their number ``n``."""
    return rows.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def sorted_and_counted(rows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> tuple[DataFrame, Observation]:
    """Rows in the order of ``by``, which must be the keys in some order, and how many of them share their keys.

    The ranges that the sort deals rows into hold all rows of a key, so counting them there takes no shuffle of its own.
    The observation's ``repeated`` is known once the rows have been written.
    """
    if set(keys) != set(by):
        raise ValueError(f"rows sorted by {list(by)} are not dealt by {list(keys)}")
    alike = F.count(F.lit(1)).over(Window.partitionBy(*[col(k) for k in keys]))
    held = Observation()
    counted = (rows.repartitionByRange(*ascending(by)).withColumn(ALIKE, alike)
               .observe(held, F.count_if(F.col(ALIKE) > 1).alias("repeated")))
    return counted.sortWithinPartitions(*ascending(by)).drop(ALIKE), held


def range_rules(spec: Spec) -> list[tuple[str, str, Column]]:
    """(rule, column, violated?) for bounded result columns; counts have no bounds of their own."""
    counted = set(spec.columns_with("count"))
    rules = []
    for name, bounds in spec.bounds.items():
        if name in counted:
            continue
        if bounds.min is not None:
            rules.append(("below_min", name, col(name) < _limit(spec, name, bounds.min)))
        if bounds.max is not None:
            rules.append(("above_max", name, col(name) > _limit(spec, name, bounds.max)))
    return rules


def _limit(spec: Spec, name: str, bound: float) -> Column:
    exact = name in spec.exact and name in spec.columns_with("sum")
    return F.lit(Decimal(str(bound)) if exact else float(bound))


def range_violations(merged: DataFrame, spec: Spec, carry: Sequence[str] = ()) -> DataFrame:
    """One row per value outside its bounds; missing values pass."""
    rules = range_rules(spec)
    if not rules:
        return merged.select(*[col(c) for c in carry], F.lit("").alias("rule"), F.lit("").alias("column_name"),
                             F.lit("").alias("bad_value")).limit(0)
    found = F.array_compact(F.array(*[
        F.when(violated, F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("column_name"),
                                  col(name).cast("string").alias("bad_value")))
        for rule, name, violated in rules]))
    return merged.select(*[col(c) for c in carry], F.explode(found).alias("found")).select(
        *[col(c) for c in carry], "found.*")


def duplicate_issues(duplicates: DataFrame, spec: Spec) -> DataFrame:
    keys = F.to_json(F.struct(*[col(k).alias(k) for k in spec.keys]), {"ignoreNullFields": "false"})
    return duplicates.select(*issue(F.lit(None), "result", "error", F.lit("residual_duplicate"), bad_value=keys))


def sum_issues(reconciliation: DataFrame) -> DataFrame:
    return reconciliation.where(~F.col("passed")).select(
        *issue(F.lit(None), "result", "error", F.lit("sum_mismatch"), F.col("column_name"),
               bad_value=F.concat_ws(" <> ", *[F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
                                               for c in ("sum_before", "sum_after")])))


def range_issues(violations: DataFrame) -> DataFrame:
    """``violations`` carries the ``ordinal`` of its row in the result; the header is row 1."""
    return violations.select(*issue(F.lit(None), "result", "error", F.col("rule"), F.col("column_name"),
                                    F.col("ordinal") + 1, F.col("bad_value")))


def check(merged: DataFrame, before: DataFrame, spec: Spec) -> DataFrame:
    """All findings about a merged result: leftover duplicates, changed totals, values out of range.

    ``before`` are the control totals of the rows that went in.  Rows of the result count in
    its sort order.
    """
    placed = with_ordinals(merged, result_order(spec)) if range_rules(spec) else merged.withColumn("ordinal", F.lit(0))
    return (duplicate_issues(residual_duplicates(merged, spec.keys), spec)
            .unionByName(sum_issues(reconcile(before, control_totals(merged, spec))))
            .unionByName(range_issues(range_violations(placed, spec, ["ordinal"]))))


def has_errors(issues: DataFrame) -> bool:
    """The gate: a single error anywhere blocks publication."""
    return not issues.where(F.col("severity") == "error").isEmpty()


def gated(result: DataFrame, issues: DataFrame) -> DataFrame:
    """The result if there is no error, otherwise no rows; decided inside the plan."""
    errors = issues.agg(F.count_if(F.col("severity") == "error")).scalar()
    return result.where(errors == 0)
