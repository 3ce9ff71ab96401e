"""The run report as tables: list status, run summary, sum reconciliation and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.spec import Spec

# States of a list and of a run.
LIST_OK, LIST_WARNING, LIST_ERROR = "ok", "warning", "error"
RUN_SUCCESS, RUN_WARNINGS, RUN_ERROR = "success", "success_with_warnings", "error"


def message() -> Column:
    """A readable sentence for an issue row."""
    where = F.concat(F.when(F.col("column_name").isNotNull(), F.format_string("column '%s'", "column_name")),
                     F.when(F.col("row_no").isNotNull(), F.format_string(", row %d", "row_no")).otherwise(F.lit("")),
                     F.lit(": "))
    what = F.replace("rule", F.lit("_"), F.lit(" "))
    value = F.when(F.col("bad_value").isNotNull(), F.format_string(" '%s'", "bad_value"))
    return F.concat(F.coalesce(where, F.lit("")), what, F.coalesce(value, F.lit("")))


def issue_counts(issues: DataFrame) -> DataFrame:
    """Errors and warnings per list: (list_id, errors, warnings)."""
    return issues.groupBy("list_id").agg(F.count_if(F.col("severity") == "error").alias("errors"),
                                         F.count_if(F.col("severity") == "warning").alias("warnings"))


def list_status(catalog: DataFrame, counts: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per list of the catalog, also for empty and unreadable ones.

    ``rows`` is (list_id, rows); the number is only given for lists without errors.
    """
    known = (catalog.select("list_id").join(counts.where("list_id is not null"), "list_id", "left")
             .join(rows.select("list_id", "rows"), "list_id", "left"))
    errors, warnings = (F.coalesce(F.col(c), F.lit(0)) for c in ("errors", "warnings"))
    status = F.when(errors > 0, LIST_ERROR).when(warnings > 0, LIST_WARNING).otherwise(LIST_OK)
    return known.select("list_id", F.when(errors == 0, F.coalesce("rows", F.lit(0))).alias("rows"),
                        errors.alias("errors"), warnings.alias("warnings"), status.alias("status"))


def first_issues(issues: DataFrame, spec: Spec) -> DataFrame:
    """The first error of each list and how many more there are: (list_id, first_issue, more).

    First means lowest row, then column order of the spec; both fit one number, so finding
    it is a plain numeric minimum that collapses before the shuffle however many issues one
    list has.  Only the winners' texts are then looked up.
    """
    width = len(spec.required) * 4
    names = F.array(*[F.lit(n) for n in spec.required])
    place = F.coalesce(F.array_position(names, F.col("column_name")), F.lit(0)) * 2 + (
        F.col("rule") == "wrong_type").cast("int")
    placed = (issues.where((F.col("severity") == "error") & F.col("list_id").isNotNull())
              .withColumn("_at", F.coalesce("row_no", F.lit(0)) * width + place))
    firsts = placed.groupBy("list_id").agg(F.min("_at").alias("_at"), (F.count(F.lit(1)) - 1).alias("more"))
    # Whole-column findings may share a place (several unknown columns in strict mode).
    return (placed.join(firsts, ["list_id", "_at"])
            .groupBy("list_id", "more").agg(F.min(message()).alias("first_issue"))
            .select("list_id", "first_issue", "more"))


def run_status(issues_or_counts: DataFrame) -> DataFrame:
    """(errors, warnings, status) of the whole run from per-list counts."""
    total = issues_or_counts.agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
                                 F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"))
    status = (F.when(F.col("errors") > 0, RUN_ERROR).when(F.col("warnings") > 0, RUN_WARNINGS)
              .otherwise(RUN_SUCCESS))
    return total.withColumn("status", status)
