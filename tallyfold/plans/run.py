"""The whole job: read a folder of lists, check, consolidate, check again, publish, report."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions import exact
from tallyfold.functions.names import col
from tallyfold.operators import checks, consolidate, numbering, validate
from tallyfold.plans import publish, report
from tallyfold.session import settled, shared_dir, work_dir
from tallyfold.sources import catalog as lists
from tallyfold.sources import storage
from tallyfold.sources.catalog import PARQUET, Dialect, ListFile
from tallyfold.sources.scan import BLOCK, FILE, SEQ, UNCLOSED, scan, with_joined
from tallyfold.spec import Spec

SUMMARY_SCHEMA = (
    "spec_name string, spec_version string, started timestamp_ntz, input_dir string, output string, "
    "dry_run boolean, strict boolean, lists_found bigint, lists_processed bigint, errors bigint, "
    "warnings bigint, rows_in bigint, rows_out bigint, duplicates_merged bigint, sums_agree boolean, "
    "published boolean, status string")


@dataclass(frozen=True)
class Run:
    """What a run found out; every table is a lazy DataFrame over stored data."""

    run_id: str
    status: str
    published: bool
    run_summary: DataFrame
    list_status: DataFrame
    sum_reconciliation: DataFrame
    issues: DataFrame
    result: DataFrame | None


def run(spark: SparkSession, spec: Spec, input_dir: str, output: str | None = None, report_dir: str | None = None,
        *, strict: bool = False, dry_run: bool = False, dialect: Dialect = Dialect(),
        output_format: str = PARQUET, partition_by: Sequence[str] = ()) -> Run:
    """Consolidate all lists in ``input_dir`` into ``output``, from where ``published`` reads the result.

    Nothing is merged unless every list is free of errors, and nothing is published unless
    the merged result passes its own checks.  The report tables are written in every case.
    Without ``output``, or with ``dry_run``, the result is computed and checked only.
    """
    if set(partition_by) - set(spec.order) or set(partition_by) >= set(spec.order):
        raise ValueError(f"partition_by must name some, but not all, result columns: {list(partition_by)}")
    publish.guard_paths(spark, input_dir, output, report_dir)
    _require_ansi(spark)
    _require_distinct_names(spark, spec)
    shared_dir(spark)
    run_id, started = uuid.uuid4().hex, datetime.now(timezone.utc).replace(tzinfo=None)
    writing = output is not None and not dry_run

    files = lists.read_headers(spark, lists.discover(spark, input_dir), dialect)
    seen = _inspect(spark, files, spec, dialect, strict)
    rows_in, list_errors = seen.profile.agg(F.sum("rows")).first()[0] or 0, seen.errors

    merged, rows_out, staged = None, None, None
    if list_errors:
        issues = seen.issues.unionByName(_cell_issues(spark, seen.with_bad_cells, spec, dialect))
        nothing = validate.input_totals(seen.profile, spec).limit(0)
        reconciliation = settled(checks.reconcile(nothing, nothing))
    else:
        staged = publish.begin(spark, output, run_id) if writing else work_dir(spark, "result")
        rows = validate.typed_rows(scan(spark, seen.scanned, spec, dialect, checking=False), spec)
        spans = validate.spans(seen.profile, spec)
        try:
            merged, repeated = _staged(spark, rows, spec, staged, spans)
        except Exception:
            _abandon(spark, output, staged, writing)
            raise
        # A sum reaches higher than its addends, but no lower.
        wider = {n: (lo, min(hi + 2, exact.ALL[1])) for n, (lo, hi) in spans.items()}
        profile = settled(checks.result_profile(merged, spec, wider))
        rows_out, outside = profile.select("rows", "outside").first()
        after = validate.stacked_totals(profile, spec.columns_with("sum"))
        before = validate.input_totals(seen.profile, spec)
        if any(lo < exact.USUAL[0] or hi > exact.USUAL[1] for lo, hi in spans.values()):
            before = checks.measured_totals(rows, spec, spans)  # the checking pass kept the usual places only
        reconciliation = settled(checks.reconcile(before, after))
        issues = seen.issues
        for found in _result_issues(merged, reconciliation, outside, repeated, spec):
            issues = issues.unionByName(found)

    issues = _stored_issues(spark, issues, report_dir, run_id)
    total = report.run_status(report.issue_counts(issues)).first()
    sums_agree = None if merged is None else reconciliation.where(~F.col("passed")).isEmpty()
    published = writing and total.errors == 0
    result = None
    if published:
        _publish(spark, merged, spec, staged, output, output_format, dialect, partition_by)
        result = publish.published(spark, output)
    elif writing and staged:
        _abandon(spark, output, staged, writing)  # a result that failed its checks is not left lying about
    elif merged is not None:
        result = consolidate.presented(merged, spec)

    status = report.list_status(seen.catalog, seen.counts, seen.profile)
    if list_errors:
        status = status.join(report.first_issues(issues, spec), "list_id", "left")
    else:
        status = status.select("*", F.lit(None).cast("string").alias("first_issue"),
                               F.lit(None).cast("bigint").alias("more"))
    tables = {
        "run_summary": spark.createDataFrame([(
            spec.name, spec.version, started, input_dir, output, dry_run, strict, len(files),
            len(files) - seen.unreadable, total.errors, total.warnings, rows_in if merged else None, rows_out,
            rows_in - rows_out if merged else None, sums_agree, published, total.status)], SUMMARY_SCHEMA),
        "list_status": status,
        "sum_reconciliation": reconciliation,
    }
    if report_dir is not None:
        with ThreadPoolExecutor(len(tables)) as pool:
            stored = pool.map(lambda n: _stored_table(spark, tables[n], report_dir, n, run_id), tables)
            tables = dict(zip(tables, stored))
    return Run(run_id, total.status, published, issues=issues, result=result, **tables)


@dataclass(frozen=True)
class _Inspection:
    """What the lists look like before anything is merged."""

    catalog: DataFrame
    scanned: list[ListFile]
    profile: DataFrame
    issues: DataFrame          # about whole lists and columns
    counts: DataFrame          # (list_id, errors, warnings), cells included
    errors: int
    unreadable: int
    with_bad_cells: list[ListFile]


def _inspect(spark: SparkSession, files: list[ListFile], spec: Spec, dialect: Dialect, strict: bool) -> _Inspection:
    """One pass over all rows yields everything the gate needs.

    The profile has one row per list; it is computed once, no later step goes back to the
    rows for it, and everything derived from it is small.
    """
    files, profile = profiled(spark, files, spec, dialect)
    catalog = lists.catalog_frame(spark, files)
    scanned = [f for f in files if f.load_rule is None]
    load = settled(validate.load_issues(catalog, profile))
    readable = catalog.join(load, "list_id", "left_anti")
    columns = validate.escalate(validate.column_issues(readable, spec), strict)
    incomplete = columns.where(F.col("rule") == "missing_column")
    # Findings about columns stay distributed: their number grows with the headers' widths.
    issues = load.unionByName(columns)
    in_cells = (validate.cell_issue_counts(profile, spec)
                .join(load, "list_id", "left_anti").join(incomplete, "list_id", "left_anti")
                .groupBy("list_id").agg(F.sum("n").alias("n")))
    counts = settled(report.issue_counts(issues).withColumn("cells", F.lit(0).cast("bigint"))
              .unionByName(in_cells.select("list_id", F.col("n").alias("errors"),
                                           F.lit(0).cast("bigint").alias("warnings"), F.col("n").alias("cells")))
              .groupBy("list_id").agg(*[F.sum(c).alias(c) for c in ("errors", "warnings", "cells")]))
    failed = counts.where("errors > 0").collect()  # at most one small row per list
    bad_cells = {r.list_id for r in failed if r.cells}
    return _Inspection(catalog, scanned, profile, issues, counts.drop("cells"), sum(r.errors for r in failed),
                       load.count(), [f for f in scanned if f.list_id in bad_cells])


def profiled(spark: SparkSession, files: list[ListFile], spec: Spec,
             dialect: Dialect) -> tuple[list[ListFile], DataFrame]:
    """The lists, those marked whose records cross lines, and the profile of all readable ones.

    A line that leaves a quote open tells that its list has such records.  Only those lists are read once more, by
    records instead of lines, which are stored for that and all later scans.
    """
    files = with_joined(spark, files, dialect)
    profile = settled(validate.list_profile(scan(spark, [f for f in files if f.load_rule is None], spec, dialect), spec))
    if dialect.multiline:
        return files, profile
    crossing = {r[0] for r in profile.where(F.col(UNCLOSED) > 0).select("list_id").collect()}
    again = [replace(f, crossing=True) for f in files if f.list_id in crossing and not f.crossing]
    if not again:
        return files, profile
    again = with_joined(spark, again, dialect)
    byname = {f.list_id: f for f in again}
    seen = settled(validate.list_profile(scan(spark, again, spec, dialect), spec))
    once = profile.join(spark.createDataFrame([(n,) for n in byname], "list_id string"), "list_id", "left_anti")
    return [byname.get(f.list_id, f) for f in files], settled(once.unionByName(seen))


def _require_ansi(spark: SparkSession) -> None:
    """Sums must fail when they outgrow their type; without ANSI mode they would turn into NULL."""
    if spark.conf.get("spark.sql.ansi.enabled", "true") != "true":
        raise ValueError("control totals need spark.sql.ansi.enabled=true")


def _require_distinct_names(spark: SparkSession, spec: Spec) -> None:
    names = [n.lower() for n in spec.required]
    if len(set(names)) < len(names) and spark.conf.get("spark.sql.caseSensitive", "false") != "true":
        raise ValueError("column names differ only in case: set spark.sql.caseSensitive=true")


def _cell_issues(spark: SparkSession, files: list[ListFile], spec: Spec, dialect: Dialect) -> DataFrame:
    """Every violating cell of the given lists, with its row number."""
    rows = scan(spark, files, spec, dialect)
    found = validate.cell_issues(rows, spec, [FILE, BLOCK, SEQ])
    numbered = numbering.with_row_numbers(found, rows)
    return numbered.select(*validate.issue(lists.decoded_name(FILE), "cell", "error", F.col("rule"),
                                           F.col("column_name"), F.col("row_no"), F.col("bad_value")))


def _staged(spark: SparkSession, rows: DataFrame, spec: Spec, path: str,
            spans: consolidate.Spans) -> tuple[DataFrame, int | None]:
    """Merge, sort and write; the checks then judge exactly what would be published.

    Also tells how many of the rows written share their keys, if the sort is by keys alone; else that is not known yet.
    """
    merged, by = consolidate.grouped(rows, spec, spans), consolidate.result_order(spec)
    names, held = [col(n) for n in _stored_names(spec, merged)], None
    if set(by) == set(spec.keys):
        ordered, held = checks.sorted_and_counted(merged, spec.keys, by)
    else:
        ordered = merged.orderBy(*numbering.ascending(by))
    ordered.select(*names).write.parquet(path)
    return spark.read.parquet(storage.literal(path)), held.get["repeated"] if held else None


def _abandon(spark: SparkSession, output: str | None, staged: str, writing: bool) -> None:
    if writing:
        publish.abandon(spark, output, staged)
    else:
        storage.delete(spark, staged)


def _stored_names(spec: Spec, merged: DataFrame) -> list[str]:
    """Published columns first and in order, so that the staged table can be the published one."""
    first = [consolidate.held_as(spec, n) for n in spec.order]
    return first + [n for n in merged.columns if n not in first]


def _result_issues(merged: DataFrame, reconciliation: DataFrame, outside: int, repeated: int | None,
                   spec: Spec) -> Iterator[DataFrame]:
    """Findings about the result; the costlier lookups only where there is something to find."""
    if repeated is None or repeated:
        duplicates = checks.residual_duplicates(merged, spec.keys)
        if not duplicates.isEmpty():
            yield checks.duplicate_issues(duplicates, spec)
    yield checks.sum_issues(reconciliation)
    if outside:
        placed = merged.select("*", *numbering.stored_place())
        violations = checks.range_violations(placed, spec, ["_name", "_index"])
        yield checks.range_issues(numbering.with_stored_ordinals(placed, violations))


def _stored_issues(spark: SparkSession, issues: DataFrame, report_dir: str | None, run_id: str) -> DataFrame:
    """Issues are written once, then counted, ranked and shown from there."""
    if report_dir is None:
        return issues.checkpoint()
    return _stored_table(spark, issues, report_dir, "issues", run_id)


def _stored_table(spark: SparkSession, table: DataFrame, report_dir: str, name: str, run_id: str) -> DataFrame:
    """Append a table to the report and read this run's part of it back."""
    table.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{report_dir}/{name}")
    schema = table.schema
    # An empty partitioned table has no files to infer a schema from.
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField("run_id", T.StringType())]))
    return reader.parquet(storage.literal(f"{report_dir}/{name}")).where(F.col("run_id") == run_id).drop("run_id")


def _publish(spark: SparkSession, merged: DataFrame, spec: Spec, staged: str, output: str, kind: str,
             dialect: Dialect, partition_by: Sequence[str]) -> None:
    if kind == PARQUET and merged.columns == list(spec.order) and not partition_by:
        publish.publish(spark, output, staged, schema=merged.schema)
        return
    # The stored columns are not the published ones (a count replaces its key, a key is left
    # out, or another form is wanted): write the projection, in order, from the staged rows.
    final = f"{staged}-final"
    presented = consolidate.presented(merged.orderBy(*numbering.ascending(consolidate.result_order(spec))), spec)
    publish.write_result(presented, final, kind, dialect, partition_by=partition_by)
    publish.publish(spark, output, final, kind, presented.schema, dialect)  # clears the staged rows too
