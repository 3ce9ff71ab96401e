"""One Spark query per operator group, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold import Dialect, Spec, published, run, validate_tables
from tallyfold.operators import checks, consolidate, numbering, validate
from tallyfold.plans import publish, report
from tallyfold.plans.run import profiled
from tallyfold.session import settled, work_dir
from tallyfold.sources import catalog as lists
from tallyfold.sources import storage
from tallyfold.sources.scan import BAD_TEXT, BLOCK, FILE, MALFORMED, SEQ, UNCLOSED, cells, part_names, scan
from workloads import tables as t

PLACE = [FILE, BLOCK, SEQ]


def _double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def _merged(spec: Spec, ordered: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        result = consolidate.consolidate(t.listed(spark, folder), spec, ordered)
        return _double(result, *spec.columns_with("sum"))
    return query


consolidate_sum = _merged(t.PART_QUANTITY)
consolidate_mean = _merged(t.PART_MEAN)
consolidate_multi = _merged(t.SUPPLIER_RULES)
count_over_key = _merged(t.STATUS_COUNT)


def merge_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Two differently laid out sources, united by column name."""
    sold = t.table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("key"), F.lit("lineitem").alias("source"),
                                                      F.col("l_quantity").alias("amount"))
    kept = t.table(spark, folder, "supplier").select(F.col("s_acctbal").alias("amount"),
                                                     F.col("s_suppkey").alias("key"))
    spec = Spec("amounts", (t.Column("key", "int"), t.Column("source", "string", True),
                            t.Column("amount", "float", scale=2)), ("key", "source"), (t.Rule("amount", "sum"),),
                ("key", "source", "amount"))
    return _double(consolidate.consolidate(consolidate.merge([sold, kept]), spec, ordered=False), "amount")


def null_keys(spark: SparkSession, folder: str) -> DataFrame:
    rows = t.dirty(t.listed(spark, folder)).withColumn("n", F.col("l_orderkey"))
    return consolidate.consolidate(rows, t.MISSING_KEYS, ordered=False)


def sum_all_missing(spark: SparkSession, folder: str) -> DataFrame:
    read = cells(t.dirty(t.listed(spark, folder)), t.ALL_MISSING, names={"qty": "qty_raw", "n": "qty_raw"})
    return _double(consolidate.consolidate(validate.typed_rows(read, t.ALL_MISSING), t.ALL_MISSING, ordered=False),
                   "qty")


def ordered_result(spark: SparkSession, folder: str) -> DataFrame:
    merged = consolidate.grouped(t.listed(spark, folder), t.PART_QUANTITY)
    return _double(numbering.with_ordinals(merged, consolidate.result_order(t.PART_QUANTITY)), "l_quantity")


def sum_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    rows = t.listed(spark, folder)
    after = consolidate.consolidate(rows, t.PART_PRICE, ordered=False)
    compared = checks.reconcile(checks.control_totals(rows, t.PART_PRICE), checks.control_totals(after, t.PART_PRICE))
    return _double(compared, "sum_before", "sum_after")


def residual_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return checks.residual_duplicates(t.table(spark, folder, "lineitem"), ["l_partkey", "l_suppkey"])


def no_residual_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The same check on merged rows, where it must find nothing."""
    merged = consolidate.grouped(t.listed(spark, folder), t.PART_QUANTITY)
    return checks.residual_duplicates(merged, t.PART_QUANTITY.keys)


def range_violations(spark: SparkSession, folder: str) -> DataFrame:
    merged = consolidate.grouped(t.table(spark, folder, "customer"), t.ACCOUNT_BOUNDS)
    found = checks.range_violations(merged, t.ACCOUNT_BOUNDS, t.ACCOUNT_BOUNDS.keys)
    return found.select("c_nationkey", "c_mktsegment", "rule", "column_name",
                        F.col("bad_value").cast("double").alias("bad_value"))


def result_findings(spark: SparkSession, folder: str) -> DataFrame:
    """A result in which one nation's rows were doubled: every kind of result finding."""
    customers = t.table(spark, folder, "customer")
    merged = consolidate.grouped(customers, t.ACCOUNT_BOUNDS)
    doubled = consolidate.merge([merged, merged.where("c_nationkey = 1")])
    found = checks.check(doubled, checks.control_totals(customers, t.ACCOUNT_BOUNDS), t.ACCOUNT_BOUNDS)
    return found.drop("list_id")


def _dirty_cells(spark: SparkSession, folder: str, clean_until: int = 0) -> DataFrame:
    return cells(t.dirty(t.listed(spark, folder), clean_until), t.DIRTY, ["list_id", *PLACE])


def _dirty_issues(spark: SparkSession, folder: str, clean_until: int = 0) -> DataFrame:
    """All cell findings, by year list, with rows numbered as stored."""
    read = _dirty_cells(spark, folder, clean_until)
    found = numbering.with_row_numbers(validate.cell_issues(read, t.DIRTY, ["list_id", *PLACE]), read)
    return found.select(*validate.issue(F.col("list_id"), "cell", "error", F.col("rule"), F.col("column_name"),
                                        F.col("row_no"), F.col("bad_value")))


def null_violations(spark: SparkSession, folder: str) -> DataFrame:
    found = validate.cell_issues(_dirty_cells(spark, folder), t.DIRTY, ["list_id"])
    return (found.where("rule = 'missing_value'").groupBy("list_id", "column_name")
            .agg(F.count(F.lit(1)).alias("n")))


def type_violations(spark: SparkSession, folder: str) -> DataFrame:
    found = validate.cell_issues(_dirty_cells(spark, folder), t.DIRTY, ["list_id"])
    return (found.where("rule = 'wrong_type'").groupBy("list_id", "column_name", "bad_value")
            .agg(F.count(F.lit(1)).alias("n")))


def issue_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _dirty_issues(spark, folder)


def _dirty_profile(spark: SparkSession, folder: str, clean_until: int = 0) -> DataFrame:
    """What one pass tells about the year lists: rows and violations of each, one row per list."""
    rows = t.dirty(t.listed(spark, folder), clean_until).withColumns(
        {FILE: F.col("list_id"), **{c: F.lit(False) for c in (MALFORMED, BAD_TEXT, UNCLOSED)}})
    return settled(validate.list_profile(cells(rows, t.DIRTY, [FILE, MALFORMED, BAD_TEXT, UNCLOSED]), t.DIRTY))


def _counts(profile: DataFrame, catalog: DataFrame) -> DataFrame:
    """Errors and warnings per list, in its cells and its header."""
    in_cells = validate.cell_issue_counts(profile, t.DIRTY).select(
        "list_id", F.col("n").alias("errors"), F.lit(0).cast("bigint").alias("warnings"))
    in_headers = report.issue_counts(validate.column_issues(catalog, t.DIRTY))
    return in_cells.unionByName(in_headers).groupBy("list_id").agg(
        F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"))


def list_status(spark: SparkSession, folder: str) -> DataFrame:
    profile = _dirty_profile(spark, folder, clean_until=1997)
    catalog = t.header(profile, 1996)
    return report.list_status(catalog, _counts(profile, catalog), profile)


def first_issues(spark: SparkSession, folder: str) -> DataFrame:
    return report.first_issues(_dirty_issues(spark, folder), t.DIRTY)


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    profile = _dirty_profile(spark, folder)
    found = profile.agg(F.count(F.lit(1)).alias("lists_found"), F.sum("rows").alias("rows_in"))
    status = report.run_status(_counts(profile, t.header(profile, 1996)))
    return status.select("*", found.select("lists_found").scalar().alias("lists_found"),
                         found.select("rows_in").scalar().alias("rows_in"))


def _warnings(spark: SparkSession, folder: str, strict: bool) -> DataFrame:
    found = validate.column_issues(t.header(t.listed(spark, folder), 1996), t.DIRTY)
    return validate.escalate(found, strict)


def strict_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Unknown columns block the result in strict mode."""
    return checks.gated(consolidate_sum(spark, folder), _warnings(spark, folder, strict=True))


def open_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The same warnings let it pass otherwise."""
    return checks.gated(consolidate_sum(spark, folder), _warnings(spark, folder, strict=False))


def blocked_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Cell errors always block."""
    return checks.gated(consolidate_sum(spark, folder), _dirty_issues(spark, folder))


def date_coercion(spark: SparkSession, folder: str) -> DataFrame:
    iso = F.col("l_orderkey") % 2 == 0
    rows = t.listed(spark, folder).select(
        "list_id", F.when(iso, F.date_format("l_shipdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("l_shipdate", "dd.MM.yyyy")).alias("day"),
        F.when(F.col("l_linenumber") == 1, "1e0").when(iso, F.concat(F.col("l_linenumber").cast("string"), F.lit(".0")))
        .when(F.col("l_linenumber") == 2, "2.5").otherwise(F.col("l_linenumber").cast("string")).alias("line"))
    read = cells(rows, t.SHIPPING, ["list_id"])
    (day, _, _), (line, missing, _) = (part_names(t.SHIPPING, n) for n in t.SHIPPING.required)
    return read.groupBy("list_id").agg(
        F.min(day).cast("string").alias("first_day"), F.max(day).cast("string").alias("last_day"),
        F.sum(line).alias("lines"), F.count_if(~F.col(missing) & F.col(line).isNull()).alias("bad_lines"))


# -- real files ---------------------------------------------------------------------------


def _permuted(rows: DataFrame, names: tuple[str, ...]) -> list[DataFrame]:
    """The same rows as lists with two headers: as declared, and reversed with a column too many."""
    even = F.year("l_shipdate") % 2 == 0
    return [rows.where(even).select(*names),
            rows.where(~even).select(F.col("l_comment"), *reversed(names))]


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    rows = t.listed(spark, folder).withColumn("l_comment", F.concat_ws('";', "l_returnflag", "l_shipdate"))
    path = t.csv_folder(spark, _permuted(rows, t.PART_QUANTITY.required))
    files = lists.read_headers(spark, lists.discover(spark, path))
    read = validate.typed_rows(scan(spark, files, t.PART_QUANTITY, checking=False), t.PART_QUANTITY)
    return _double(consolidate.consolidate(read, t.PART_QUANTITY, ordered=False), "l_quantity")


def decimal_comma(spark: SparkSession, folder: str) -> DataFrame:
    german = Dialect(decimal=",")
    rows = t.listed(spark, folder).select("l_partkey", "l_linestatus", F.replace(
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")).alias("l_extendedprice"))
    files = lists.read_headers(spark, lists.discover(spark, t.csv_folder(spark, [rows], german)), german)
    read = validate.typed_rows(scan(spark, files, t.PART_PRICE, german, checking=False), t.PART_PRICE)
    return _double(consolidate.consolidate(read, t.PART_PRICE, ordered=False), "l_extendedprice")


def column_conformance(spark: SparkSession, folder: str) -> DataFrame:
    """Lists with altered headers, by year: which findings, and how many records they concern."""
    rows, (part, status, quantity) = t.listed(spark, folder), t.PART_QUANTITY.required
    year = F.year("l_shipdate")
    path = t.csv_folder(spark, [
        rows.where(year == 1995).select(part, status, quantity, F.col("l_returnflag").alias("note")),
        rows.where(year == 1996).select(part, status),
        rows.where(year == 1997).select(part, status, quantity, F.col(part).alias(f" {part} ")),
        rows.where(year >= 1998).select(quantity, F.col(status).alias(f" {status}"), part)])
    files = lists.read_headers(spark, lists.discover(spark, path))
    catalog = lists.catalog_frame(spark, files)
    profile = validate.list_profile(scan(spark, [f for f in files if not f.load_rule], t.PART_QUANTITY),
                                    t.PART_QUANTITY)
    load = validate.load_issues(catalog)
    issues = load.unionByName(validate.column_issues(catalog.join(load, "list_id", "left_anti"), t.PART_QUANTITY))
    return (issues.join(profile.select("list_id", "rows"), "list_id", "left")
            .groupBy("level", "severity", "rule", "column_name")
            .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("records")))


def csv_defects(spark: SparkSession, folder: str) -> DataFrame:
    """Unreadable lists of several kinds: which rule, and how many records are at fault."""
    rows, names = t.listed(spark, folder), t.PART_QUANTITY.required
    year, line = F.year("l_shipdate"), F.concat_ws(";", *names)
    path = t.csv_folder(spark, [rows.where(year >= 1998).select(*names)])

    def add(variant: DataFrame, **options) -> None:
        variant.write.mode("append").options(header=True, **options).csv(path)

    umlaut = F.when(F.col("l_orderkey") % 5 == 0, "ü").otherwise(F.col("l_linestatus")).alias("l_linestatus")
    add(rows.where(year == 1995).select("l_partkey", umlaut, "l_quantity"), sep=";", encoding="ISO-8859-1")
    ragged = F.when(F.col("l_orderkey") % 7 == 0, F.concat(line, F.lit(";x"))).when(
        F.col("l_orderkey") % 7 == 1, F.concat_ws(";", "l_partkey", "l_linestatus")).otherwise(line)
    add(rows.where(year == 1996).select(ragged.alias(";".join(names))), sep="\u0001", quote="\u0002")
    add(rows.where(year == 1997).select(*names), sep=",")
    rows.limit(0).select(*names).coalesce(1).write.mode("append").option("header", False).csv(path)

    files = lists.read_headers(spark, lists.discover(spark, path))
    profile = validate.list_profile(scan(spark, [f for f in files if not f.load_rule], t.PART_QUANTITY),
                                    t.PART_QUANTITY)
    found = validate.load_issues(lists.catalog_frame(spark, files), profile)
    return (found.join(profile.select("list_id", (F.col(MALFORMED) + F.col(BAD_TEXT)).alias("n")), "list_id", "left")
            .groupBy("rule").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records")))


def _lists_to_run(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> str:
    rows = t.listed(spark, folder) if rows is None else rows
    rows = rows.withColumn("l_comment", F.col("l_returnflag"))
    return t.csv_folder(spark, _permuted(rows, t.PART_QUANTITY.required))


def gated_run(spark: SparkSession, folder: str) -> DataFrame:
    """The whole job on delimited lists; what it published."""
    outcome = run(spark, t.PART_QUANTITY, _lists_to_run(spark, folder), work_dir(spark, "out") + "/result",
                  work_dir(spark, "report"))
    return _double(outcome.result, "l_quantity")


def gated_run_report(spark: SparkSession, folder: str) -> DataFrame:
    """The summary of a whole job that must fail: some quantities are no numbers."""
    bad = F.when(F.col("l_orderkey") % 97 == 0, "not_a_number").otherwise(F.col("l_quantity").cast("string"))
    path = _lists_to_run(spark, folder, t.listed(spark, folder).withColumn("l_quantity", bad))
    outcome = run(spark, t.PART_QUANTITY, path, work_dir(spark, "out") + "/result", work_dir(spark, "report"))
    cells_found = outcome.issues.where("level = 'cell'").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("list_id", "row_no").alias("places"))
    return outcome.run_summary.select(
        "status", "published", "errors", F.col("rows_out").isNull().alias("nothing_merged"),
        cells_found.select("n").scalar().alias("cell_issues"), cells_found.select("places").scalar().alias("places"))


def quoted_line_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Whole job on lists of several splits, some of which hold line breaks in quoted fields."""
    key = F.col("l_orderkey")
    note = (F.when(key % 7 == 0, F.concat("l_linestatus", F.lit('\n"'), "l_returnflag", F.lit("\n\n;")))
            .otherwise(F.col("l_linestatus")))
    rows, year = t.listed(spark, folder).withColumn("note", note), F.year("l_shipdate")
    path = t.csv_folder(spark, [rows.where(year <= 1995).select("l_partkey", "l_quantity", "note"),
                                rows.where((year > 1995) & (key % 7 != 0)).select(*t.NOTED.required),
                                rows.where((year > 1995) & (key % 7 == 0)).select("note", "l_partkey", "l_quantity")])
    outcome = run(t.split_session(spark, path), t.NOTED, path, work_dir(spark, "out") + "/result")
    return _double(outcome.result, "l_quantity")


def many_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of twelve widths and orders of columns, read in one scan."""
    rows, names = t.listed(spark, folder), t.PART_QUANTITY.required
    lists_of = []
    for i in range(12):
        order = [*names[i % 3:], *names[:i % 3]]
        order[i % 4:i % 4] = [F.lit(k).alias(f"unknown{k}") for k in range(i)]
        lists_of.append(rows.where(F.pmod("l_orderkey", F.lit(12)) == i).select(*order))
    files = lists.read_headers(spark, lists.discover(spark, t.csv_folder(spark, lists_of)))
    read = validate.typed_rows(scan(spark, files, t.PART_QUANTITY, checking=False), t.PART_QUANTITY)
    return _double(consolidate.consolidate(read, t.PART_QUANTITY, ordered=False), "l_quantity")


def wide_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of 30,000 fields next to good lists: which lists are refused, and what the others hold."""
    rows, names = t.listed(spark, folder), t.PART_QUANTITY.required
    fill = F.array_join(F.array_repeat(F.lit("x"), 30_000), ";")
    line = F.concat_ws(";", *names)
    broken = F.col("l_orderkey") % 500 == 0
    wide = F.when(broken, F.concat_ws(";", line, fill)).otherwise(line)
    # A list is refused for its wide records, so each of them has some.
    monsters = t.each_with(rows.where(F.year("l_shipdate") == 1996), broken).select(wide.alias(";".join(names)))
    path = t.csv_folder(spark, [rows.where(F.year("l_shipdate") != 1996).select(*names)])
    monsters.write.mode("append").options(header=True, sep="\u0001", quote="\u0002").csv(path)
    files, profile = profiled(spark, lists.read_headers(spark, lists.discover(spark, path)), t.PART_QUANTITY, Dialect())
    refused = validate.load_issues(lists.catalog_frame(spark, files), profile)
    return (profile.join(refused.select("list_id", "rule"), "list_id", "left").groupBy("rule")
            .agg(F.sum("rows").alias("records"), F.sum(MALFORMED).alias("broken")))


def mixed_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Whole job on delimited and stored lists in one folder, the latter with other types and columns."""
    rows, year, (part, status, quantity) = t.listed(spark, folder), F.year("l_shipdate"), t.PART_QUANTITY.required
    path = t.csv_folder(spark, [rows.where(year % 3 == 0).select(*t.PART_QUANTITY.required)])
    for kept in (rows.where(year % 3 == 1).select(quantity, status, part),
                 rows.where(year % 3 == 2).select(F.col(part).cast("string").alias(f" {part}"), "l_shipdate", status,
                                                  F.col(quantity).cast("decimal(9,3)").alias(quantity))):
        kept.write.mode("append").parquet(path)
    outcome = run(spark, t.PART_QUANTITY, path, work_dir(spark, "out") + "/result")
    return _double(outcome.result, "l_quantity")


def split_row_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of delimited lists of many splits, with exact row numbers."""
    order = ("l_orderkey", "l_partkey", "l_linestatus", "l_quantity")
    rows = t.dirty(t.listed(spark, folder))
    named = {n: df.select(*t.DIRTY.required) for n, df in t.by_year(rows, order).items()}
    path = t.named_lists(spark, named, "text")
    session = t.split_session(spark, path)
    files = lists.read_headers(session, lists.discover(session, path))
    read = scan(session, files, t.DIRTY)
    found = numbering.with_row_numbers(validate.cell_issues(read, t.DIRTY, PLACE), read)
    return found.select(F.col(FILE).alias("list_id"), "rule", "column_name", "row_no", "bad_value")


def name_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Column names in decomposed and padded form, and suffixes in any case, are the same names and lists."""
    rows, year = t.listed(spark, folder), F.year("l_shipdate")
    spec = Spec("named", (t.Column("Stückzahl", "float", scale=2), t.Column("l_linestatus", "string")),
                ("l_linestatus",), (t.Rule("Stückzahl", "sum"),), ("l_linestatus", "Stückzahl"))
    path = t.named_lists(spark, {
        name: rows.where(years).select("l_linestatus", F.col("l_quantity").alias(column)).coalesce(1)
        for name, years, column in (("one.CSV", year < 1995, "Stu\u0308ckzahl"), ("two.Csv", year == 1995, "  Stückzahl "),
                                    ("three.csv", year > 1995, "Stückzahl"), ("four.txt", year > 0, "Stückzahl"))})
    outcome = run(spark, spec, path)
    return outcome.result.select("l_linestatus", F.col("Stückzahl").cast("double").alias("total"))


def bounds_on_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds concern merged values; a count that replaced its column has none."""
    merged = consolidate.grouped(t.table(spark, folder, "customer"), t.COUNT_BOUNDS)
    found = checks.range_violations(merged, t.COUNT_BOUNDS, t.COUNT_BOUNDS.keys)
    return found.select("c_nationkey", "rule", "column_name", F.col("bad_value").cast("double").alias("bad_value"))


def run_modes(spark: SparkSession, folder: str) -> DataFrame:
    """What a run says and does when warnings are errors, when it is dry, and when a list lacks a column."""
    rows, names = t.listed(spark, folder), t.PART_QUANTITY.required
    year, found = F.year("l_shipdate"), []
    noted = t.csv_folder(spark, [rows.where(year < 1997).select(*names)])
    t.named_lists(spark, {"noted.csv": rows.where(year >= 1997).select(*names, F.col("l_tax").alias("note"))}, "text", noted)
    # Cells of a list without a required column are not looked at: none of its bad ones is a finding.
    lacking = t.named_lists(spark, {
        "whole.csv": rows.where(year < 1997).select(*names),
        "lacking.csv": rows.where(year >= 1997).select("l_linestatus", F.lit("x").alias("l_quantity"))}, "text")
    for mode, path, options in (("open", noted, {}), ("strict", noted, {"strict": True}), ("dry", noted, {"dry_run": True}),
                                ("lacking", lacking, {})):
        target = work_dir(spark, "out") + "/result"
        outcome = run(spark, t.PART_QUANTITY, path, target, **options)
        found.append(outcome.run_summary.select(
            F.lit(mode).alias("mode"), "status", "published", "errors", "warnings", "rows_in", "rows_out", "sums_agree",
            F.lit(storage.exists(spark, target)).alias("written")))
    return consolidate.merge(found)


def republish(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs on one target; between them a version that was never finished.  What readers see after that."""
    rows, target = t.listed(spark, folder), work_dir(spark, "out") + "/result"
    for kept in (F.year("l_shipdate") <= 1995, F.lit(True)):
        run(spark, t.PART_QUANTITY, _lists_to_run(spark, folder, rows.where(kept)), target)
        rows.select("l_tax").write.parquet(publish.begin(spark, target, "unfinished"), mode="overwrite")
    return _double(published(spark, target), "l_quantity")


def partitioned_run(spark: SparkSession, folder: str) -> DataFrame:
    """Whole job with a result that is stored by one of its columns, as delimited text."""
    outcome = run(spark, t.PART_QUANTITY, _lists_to_run(spark, folder), work_dir(spark, "out") + "/result",
                  output_format="csv", partition_by=["l_linestatus"])
    return outcome.result.select(F.col("l_partkey").cast("bigint").alias("l_partkey"), "l_linestatus",
                                 F.col("l_quantity").cast("double").alias("l_quantity"))


def sums_of_any_size(spark: SparkSession, folder: str) -> DataFrame:
    """Whole job on numbers from 1e-31 to 1e23, of which the large ones cancel out in one kind of group."""
    rows = t.listed(spark, folder).select("l_linestatus", "l_partkey", "l_quantity")
    huge, tiny = F.col("l_quantity") * F.lit(2.0 ** 70), F.col("l_quantity") * F.lit(2.0 ** -100)
    path = t.csv_folder(spark, [rows.select("l_partkey", F.lit(kind).alias("kind"), amount.alias("amount"))
                                for kind, amount in (("cancel", huge), ("cancel", tiny), ("cancel", -huge), ("huge", huge),
                                                     ("tiny", tiny))])
    outcome = run(spark, t.ANY_SIZE, path, work_dir(spark, "out") + "/result")
    agreed = outcome.sum_reconciliation.agg(F.bool_and("passed")).scalar()
    return outcome.result.select("*", agreed.alias("agreed"))


def totals_beyond_1e20(spark: SparkSession, folder: str) -> DataFrame:
    """Control totals of some 1e27, exact to two decimals, before and after."""
    rows = t.listed(spark, folder).select("l_partkey", "l_linestatus", (
        F.col("l_extendedprice").cast("decimal(18,2)") * F.lit(10 ** 16).cast("decimal(17,0)")
        + F.lit("0.01").cast("decimal(2,2)")).cast("decimal(38,2)").alias("l_extendedprice"))
    after = consolidate.consolidate(rows, t.PART_PRICE, ordered=False)
    compared = checks.reconcile(checks.control_totals(rows, t.PART_PRICE), checks.control_totals(after, t.PART_PRICE))
    return compared.withColumns({c: F.col(c).cast("string") for c in ("sum_before", "sum_after")})


def validated_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables checked where they are: which findings, how often, and what the good tables add up to."""
    rows = t.listed(spark, folder)
    dirty, year = t.dirty(rows).select("linestatus", "qty_raw", "l_shipdate"), F.year("l_shipdate")
    found = validate_tables({
        "dirty": dirty.where(year < 1996).drop("l_shipdate"),
        "clean": rows.where(year == 1996).select(F.col("l_linestatus").alias(" linestatus"), F.col("l_quantity").alias("qty_raw")),
        "noted": dirty.where(year == 1997).dropna().where("qty_raw <> 'not_a_number'"),
        "lacking": dirty.where(year > 1997).select("linestatus")}, t.DIRTY)
    good = consolidate.consolidate(found.valid, t.DIRTY, ordered=False).agg(F.sum("qty_raw").cast("double")).scalar()
    counts = found.issues.groupBy("list_id", "rule", "column_name").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("*", good.alias("good_total"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "consolidate_sum": consolidate_sum, "consolidate_mean": consolidate_mean, "consolidate_multi": consolidate_multi,
    "count_over_key": count_over_key,
    **{f.__name__: f for f in (
        merge_tables, null_keys, sum_all_missing, ordered_result, sum_reconciliation, residual_duplicates,
        no_residual_duplicates, range_violations, result_findings, null_violations, type_violations, issue_rows, list_status,
        first_issues, run_summary, strict_gate, open_gate, blocked_gate, date_coercion, csv_roundtrip, decimal_comma,
        column_conformance, csv_defects, gated_run, gated_run_report, quoted_line_breaks, many_headers, wide_records,
        mixed_formats, split_row_numbers, name_forms, bounds_on_counts, run_modes, republish,
        partitioned_run, sums_of_any_size, totals_beyond_1e20,
        validated_tables)}}
