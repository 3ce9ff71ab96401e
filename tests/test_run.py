import os
import shutil

import pytest
from conftest import base_spec, rows

from tallyfold import Bounds, Column, Dialect, InputError, Rule, published, run
from tallyfold.plans import publish

HEAD = "berth;hydrant;opened;cubic\n"
SPRING = HEAD + "east;4;2;31.5\nnorth;1;;8.125\neast;4;3;0.25\n"
# Another order of columns, and one column that nobody asked for.
AUTUMN = "hydrant;inspector;cubic;berth;opened\n4;Ito;6.0;east;1\n2;Diaz;640;west;7\n4;Ito;1.25;north;2\n"
# Worked out by hand: hydrant 4 east gave 31.5 + 0.25 + 6 in 2 + 3 + 1 openings.
MERGED = [(1, "north", 8.125, 0), (2, "west", 640.0, 7), (4, "east", 37.75, 6), (4, "north", 1.25, 2)]


def issues(outcome):
    return sorted(rows(outcome.issues, "list_id", "severity", "rule", "column_name", "row_no", "bad_value"), key=str)


def test_whole_run(spark, folder, spec, tmp_path):
    path, out, report = folder({"spring.csv": SPRING, "autumn.csv": AUTUMN}), tmp_path / "out", tmp_path / "rep"
    first = run(spark, spec, path, str(out / "result"), str(report))
    assert first.status == "success_with_warnings" and first.published
    assert rows(published(spark, str(out / "result"))) == MERGED == rows(first.result)
    assert sorted(rows(first.sum_reconciliation)) == [("cubic", 687.13, 687.13, True, 6, 4, 2),
                                                      ("opened", 15.0, 15.0, True, 6, 4, 2)]
    assert issues(first) == [("autumn.csv", "warning", "unknown_column", "inspector", None, None)]
    assert sorted(rows(first.list_status, "list_id", "rows", "errors", "warnings", "status")) == [
        ("autumn.csv", 3, 0, 1, "warning"), ("spring.csv", 3, 0, 0, "ok")]
    s = first.run_summary.first()
    assert (s.lists_found, s.lists_processed, s.rows_in, s.rows_out, s.duplicates_merged, s.sums_agree) == (
        2, 2, 6, 4, 2, True)

    strict = run(spark, spec, path, str(out / "result"), str(report), strict=True)
    assert strict.status == "error" and not strict.published and strict.result is None
    assert rows(published(spark, str(out / "result"))) == MERGED          # the earlier result stays
    assert rows(strict.list_status.where("errors > 0"), "list_id", "rows", "first_issue", "more") == [
        ("autumn.csv", None, "column 'inspector': unknown column", 0)]
    # Both runs are in the report, told apart by their id.
    assert spark.read.parquet(str(report / "run_summary")).count() == 2
    assert sorted(os.listdir(out)) == ["result"]                            # no staging left behind


def test_publishing_replaces_only_what_was_published(spark, folder, spec, tmp_path):
    path, out = folder({"a.csv": SPRING}), tmp_path / "result"
    out.mkdir()                                                              # an empty folder may be used
    run(spark, spec, path, str(out))
    again = run(spark, spec, folder({"a.csv": HEAD + "z;9;1;1\n"}), str(out))
    assert again.status == "success" and rows(published(spark, str(out))) == [(9, "z", 1.0, 1)]
    for name, make in (("foreign", lambda p: (p.mkdir(), (p / "kept.txt").write_text("x"))),
                       ("file", lambda p: p.write_text("x"))):
        make(tmp_path / name)
        with pytest.raises(InputError, match="was not published by this engine"):
            run(spark, spec, path, str(tmp_path / name))
    assert (tmp_path / "foreign" / "kept.txt").read_text() == "x" == (tmp_path / "file").read_text()


@pytest.fixture
def folder_of(tmp_path):
    """A list below ``tmp_path/at``."""
    def make(at):
        (tmp_path / at).mkdir(parents=True)
        (tmp_path / at / "a.csv").write_text(SPRING)
        return str(tmp_path / at)
    return make


@pytest.mark.parametrize("source, output, report", [
    ("x/lists", "x", None), ("x/lists", "x/lists", None), ("x/lists", "x/lists/result", None),
    ("x/lists", "out", "out/report"), ("x/lists", "out", "out"), ("x/lists", "rep/out", "rep"),
    ("x/lists", None, "x"), ("x/lists", "out", "x/lists/report"), ("x/lists", "out", "x")])
def test_folders_in_each_other_are_refused_and_nothing_is_lost(spark, folder_of, spec, tmp_path, source, output, report):
    path = folder_of(source)
    before = sorted(str(p) for p in tmp_path.rglob("*"))
    with pytest.raises(InputError, match="must not lie in each other"):
        run(spark, spec, path, output and f"file:{tmp_path}/{output}", report and str(tmp_path / report))
    assert sorted(str(p) for p in tmp_path.rglob("*")) == before
    publish.guard_paths(spark, path, path + "_result", path + "_report")


def test_totals_never_pass_without_ansi_mode(spark, folder, spec, tmp_path):
    path = folder({"a.csv": SPRING})
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(ValueError, match="ansi"):
            run(spark, spec, path, str(tmp_path / "result"))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
    assert not (tmp_path / "result").exists()


def test_totals_beyond_64_bits(spark, folder, spec, tmp_path):
    lines = "".join(f"b{i};{i};{9 * 10**18};0.5\n" for i in range(12))
    outcome = run(spark, spec, folder({"a.csv": HEAD + lines}), str(tmp_path / "result"))
    assert outcome.status == "success" and outcome.result.count() == 12
    assert sorted((r.column_name, int(r.sum_after), r.passed) for r in outcome.sum_reconciliation.collect()) == [
        ("cubic", 6, True), ("opened", 108 * 10**18, True)]


def test_dry_run_writes_only_the_report(spark, folder, spec, tmp_path):
    outcome = run(spark, spec, folder({"a.csv": SPRING}), str(tmp_path / "result"), str(tmp_path / "rep"), dry_run=True)
    assert outcome.status == "success" and not outcome.published and not (tmp_path / "result").exists()
    assert outcome.result.count() == 2 and outcome.run_summary.first().dry_run
    assert sorted(os.listdir(tmp_path / "rep")) == ["issues", "list_status", "run_summary", "sum_reconciliation"]


def test_every_kind_of_finding_in_one_pass(spark, folder, spec, tmp_path):
    path = folder({
        "good.csv": SPRING,
        "three_missing.csv": "berth;tide\nx;y\n",
        "cells.csv": HEAD + "east;4;2;a lot\n;four;;2.5\nwest;4;1.5;n/a\n",
        "broken.csv": SPRING + "w;1;2;3;4;5\n",
        "empty.csv": b"",
        "header.csv": "cubic;opened;hydrant;berth\n",
    })
    outcome = run(spark, spec, path, str(tmp_path / "result"))
    assert outcome.status == "error" and not (tmp_path / "result").exists()
    assert issues(outcome) == sorted([
        ("broken.csv", "error", "malformed_record", None, None, None),
        ("empty.csv", "error", "empty_file", None, None, None),
        ("three_missing.csv", "error", "missing_column", "hydrant", None, None),
        ("three_missing.csv", "error", "missing_column", "opened", None, None),
        ("three_missing.csv", "error", "missing_column", "cubic", None, None),
        ("three_missing.csv", "warning", "unknown_column", "tide", None, None),
        ("cells.csv", "error", "wrong_type", "cubic", 2, "a lot"),
        ("cells.csv", "error", "missing_value", "berth", 3, None),
        ("cells.csv", "error", "wrong_type", "hydrant", 3, "four"),
        ("cells.csv", "error", "wrong_type", "opened", 4, "1.5"),
        ("cells.csv", "error", "missing_value", "cubic", 4, None)], key=str)
    status = {r.list_id: r for r in outcome.list_status.collect()}
    assert len(status) == 6 and status["header.csv"].status == "ok" and status["header.csv"].rows == 0
    assert (status["cells.csv"].errors, status["cells.csv"].more, status["cells.csv"].first_issue) == (
        5, 4, "column 'cubic', row 2: wrong type 'a lot'")
    s = outcome.run_summary.first()
    assert (s.lists_found, s.lists_processed, s.errors, s.warnings, s.rows_out) == (6, 4, 10, 1, None)


def test_nothing_but_headers_is_a_valid_empty_result(spark, folder, spec, tmp_path):
    outcome = run(spark, spec, folder({"a.csv": HEAD}), str(tmp_path / "result"))
    assert outcome.status == "success" and outcome.result.count() == 0
    assert sorted(rows(outcome.sum_reconciliation)) == [("cubic", 0.0, 0.0, True, 0, 0, 0),
                                                        ("opened", 0.0, 0.0, True, 0, 0, 0)]


def test_all_lists_unreadable(spark, folder, spec, tmp_path):
    outcome = run(spark, spec, folder({"a.csv": b"", "b.csv": "x,y\n1,2\n"}), str(tmp_path / "result"))
    assert outcome.status == "error" and outcome.run_summary.first().lists_processed == 0


def test_result_out_of_bounds_is_not_published(spark, folder, tmp_path):
    spec = base_spec(bounds={"cubic": Bounds(min=-4, max=70)})
    text = HEAD + "a;1;1;20\na;1;1;55\nb;2;1;-3\nb;2;1;-2\nc;3;1;70\n"
    outcome = run(spark, spec, folder({"a.csv": text}), str(tmp_path / "result"), str(tmp_path / "rep"))
    assert outcome.status == "error" and not outcome.published and sorted(os.listdir(tmp_path)) == ["in", "rep"]
    found = rows(outcome.issues, "rule", "column_name", "row_no", "bad_value")
    assert sorted((r, c, n, float(v)) for r, c, n, v in found) == [
        ("above_max", "cubic", 2, 75.0), ("below_min", "cubic", 3, -5.0)]
    assert [r.status for r in outcome.list_status.collect()] == ["ok"]       # the list itself is fine
    s = outcome.run_summary.first()
    assert (s.rows_in, s.rows_out, s.sums_agree) == (5, 3, True)


def test_count_over_key_and_csv_output(spark, folder, tmp_path):
    spec = base_spec(rules=(Rule("berth", "count"), Rule("cubic", "sum")), order=("cubic", "hydrant", "berth"),
                     sort_by=("berth",), bounds={})
    path = folder({"a.csv": SPRING, "b.csv": AUTUMN})
    expected = [(1.25, 4, 1), (8.125, 1, 1), (37.75, 4, 3), (640.0, 2, 1)]
    stored = run(spark, spec, path, str(tmp_path / "p"))
    assert sorted(rows(stored.result)) == expected and rows(stored.result)[-1] == (37.75, 4, 3)
    text = run(spark, spec, path, str(tmp_path / "c"), output_format="csv")
    assert sorted((float(a), int(b), int(c)) for a, b, c in rows(text.result)) == expected
    lines = [x for f in sorted((tmp_path / "c").glob("v-*/part-*")) for x in f.read_text().splitlines()]
    assert "37.75;4;3" in lines and lines[0] == "cubic;hydrant;berth"


def test_decimal_comma_and_dates(spark, folder, tmp_path):
    spec = base_spec(columns=(Column("day", "date", formats=("dd/MM/yyyy",)), Column("crew", "int", True),
                              Column("fee", "float", scale=2)), keys=("day",),
                     rules=(Rule("crew", "sum"), Rule("fee", "mean")), order=("day", "crew", "fee"),
                     sort_by=(), bounds={"fee": Bounds(max=8)})
    path = folder({"a.csv": "day;crew;fee\n29/02/2020;5,00;7,25\n29/02/2020;;8,75\n01/12/2020;2e0001;0,5\n"})
    outcome = run(spark, spec, path, str(tmp_path / "result"), dialect=Dialect(decimal=","))
    assert [(str(a), b, c) for a, b, c in rows(outcome.result)] == [("2020-02-29", 5, 8.0), ("2020-12-01", 20, 0.5)]


def test_split_of_rows_into_lists_does_not_matter(spark, folder, spec, tmp_path):
    lines = [f"b{i % 6};{i % 13};{i % 4};{i / 16}" for i in range(180)]
    one = run(spark, spec, folder({"a.csv": HEAD + "\n".join(lines)}), str(tmp_path / "one"))
    shutil.copytree(tmp_path / "in", tmp_path / "many")
    for name, part in (("a", lines[:50]), ("b", lines[140:]), ("c", lines[50:140])):
        (tmp_path / "many" / f"{name}.csv").write_text(HEAD + "\n".join(part) + "\n")
    many = run(spark, spec, str(tmp_path / "many"), str(tmp_path / "many_result"))
    assert rows(one.result) == rows(many.result) and one.status == many.status == "success"


def test_names_differing_in_case_need_a_case_sensitive_session(spark, folder):
    spec = base_spec(columns=(Column("q", "string"), Column("Q", "float")), keys=("q",), rules=(Rule("Q", "sum"),),
                     order=("q", "Q"), sort_by=(), bounds={})
    path = folder({"l.csv": "Q;q\n0.5;x\n4;x\n"})
    assert rows(run(spark, spec, path).result) == [("x", 4.5)]
    spark.conf.set("spark.sql.caseSensitive", "false")
    try:
        with pytest.raises(ValueError, match="caseSensitive"):
            run(spark, spec, path)
    finally:
        spark.conf.set("spark.sql.caseSensitive", "true")


def test_one_monstrous_record_does_not_stop_the_others(spark, folder, spec):
    path = folder({"a.csv": SPRING + ";".join("x" * 30000) + "\n", "b.csv": SPRING,
                   "c.csv": SPRING.replace("8.125", "eight")})
    outcome = run(spark, spec, path)
    assert issues(outcome) == [("a.csv", "error", "malformed_record", None, None, None),
                               ("c.csv", "error", "wrong_type", "cubic", 3, "eight")]
    assert sorted(rows(outcome.list_status, "list_id", "status")) == [
        ("a.csv", "error"), ("b.csv", "ok"), ("c.csv", "error")]


def test_check_reports_everything_about_a_result(spark):
    from tallyfold import check, control_totals
    spec = base_spec(bounds={"cubic": Bounds(max=50)})
    schema = "berth string, hydrant bigint, opened bigint, cubic double"
    merged = spark.createDataFrame([("w", 8, 1, 60.5), ("v", 3, 2, 4.0), ("v", 3, 2, 4.0)], schema)
    before = control_totals(spark.createDataFrame([("v", 3, 5, 70.0)], schema), spec)
    assert sorted(rows(check(merged, before, spec), "rule", "column_name", "row_no", "bad_value"), key=str) == [
        ("above_max", "cubic", 4, "60.5"),
        ("residual_duplicate", None, None, '{"berth":"v","hydrant":3}'),
        ("sum_mismatch", "cubic", None, "70.00 <> 68.50")]


def test_write_result_partitioned_and_with_new_parents(spark, tmp_path):
    df = spark.createDataFrame([(40, "x", 0.5), (41, "y", 9.0)], "hydrant bigint, berth string, cubic double")
    target = str(tmp_path / "new" / "deep" / "result")
    assert publish.write_result(df, target, partition_by=["berth"]) == target
    assert sorted(rows(spark.read.parquet(target), "hydrant", "cubic", "berth")) == [(40, 0.5, "x"), (41, 9.0, "y")]
    publish.write_result(df.limit(1), target)
    assert spark.read.parquet(target).count() == 1
    with pytest.raises(ValueError, match="unknown format"):
        publish.write_result(df, target, "xlsx")
