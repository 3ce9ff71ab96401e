import itertools
import os

import pandas as pd
import pytest
from conftest import base_spec, rows

from tallyfold import Column, Dialect, InputError, Rule
from tallyfold.operators import numbering, validate
from tallyfold.sources import catalog as lists
from tallyfold.sources import storage
from tallyfold.sources.scan import BLOCK, FILE, SEQ, scan

HEAD = "berth;hydrant;opened;cubic\n"
LIST = HEAD + "pier;12;3;0.75\nlock;5;;18.5\n"
READ = [("lock", 5, None, 18.5), ("pier", 12, 3, 0.75)]


def opened(spark, path, dialect=Dialect()):
    return lists.read_headers(spark, lists.discover(spark, path), dialect)


def typed(spark, path, spec, dialect=Dialect(), checking=False):
    files = [f for f in opened(spark, path, dialect) if not f.load_rule]
    return sorted(rows(validate.typed_rows(scan(spark, files, spec, dialect, checking), spec)), key=str)


def load_rules(spark, path, spec):
    files = opened(spark, path)
    profile = validate.list_profile(scan(spark, [f for f in files if not f.load_rule], spec), spec)
    return dict(rows(validate.load_issues(lists.catalog_frame(spark, files), profile), "list_id", "rule"))


def numbered_issues(spark, files, spec):
    read = scan(spark, files, spec)
    return numbering.with_row_numbers(validate.cell_issues(read, spec, [FILE, BLOCK, SEQ]), read)


def test_discovery(spark, folder):
    path = folder({"b.csv": LIST, "a.CSV": LIST, "readme.md": "x", ".csv": LIST})
    os.mkdir(f"{path}/sub.csv")
    assert [f.list_id for f in lists.discover(spark, path)] == ["a.CSV", "b.csv"]


def test_unusable_folders(spark, folder, tmp_path):
    with pytest.raises(InputError, match="no lists"):
        lists.discover(spark, folder({"readme.md": "x"}))
    with pytest.raises(InputError, match="not found"):
        lists.discover(spark, str(tmp_path / "nowhere"))
    (tmp_path / "file.csv").write_text(LIST)
    with pytest.raises(InputError, match="not a folder"):
        lists.discover(spark, str(tmp_path / "file.csv"))


def test_permuted_headers_align_by_name(spark, folder, spec):
    path = folder({"a.csv": LIST, "b.csv": "cubic;note;opened;berth;hydrant\n2.25;x;1;0042;7\n",
                   "c.csv": "﻿hydrant;cubic; berth ;opened\n9;4;Kai;6\n"})
    for checking in (True, False):
        assert typed(spark, path, spec, checking=checking) == sorted(
            [*READ, ("0042", 7, 1, 2.25), ("Kai", 9, 6, 4.0)], key=str)


def test_decomposed_header_name_matches(spark, folder):
    spec = base_spec(columns=(Column("berth", "string"), Column("Größe", "float")), keys=("berth",),
                     rules=(Rule("Größe", "sum"),), order=("berth", "Größe"), sort_by=(), bounds={})
    path = folder({"a.csv": "berth;Größe\nquay;6.5\n"})
    assert typed(spark, path, spec) == [("quay", 6.5)]


def test_load_rules(spark, folder, spec):
    path = folder({
        "good.csv": LIST,
        "comma.csv": LIST.replace(";", ","),
        "latin.csv": (LIST + "Tür;1;1;1\n").encode("latin-1"),
        "latin_header.csv": "berth;hydrant;opened;cubic;Größe\nw;1;1;1;1\n".encode("latin-1"),
        "latin_long.csv": (LIST + "w;1;1;1;Tür\n").encode("latin-1"),
        "empty.csv": b"",
        "blank.csv": "\n  \n",
        "long.csv": LIST + "w;1;1;1;surplus\n",
        "all_long.csv": HEAD + "x;w;1;1;1\ny;w;1;1;1\n",
        "unclosed.csv": LIST + 'w;"1;1;1\n',
        "unclosed_header.csv": 'berth;hydrant;opened;"cubic\nw;1;1;1\n',
        "twice.csv": "berth;hydrant;opened;cubic;opened \nw;1;1;1;1\n",
        "short.csv": LIST + "w;1\n",
        "header_only.csv": HEAD,
        "quoted.csv": HEAD + '"w;1";"1";"2";"3"\n"say ""w""";1;1;1\n',
        "_hidden.csv": LIST,
        "broken.parquet": b"no such format",
        "junk.csv": "x" * 200_000 + "\n",
    })
    assert load_rules(spark, path, spec) == {
        "comma.csv": "single_column", "latin.csv": "encoding", "latin_header.csv": "encoding",
        "latin_long.csv": "encoding", "empty.csv": "empty_file", "blank.csv": "empty_file",
        "long.csv": "malformed_record", "all_long.csv": "malformed_record", "unclosed.csv": "malformed_record",
        "unclosed_header.csv": "malformed_record", "twice.csv": "duplicate_column", "_hidden.csv": "hidden_name",
        "broken.parquet": "unreadable", "junk.csv": "single_column"}


@pytest.mark.parametrize("head, sep, columns", [
    ("\tb;c\n".replace(";", "\t"), "\t", ("Unnamed: 0", "b", "c")),
    (' "a";b;c\n', ";", ('"a"', "b", "c")),
    ("﻿\n \t\na;b;c\n", ";", ("a", "b", "c")),
    ("a;b x;c\x0c;d\n", ";", ("a", "b x", "c", "d")),
    ("a;" + "y" * 140_000 + ";c\n", ";", ("a", "y" * 140_000, "c"))])
def test_one_header_rule_for_all_sizes(spark, folder, monkeypatch, head, sep, columns):
    path = folder({"a.csv": head + sep.join("123") + "\n"})
    small = opened(spark, path, Dialect(sep=sep))[0]
    monkeypatch.setattr(lists, "SMALL", 0)
    large = opened(spark, path, Dialect(sep=sep))[0]
    assert small.columns == large.columns == columns and small.load_rule is large.load_rule is None


def test_a_quote_open_at_the_end_of_a_multiline_header(spark, folder):
    path = folder({"a.csv": 'berth;"hydrant\n' + "w;1;2;3\n" * 5000})
    assert [f.load_rule for f in opened(spark, path, Dialect(multiline=True))] == ["malformed_record"]


def test_quoting(spark, folder, spec):
    path = folder({"q.csv": HEAD + '"w;1";"4";2;"2.5"\n"say ""w""";5;3;3\n"";6;1;1\n'})
    assert typed(spark, path, spec) == sorted([("w;1", 4, 2, 2.5), ('say "w"', 5, 3, 3.0), (None, 6, 1, 1.0)], key=str)


def test_line_ends_and_hash_signs(spark, folder, spec):
    path = folder({"cr.csv": HEAD.replace("\n", "\r") + "w;1;2;3\r", "crlf.csv": LIST.replace("\n", "\r\n"),
                   "hash.csv": HEAD + "#w;1;2;3\n"})
    assert typed(spark, path, spec) == sorted([*READ, ("#w", 1, 2, 3.0), ("w", 1, 2, 3.0)], key=str)


def test_quoted_newlines(spark, folder, spec):
    path = folder({"m.csv": HEAD + '"two\nlines";1;2;3\nw;4;5;6\n'})
    assert typed(spark, path, spec, Dialect(multiline=True)) == [("two\nlines", 1, 2, 3.0), ("w", 4, 5, 6.0)]
    named = folder({"h.csv": '"berth\nor quay";hydrant\nw;1\n'})
    names = {f.list_id: f.columns for f in opened(spark, named, Dialect(multiline=True))}
    assert names["h.csv"] == ("berth\nor quay", "hydrant")


def test_odd_file_names(spark, folder, spec):
    names = ["a b.csv", "ü%20x.csv", "br[1].csv", "c{a,b}.csv", "st*r.csv", "q?.csv", "plus+#.CSV"]
    files = opened(spark, folder({n: LIST for n in names}))
    profile = validate.list_profile(scan(spark, files, spec), spec)
    assert sorted(rows(profile, "list_id", "rows")) == sorted((n, 2) for n in names)


def test_row_numbers_over_many_splits(spark, folder, spec):
    n = 30000
    lines = "".join(f"w{i};1;1;{'much' if i % 11 == 0 else i}\n" + ("\n" if i % 900 == 0 else "") for i in range(n))
    path = folder({"big.csv": HEAD + lines, "small.csv": LIST + "w;1;1;much\n"})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        files = opened(spark, path)
        assert scan(spark, files, spec).select(FILE, BLOCK).distinct().count() > 8
        got = sorted(rows(numbered_issues(spark, files, spec), FILE, "row_no"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [("big.csv", i + 2) for i in range(0, n, 11)] + [("small.csv", 4)]


def test_headers_of_large_lists_stop_early(spark, folder):
    body = "w;1;1;1.5\n" * 500_000
    path = folder({f"l{i}.csv": HEAD + body for i in range(3)})
    assert {f.columns for f in opened(spark, path)} == {("berth", "hydrant", "opened", "cubic")}


def test_headers_of_large_lists_take_no_scan(spark, folder):
    path = folder({"l.csv": HEAD + "w;1;1;1.5\n" * 500_000})
    spark.sparkContext.setJobGroup("headers", "headers of large lists")
    try:
        assert opened(spark, path)[0].columns == ("berth", "hydrant", "opened", "cubic")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_lines_of_a_text_do_not_depend_on_its_pieces(spark, folder):
    text = b"\xef\xbb\xbf\r\na\rb\n\nc\r\n d\r"
    for n in range(1, len(text) + 1):
        pieces = [text[k:k + n] for k in range(0, len(text), n)]
        assert list(lists._lines_of(pieces)) == [b"", b"a", b"b", b"", b"c", b" d", b""]
    assert list(lists._lines_of([b"\xef\xbb"])) == [b"\xef\xbb"]
    path = folder({"a.csv": text})
    assert list(storage.chunks(spark, f"{path}/a.csv", 4)) == [text[:4], text[4:12], text[12:]]


def test_parquet_and_csv_mixed(spark, folder, spec):
    path = folder({"a.csv": LIST})
    pd.DataFrame({"cubic": [1.5, None], "opened": [1, 2], "hydrant ": [3, 4], "berth": [70, 80]}).to_parquet(
        f"{path}/p.parquet")
    pd.DataFrame({"cubic": ["2.5", "x"], "opened": ["1", None], "hydrant": ["3", "4"], "berth": ["07", "08"]}).to_parquet(
        f"{path}/s.parquet")
    assert typed(spark, path, spec) == sorted(
        [*READ, ("70", 3, 1, 1.5), ("80", 4, 2, None), ("07", 3, 1, 2.5), ("08", 4, None, None)], key=str)
    found = numbered_issues(spark, opened(spark, path), spec)
    assert sorted(rows(found, FILE, "rule", "row_no")) == [
        ("p.parquet", "missing_value", 3), ("s.parquet", "wrong_type", 3)]


def test_rows_of_parquet_lists_are_numbered_without_a_join(spark, folder, spec):
    path = folder({})
    for i in range(12):  # each with an unknown column of its own: still one scan
        pd.DataFrame({"berth": ["w", None], "hydrant": [1, 2], "opened": [1, 1], "cubic": [0.5, 1.5],
                      f"unknown{i}": [0, 0]}).to_parquet(f"{path}/l{i:02}.parquet")
    files = opened(spark, path)
    found = numbered_issues(spark, files, spec)
    assert sorted(rows(found, FILE, "row_no")) == [(f"l{i:02}.parquet", 3) for i in range(12)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan parquet") == 1


def test_many_layouts_are_looked_up_per_record(spark, folder, spec):
    names, want, texts = ["berth", "hydrant", "cubic", "opened", "ü2"], [], {}
    for i, order in enumerate(itertools.permutations(names)):
        row = {"berth": "ä" if i % 2 else f"b{i}", "hydrant": str(i), "cubic": str(i / 4), "opened": "2", "ü2": ""}
        texts[f"l {i}.csv"] = ";".join(order) + "\n" + (";".join(row[c] for c in order) + "\n") * 2
        want += [(row["berth"], i, 2, i / 4)] * 2
    texts["none.csv"] = "berth;u1;u2;opened;cubic\nw;c;d;1;much\n"
    texts["wide.csv"] = "berth;hydrant;opened;cubic;u1;u2\nw;1;1;7\nw;1;1;much\n"
    texts["long.csv"] = "berth;hydrant;opened;cubic;u1\nw;1;1;7;1;2;3\n"
    files = opened(spark, folder(texts))
    assert len({tuple(f.columns) for f in files}) > 8
    good = [f for f in files if f.list_id.startswith("l ")]
    for checking in (True, False):
        assert sorted(rows(validate.typed_rows(scan(spark, good, spec, checking=checking), spec))) == sorted(want)
    found = numbered_issues(spark, files, spec)
    assert sorted(rows(found.where("rule = 'wrong_type'"), FILE, "row_no", "bad_value")) == [
        ("none.csv", 2, "much"), ("wide.csv", 3, "much")]
    profile = validate.list_profile(scan(spark, files, spec), spec).collect()
    assert [r.list_id for r in profile if r._malformed] == ["long.csv"]
    assert len(profile) == len(files) and not any(r._bad_text for r in profile)


def test_dialect_marks_must_be_ascii():
    with pytest.raises(ValueError):
        Dialect(sep="§")
