import math
import random
from decimal import Decimal, localcontext

import pytest
from conftest import base_spec, rows
from pyspark.sql import functions as F

from tallyfold import Bounds, Column, Rule, consolidate, control_totals, merge, reconcile, residual_duplicates
from tallyfold.operators import checks, numbering, validate
from tallyfold.operators.consolidate import grouped
from tallyfold.sources import catalog as lists
from tallyfold.sources.scan import cells, scan

SCHEMA = "berth string, hydrant bigint, opened bigint, cubic double"


def water(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_hydrant_become_one(spark, spec):
    df = water(spark, ("east", 4, 2, 31.5), ("north", 1, None, 8.125), ("east", 4, 3, 0.25), ("east", 2, 1, 64.0),
               ("east", 4, None, 6.0))
    # By hydrant: 1, 2, 4; hydrant 4 gave 31.5 + 0.25 + 6 in 2 + 3 openings.
    assert rows(consolidate(df, spec)) == [(1, "north", 8.125, 0), (2, "east", 64.0, 1), (4, "east", 37.75, 5)]


def test_distinct_rows_stay_and_are_sorted(spark, spec):
    df = water(spark, ("b", 9, 1, 1.5), ("a", 9, 1, 2.5), ("c", 3, 1, 3.5))
    assert rows(consolidate(df, spec), "hydrant", "berth") == [(3, "c"), (9, "a"), (9, "b")]


def test_tables_are_united_by_name(spark, spec):
    tables = [water(spark, ("pier", 7, 1, 12.0)), water(spark, ("pier", 7, 1, 12.0)),
              spark.createDataFrame([(2.5, 7, "pier")], "cubic double, hydrant bigint, berth string")]
    united = merge(tables)
    assert united.count() == 3
    assert rows(consolidate(united, spec)) == [(7, "pier", 26.5, 2)]
    with pytest.raises(ValueError, match="no lists"):
        merge([])


def test_missing_keys_are_a_value_of_their_own(spark, spec):
    df = water(spark, (None, 5, 1, 1.0), (None, 5, 1, 2.0), ("quay", None, 1, 4.0), ("quay", 5, 1, 8.0))
    assert rows(consolidate(df, spec), "hydrant", "berth", "cubic") == [
        (5, "quay", 8.0), (5, None, 3.0), (None, "quay", 4.0)]


def test_groups_without_values(spark):
    spec = base_spec(columns=(Column("k", "string"), Column("s", "float"), Column("m", "float"), Column("c", "string"),
                              Column("i", "int")),
                     keys=("k",), rules=(Rule("s", "sum"), Rule("m", "mean"), Rule("c", "count"), Rule("i", "sum")),
                     order=("k", "s", "m", "c", "i"), sort_by=(), bounds={})
    df = spark.createDataFrame([("empty", None, None, None, None), ("full", 0.5, 3.0, "x", 9),
                                ("full", None, 4.0, None, -2)],
                               "k string, s double, m double, c string, i bigint")
    assert rows(consolidate(df, spec)) == [("empty", 0.0, None, 0, 0), ("full", 0.5, 3.5, 1, 7)]


def test_counting_a_key(spark):
    spec = base_spec(rules=(Rule("hydrant", "count"),), order=("berth", "hydrant"), sort_by=(), bounds={})
    df = water(spark, ("w", 1, 0, 0.0), ("w", 2, 0, 0.0), ("w", 2, 0, 0.0), ("w", 2, 0, 0.0), ("v", 8, 0, 0.0))
    assert sorted(rows(consolidate(df, spec))) == [("v", 1), ("w", 1), ("w", 3)]
    assert control_totals(df, spec).count() == 0
    # Duplicates are looked for among the true keys, so equal counts are none.
    assert residual_duplicates(grouped(df, spec), spec.keys).count() == 0


def test_missing_numbers_of_a_plain_table_are_not_counted(spark):
    spec = base_spec(rules=(Rule("cubic", "count"),), order=("berth", "cubic"), sort_by=(), bounds={})
    df = water(spark, ("w", 1, 0, float("nan")), ("w", 1, 0, 4.0), ("w", 1, 0, None))
    assert rows(consolidate(df, spec)) == [("w", 1)]


def test_mean_of_integers_whose_sum_has_no_64_bits(spark):
    spec = base_spec(rules=(Rule("opened", "mean"),), order=("berth", "opened"), sort_by=(), bounds={})
    df = water(spark, ("w", 1, 8 * 10**18, 0.0), ("w", 1, 6 * 10**18, 0.0))
    assert rows(consolidate(df, spec)) == [("w", 7e18)]


def test_projection_may_leave_out_sort_column(spark):
    spec = base_spec(order=("berth",), sort_by=("cubic",))
    assert rows(consolidate(water(spark, ("far", 1, 1, 80.0), ("near", 2, 1, 0.75)), spec)) == [("near",), ("far",)]


def test_sums_do_not_depend_on_partitions(spark, spec):
    df = spark.range(0, 9000).select(F.lit("mole").alias("berth"), F.lit(1).cast("bigint").alias("hydrant"),
                                     F.lit(1).cast("bigint").alias("opened"),
                                     ((F.col("id") % 11) / 10).cast("decimal(4,1)").cast("double").alias("cubic"))
    decimals = base_spec(columns=(*spec.columns[:3], Column("cubic", "float", scale=18)))
    sums = {consolidate(df.repartition(n), decimals).first()["cubic"] for n in (1, 5, 13)}
    assert sums == {Decimal(sum(i % 11 for i in range(9000))) / 10}
    sums = {consolidate(df.repartition(n), spec).first()["cubic"] for n in (1, 5, 13)}
    assert sums == {math.fsum(i % 11 / 10 for i in range(9000))}


def test_no_number_is_rounded_quietly(spark):
    fine = base_spec(columns=(*base_spec().columns[:3], Column("cubic", "float", scale=3)), bounds={})
    df = water(spark, ("w", 1, 1, 0.125), ("w", 1, 1, float("nan")), ("w", 1, 1, None))
    assert rows(consolidate(df, fine), "cubic") == [(0.125,)]
    with pytest.raises(Exception, match="cubic has more decimals than its scale: 0.0625"):
        consolidate(df.unionAll(water(spark, ("w", 1, 1, 0.0625))), fine).collect()


def test_plans_read_only_what_they_need(spark, spec, folder):
    text = plan(consolidate(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumnsRenamed(
        {"l_returnflag": "berth", "l_partkey": "hydrant", "l_suppkey": "opened", "l_quantity": "cubic"}), spec))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double,l_returnflag:string>" in text
    path = folder({"a.csv": "old;berth;hydrant;new;cubic;opened\nx;w;3;y;1;1\n"})
    files = lists.read_headers(spark, lists.discover(spark, path))
    merged = plan(grouped(validate.typed_rows(scan(spark, files, spec, checking=False), spec), spec))
    assert "FileScan csv [_line#" in merged and merged.count("Exchange") == 1 and "Python" not in merged
    profile = plan(validate.list_profile(scan(spark, files, spec), spec))
    assert profile.count("Exchange") == 1 and "Sort" not in profile and "Python" not in profile
    issues = plan(validate.cell_issues(scan(spark, files, spec), spec, ["_file"]))
    assert "Exchange" not in issues and "Python" not in issues


def made(spark):
    return spark.range(0, 1000).select((F.col("id") % 17).cast("string").alias("berth"),
                                       (F.col("id") % 5).alias("hydrant"), F.col("id").alias("opened"),
                                       (F.col("id") / 8).alias("cubic"))


def test_consolidating_a_result_changes_nothing(spark, spec):
    once = consolidate(made(spark), spec)
    assert rows(consolidate(once, spec)) == rows(once) and once.count() == 85


def test_totals_of_a_profile_are_those_of_its_numbers(spark):
    rng = random.Random(4)
    for scale in (1, 2, 9, 10):
        numbers = [Decimal(rng.randrange(-10 ** rng.randrange(1, 19), 10 ** rng.randrange(1, 19))).scaleb(-rng.randrange(scale + 1))
                   for _ in range(300)]
        kinds = {"mixed": numbers, "short": [n for n in numbers if abs(n) < 10], "long": [n for n in numbers if abs(n) >= 10 ** 9],
                 "negative": [Decimal("-1.5"), Decimal("0.1")], "none": []}
        spec = base_spec(columns=(Column("berth", "string"), Column("hydrant", "int"), Column("opened", "int", True),
                                  Column("cubic", "float", True, scale=scale)))
        df = spark.createDataFrame([(kind, "w", 1, 1, x) for kind, of in kinds.items() for x in [*map("{:f}".format, of), None]],
                                   "_file string, berth string, hydrant int, opened int, cubic string")
        read = cells(df, spec, ["_file"]).withColumns({c: F.lit(False) for c in ("_malformed", "_bad_text", "_unclosed")})
        i = spec.columns_with("sum").index("cubic")
        with localcontext() as context:
            context.prec = 60
            got = {r.list_id: (r[f"c{i}"], None if r[f"t{i}"] is None else r[f"t{i}"] + r[f"f{i}"])
                   for r in validate.list_profile(read, spec).collect()}
            assert got == {kind: (len(of), sum(of) if of else None) for kind, of in kinds.items()}


def test_control_totals(spark, spec):
    df = water(spark, ("w", 1, 4, 0.5), ("w", 1, 5, 7.25), ("v", 2, None, 90.0))
    before, after = control_totals(df, spec), control_totals(consolidate(df, spec), spec)
    assert sorted(rows(before)) == [("cubic", 97.75, 3), ("opened", 9.0, 3)]
    assert sorted(rows(reconcile(before, after))) == [("cubic", 97.75, 97.75, True, 3, 2, 1),
                                                      ("opened", 9.0, 9.0, True, 3, 2, 1)]


def test_totals_beyond_one_column_type(spark):
    spec = base_spec(bounds={})
    df = water(spark, *[(str(i), i, 9 * 10**18, 9e19) for i in range(12)])
    assert sorted((c, int(t)) for c, t, _ in control_totals(df, spec).collect()) == [
        ("cubic", 12 * 9 * 10**19), ("opened", 12 * 9 * 10**18)]
    small = water(spark, ("w", 1, 1, -0.005), ("w", 1, 1, 0.001), ("w", 1, 1, -7.0))
    after = control_totals(consolidate(small, spec), spec)
    assert all(r.passed for r in reconcile(control_totals(small, spec), after).collect())
    assert [t for c, t, _ in after.collect() if c == "cubic"] == [Decimal("-7.00")]


def totals(spark, name, value):
    return spark.createDataFrame([(name, Decimal(value), 1)], "column_name string, total decimal(38,18), rows bigint")


def test_totals_agree_at_two_decimals(spark):
    def passed(before, after):
        return reconcile(totals(spark, "x", before), totals(spark, "x", after)).first().passed
    assert passed("410.300000000000011", "410.3") and not passed("410.31", "410.30")
    assert reconcile(totals(spark, "x", "6"), totals(spark, "y", "6")).count() == 0
    found = checks.sum_issues(reconcile(totals(spark, "x", "410.31"), totals(spark, "x", "400")))
    assert rows(found, "level", "rule", "column_name", "bad_value") == [
        ("result", "sum_mismatch", "x", "410.31 <> 400.00")]


def test_residual_duplicates_once_each(spark, spec):
    df = water(spark, ("w", 1, 1, 1.0), ("w", 1, 2, 2.0), ("w", 1, 3, 3.0), ("v", 1, 1, 1.0), (None, 6, 1, 1.0),
               (None, 6, 1, 1.0))
    found = checks.duplicate_issues(residual_duplicates(df, spec.keys), spec)
    assert sorted(rows(found, "rule", "bad_value")) == [
        ("residual_duplicate", '{"berth":"w","hydrant":1}'), ("residual_duplicate", '{"berth":null,"hydrant":6}')]


def test_bounds_are_inclusive_and_missing_values_pass(spark):
    spec = base_spec(bounds={"cubic": Bounds(-2, 40)})
    df = water(spark, ("a", 1, 1, -2.5), ("b", 1, 1, -2.0), ("c", 1, 1, 40.0), ("d", 1, 1, 40.25), ("e", 1, 1, None))
    assert sorted(rows(checks.range_violations(df, spec, ["berth"]))) == [
        ("a", "below_min", "cubic", "-2.5"), ("d", "above_max", "cubic", "40.25")]
    counted = base_spec(rules=(Rule("cubic", "count"), Rule("opened", "sum")), bounds={"cubic": Bounds(0, 1)})
    assert checks.range_rules(counted) == []


def test_ordinals_follow_the_sort_order(spark):
    df = spark.range(0, 50000).select((F.col("id") * 7919 % 50000).alias("k"), F.lit(1).alias("x")).repartition(16)
    numbered = numbering.with_ordinals(df, ["k"])
    assert numbered.where("ordinal <> k + 1").count() == 0 and numbered.count() == 50000


def test_plans_stay_native_and_shuffle_once(spark, spec):
    text = plan(residual_duplicates(grouped(made(spark), spec), spec.keys))
    assert text.count("Exchange") == 1                      # the check reuses the grouping's partitioning
    assert "Python" not in text and "SortAggregate" not in text
    assert "CartesianProduct" not in plan(checks.gated(made(spark), checks.sum_issues(
        reconcile(totals(spark, "x", "1"), totals(spark, "x", "1")))))


def test_rows_that_share_keys_are_counted_where_they_are_sorted(spark, tmp_path):
    df = spark.range(0, 30000).select(F.when(F.col("id") % 10 > 0, F.col("id") % 7001).alias("k"),
                                      (F.col("id") % 3).cast("string").alias("g"), "id").repartition(16)
    single = df.groupBy("k", "g").agg(F.min("id").alias("id"))
    for given in (single, df, single.limit(0)):
        ordered, held = checks.sorted_and_counted(given, ["g", "k"], ["k", "g"])
        ordered.write.mode("overwrite").parquet(str(tmp_path / "out"))
        want = given.join(checks.residual_duplicates(given, ["g", "k"]).select(F.col("g").alias("g2"), F.col("k").alias("k2")),
                          F.col("g").eqNullSafe(F.col("g2")) & F.col("k").eqNullSafe(F.col("k2")), "left_semi").count()
        assert held.get["repeated"] == want and ordered.columns == given.columns
        stored = spark.read.parquet(str(tmp_path / "out")).select("*", *numbering.stored_place()).toPandas()
        in_files = stored.sort_values(["_name", "_index"])[["k", "g"]].reset_index(drop=True)
        assert in_files.equals(stored.sort_values(["k", "g"], na_position="last")[["k", "g"]].reset_index(drop=True))
    text = plan(ordered.sparkSession.range(100).selectExpr("id % 9 as k", "id as g").transform(
        lambda d: checks.sorted_and_counted(d, ["g", "k"], ["k", "g"])[0]))
    assert text.count("Exchange") == 1 and "rangepartitioning" in text
    with pytest.raises(ValueError, match="not dealt"):
        checks.sorted_and_counted(df, ["k"], ["k", "id"])
