"""Sums of doubles of any size, and totals that cannot be held."""

import math
import random
from decimal import Decimal
from fractions import Fraction

import pytest
from conftest import base_spec, rows
from pyspark.sql import functions as F

from tallyfold import Column, Rule, check, consolidate, control_totals, reconcile, run
from tallyfold.functions import exact
from tallyfold.operators import checks

HEAD = "berth;hydrant;opened;cubic\n"
FREE = base_spec(bounds={})


def as_double(total: Fraction) -> float:
    try:
        return float(total)
    except OverflowError:
        return math.inf if total > 0 else -math.inf


@pytest.mark.parametrize("span", [exact.USUAL, exact.ALL])
def test_sums_equal_fractions_rounded_once(spark, span):
    rng = random.Random(7)
    odd = [1e21, -1e21, 1e-30, 0.1, -0.0, 0.0, 2.0**53 + 2, 1 / 3, -1 / 3, 1e-16, 9007199254740993.0, 0.5 + 2.0**-53]
    if span == exact.ALL:
        odd += [5e-324, -5e-324, 2.2250738585072014e-308, 1.7e308, -1.7e308, 1e300]
    data = [(g, rng.choice([rng.choice(odd), rng.uniform(-1, 1) * 10.0 ** rng.randint(-30, 21), rng.randint(-10**6, 10**6) / 100]))
            for g in range(80) for _ in range(rng.randint(1, 40))]
    digits = exact.digit_sums(F.col("x"), span)
    names = [f"d{i}" for i in range(len(digits))]
    sums = (spark.createDataFrame(data, "g int, x double").repartition(7).groupBy("g")
            .agg(*[d.alias(n) for d, n in zip(digits, names)], exact.outside(F.col("x"), span).alias("lost")))
    sums = exact.with_nearest(sums.withColumn("d", F.array(*names)), {"sum": (names, span[0])})
    found = sums.select("g", "lost", "sum", exact.nearest(F.col("d"), span[0]).alias("slow"),
                        exact.nearest(exact.padded(F.col("d"), span), exact.ALL[0]).alias("padded"),
                        exact.two_decimals(F.col("d"), span[0]).alias("shown"))
    for r in found.collect():
        total = sum(Fraction(x) for g, x in data if g == r.g)
        assert r.lost == 0 and r.sum == r.slow == r.padded == as_double(total)
        if abs(total) < 10**35:
            assert abs(Fraction(r.shown) - total) <= Fraction(501, 100_000)
        else:
            assert r.shown is None


def test_what_does_not_fit_is_counted_and_fails(spark):
    df = spark.createDataFrame([("w", 1, 1, 1e-45), ("w", 1, 1, 1e50), ("w", 1, 1, float("nan")), ("w", 1, 1, 2.0)],
                               "berth string, hydrant bigint, opened bigint, cubic double")
    assert df.agg(exact.outside(F.col("cubic"))).first()[0] == 2
    with pytest.raises(Exception, match="cubic has values beyond the places"):
        consolidate(df, FREE).collect()
    wide = {"cubic": exact.ALL}
    assert rows(consolidate(df, FREE, spans=wide), "cubic") == [(1e50,)]
    assert dict(rows(control_totals(df, FREE), "column_name", "total"))["cubic"] is None      # unknown, not 0


def test_span_covers_its_numbers(spark):
    for x in (5e-324, 1e-300, 1e-30, 0.1, 1.0, 12345.678, 2.0**53, 1e21, 1.7976931348623157e308):
        span = exact.span_of(x, x)
        assert spark.range(1).select(exact.fits(F.lit(x), span), exact.fits(F.lit(-x), span)).first() == (True, True)
    assert exact.span_of(None, 0.0) == (0, 0)


@pytest.mark.parametrize("texts", [("1e21", "1e-30", "-1e21"), ("1E+21", "0.1", "0.2"), ("1e300", "1e-300", "-1e300"),
                                   ("1e35", "1", "1"), ("4.9e-324", "4.9e-324", "1"), ("0.1", "0.2", "0.3"), ("-0.0", "0", "0")])
def test_runs_take_numbers_of_any_size(spark, folder, tmp_path, texts):
    outcome = run(spark, FREE, folder({"a.csv": HEAD + "".join(f"w;1;1;{x}\n" for x in texts[:2]),
                                       "b.csv": HEAD + f"w;1;1;{texts[2]}\nv;2;1;7.25\n"}), str(tmp_path / "t"))
    assert outcome.status == "success" and not outcome.issues.count()
    assert rows(outcome.result, "berth", "cubic") == [("w", as_double(sum(map(Fraction, map(float, texts))))), ("v", 7.25)]
    assert outcome.result.schema["cubic"].dataType.simpleString() == "double"


def test_means_of_numbers_of_any_size(spark):
    spec = base_spec(rules=(Rule("cubic", "mean"),), order=("berth", "cubic"), sort_by=(), bounds={})
    df = spark.createDataFrame([("a", 1, 1, 1e21), ("a", 1, 1, 1.0), ("a", 1, 1, -1e21), ("a", 1, 1, 1.0), ("b", 1, 1, None)],
                               "berth string, hydrant bigint, opened bigint, cubic double")
    assert rows(consolidate(df, spec)) == [("a", 0.5), ("b", None)]


def test_rounded_results_agree_with_exact_totals_and_lost_ones_do_not(spark):
    """Thousands of merged values, each rounded, and a total on the edge between two hundredths."""
    df = spark.range(20000).select((F.col("id") % 3000).cast("string").alias("berth"), F.lit(1).cast("bigint").alias("hydrant"),
                                   F.lit(1).cast("bigint").alias("opened"), (F.pow(F.lit(1.1), F.col("id") % 400)).alias("cubic"))
    merged = consolidate(df, FREE)
    before, after = checks.measured_totals(df, FREE), checks.measured_totals(merged, FREE)
    assert [r.passed for r in reconcile(before, after).collect()] == [True, True]
    less = checks.measured_totals(merged.where("berth <> '3'"), FREE)
    assert {r.column_name: r.passed for r in reconcile(before, less).collect()} == {"cubic": False, "opened": False}


def test_totals_that_overflow_without_ansi_mode_fail(spark):
    spec = base_spec(columns=(*base_spec().columns[:3], Column("cubic", "float", scale=0)), bounds={})
    df = spark.createDataFrame([("v", 1, 1, Decimal(6 * 10**37)), ("w", 1, 1, Decimal(6 * 10**37))],
                               "berth string, hydrant bigint, opened bigint, cubic decimal(38,0)")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        before = control_totals(df, spec)
        assert dict(rows(before, "column_name", "total")) == {"cubic": None, "opened": 2.0}
        compared = {r.column_name: r.passed for r in reconcile(before, control_totals(consolidate(df, spec), spec)).collect()}
        assert compared == {"cubic": False, "opened": True}
        assert rows(check(df, before, spec), "rule", "column_name", "bad_value") == [
            ("sum_mismatch", "cubic", "unknown <> unknown")]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_totals_of_nothing_are_zero(spark):
    for spec in (FREE, base_spec(columns=(*base_spec().columns[:3], Column("cubic", "float", scale=2)), bounds={})):
        df = spark.createDataFrame([("v", 1, None, None)], "berth string, hydrant bigint, opened bigint, cubic double")
        for rows_ in (df, df.limit(0)):
            assert dict(rows(control_totals(rows_, spec), "column_name", "total")) == {"cubic": 0.0, "opened": 0.0}


def test_plan_adds_digits_up_before_the_shuffle(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("berth"), F.col("id").alias("hydrant"),
                                F.col("id").alias("opened"), F.col("id").cast("double").alias("cubic"))
    plan = consolidate(df.repartition(3), FREE, ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "partial_sum" in plan and "SortAggregate" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_digits_are_rounded_to_either_side(spark):
    """Rounded digits are at most half a place, so a digit's sum outgrows its type later than that of digits cut off."""
    found = spark.createDataFrame([(2.0**24 - 1,), (2.0**48 - 1,), (-(2.0**24) + 1,)], "x double").select(
        "x", F.array(*[exact._digit(F.col("x"), j, exact.USUAL) for j in range(*exact.USUAL)]).alias("d"))
    for r in found.collect():
        assert max(map(abs, r.d)) <= 2**23
        assert sum(Fraction(d) * Fraction(2) ** (24 * j) for d, j in zip(r.d, range(*exact.USUAL))) == Fraction(r.x)
