import datetime
from decimal import Decimal

import pytest
from conftest import base_spec
from pyspark.sql import functions as F

from tallyfold import Column, Dialect, Rule
from tallyfold.functions import convert
from tallyfold.sources.scan import cells


def values(spark, texts, column, exact=False, decimal="."):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    missing = convert.is_missing(F.col("v"))
    out = F.when(~missing, convert.from_text(F.col("v"), column, exact, decimal))
    return [r[0] for r in df.orderBy("i").select(out).collect()]


@pytest.mark.parametrize("text, exact, double, whole", [
    ("1", 1, 1.0, 1), ("1.5", "1.5", 1.5, None), ("1e3", 1000, 1000.0, 1000), ("3.0", 3, 3.0, 3),
    (" 7", 7, 7.0, 7), (".5", "0.5", 0.5, None), ("-2", -2, -2.0, -2),
    ("5d", None, None, None), ("inf", None, None, None), ("1_000", None, None, None), ("0x1F", None, None, None),
    ("x", None, None, None), ("1,5", None, None, None), ("1e-999999999", None, None, None),
    ("27.950000000000003", "27.950000000000003", 27.950000000000003, None),
    ("1e-20", None, 1e-20, None),                       # more decimals than the scale keeps
    ("1e25", None, 1e25, None),                         # beyond decimal and bigint
    ("9007199254740993", 9007199254740993, 9007199254740992.0, 9007199254740993),
    ("NA", None, None, None), ("", None, None, None), ("NULL", None, None, None),
])
def test_numbers(spark, text, exact, double, whole):
    c = Column("v", "float", scale=18)
    assert values(spark, [text], c, True) == [None if exact is None else Decimal(str(exact))]
    assert values(spark, [text], c) == [double]
    assert values(spark, [text], Column("v", "int")) == [whole]


def test_decimal_comma(spark):
    assert values(spark, ["1,5", "2", "1.5", "1.000,5"], Column("v", "float"), decimal=",") == [1.5, 2.0, None, None]


def test_dates_need_a_declared_format(spark):
    texts = ["2024-01-31", "31.01.2024", "1704067200", "2024-02-30", "2024-1-5"]
    assert values(spark, texts, Column("v", "date")) == [datetime.date(2024, 1, 31), None, None, None, None]
    both = Column("v", "date", formats=("yyyy-MM-dd", "dd.MM.yyyy"))
    assert values(spark, texts, both)[:2] == [datetime.date(2024, 1, 31)] * 2


@pytest.mark.parametrize("pattern, good, bad", [
    ("dd.MM.yyyy", "31.01.2024", ["31x01x2024", "2024-01-31", "30.02.2024", "1.1.2024", "31.01.24"]),
    ("yyyyMMdd", "20240131", ["2024131", "20241301", "202401311"]),
    ("MM/dd/yyyy", "01/31/2024", ["31/01/2024", "01-31-2024"]),
    ("d.M.yyyy", "31.1.2024", ["2024-01-31", "x"]),
    ("dd MMM yyyy", "31 Jan 2024", ["31 01 2024"]),
])
def test_date_patterns(spark, pattern, good, bad):
    c = Column("v", "date", formats=(pattern,))
    assert values(spark, [good, f" {good} ", *bad], c) == [datetime.date(2024, 1, 31)] * 2 + [None] * len(bad)


def test_date_with_time(spark):
    c = Column("v", "date", formats=("yyyy-MM-dd HH:mm", "yyyy-MM-dd"))
    assert values(spark, ["2024-01-31 10:30", "2024-01-31"], c) == [
        datetime.datetime(2024, 1, 31, 10, 30), datetime.datetime(2024, 1, 31)]


def test_every_null_token_is_missing_and_nothing_else(spark):
    texts = [*convert.NULL_TOKENS, " NA", "Na", "none"]
    assert values(spark, texts, Column("v", "string")) == [None] * 19 + [" NA", "Na", "none"]


def test_typed_sources(spark):
    df = spark.sql("select 1.5d as f, 3.0d as w, double('nan') as nan, true as b, timestamp_ntz'2024-01-31 00:00:00' as d,"
                   "timestamp_ntz'2024-01-31 10:00:00' as t, 7L as n")
    types = {f.name: f.dataType for f in df.schema}

    def one(name, kind):
        return df.select(convert.from_typed(F.col(name), types[name], Column(name, kind), False)).first()[0]

    assert (one("f", "float"), one("f", "int"), one("w", "int"), one("b", "float")) == (1.5, None, 3, 1.0)
    assert one("n", "string") == "7" and one("n", "date") is None     # a number is not a date
    assert one("d", "date") == datetime.date(2024, 1, 31) and one("t", "date") is None   # time would be lost
    spec = base_spec(columns=(Column("nan", "float"), Column("n", "int")), keys=("n",), rules=(Rule("nan", "sum"),),
                     order=("n", "nan"), sort_by=(), bounds={})
    assert cells(df, spec).select("m0", "v0").first() == (True, None)


def test_null_tokens_that_are_numbers(spark):
    spec = base_spec(columns=(Column("v", "float"), Column("w", "int")), keys=("w",), rules=(Rule("v", "sum"),),
                     order=("w", "v"), sort_by=(), bounds={})
    df = spark.createDataFrame([("-999", "0"), ("5", "1")], "v string, w string")
    found = cells(df, spec, dialect=Dialect(null_tokens=("", "-999", "0"))).select("m0", "v0", "v1")
    assert [(m, None if v is None else float(v), w) for m, v, w in found.collect()] == [(True, None, None), (False, 5.0, 1)]
