"""Consolidation: union lists and merge rows that agree on the key columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions import exact
from tallyfold.functions.exact import Span
from tallyfold.functions.names import col
from tallyfold.operators.numbering import ascending
from tallyfold.spec import Rule, Spec

TOTAL_TYPE = T.DecimalType(38, 2)  # totals are compared at two decimals
COUNTED = "{} (count)"  # a count that will take the place of its own key column
DIGIT, SUM, PRESENT, LOST = "{} (digit {})", "{} (sum)", "{} (present)", "{} (lost)"
Spans = Mapping[str, Span]


def merge(lists: Iterable[DataFrame]) -> DataFrame:
    """All rows of all lists, columns matched by name, duplicates kept."""
    lists = list(lists)
    if not lists:
        raise ValueError("no lists to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists)


def sum_type(spec: Spec, name: str, source: T.DataType) -> T.DataType:
    """How a column is summed: floats as exact decimals, so that order never matters."""
    if isinstance(source, T.DecimalType):
        return source
    if isinstance(source, T.IntegralType) and name not in spec.exact:
        return T.LongType()
    return T.DecimalType(38, 18 if spec.column(name).scale is None else spec.column(name).scale)


def is_free(spec: Spec, name: str, source: T.DataType) -> bool:
    """Whether a column is summed as doubles of any size."""
    return name in spec.free and isinstance(source, (T.DoubleType, T.FloatType))


def addend(spec: Spec, name: str, source: T.DataType) -> Column:
    """A column as it is summed.

    Columns converted by validation already have the right type.  A plain double is taken
    exactly or, if the scale cannot hold it, fails the job: it is never rounded quietly.
    """
    wanted = sum_type(spec, name, source)
    if not isinstance(source, (T.DoubleType, T.FloatType)):
        return col(name).cast(wanted)
    fixed = col(name).try_cast(wanted)
    lossy = F.raise_error(F.concat(F.lit(f"{name} has more decimals than its scale: "), col(name).cast("string")))
    return (F.when(fixed.cast("double") == col(name), fixed)
            .when(col(name).isNotNull() & ~F.isnan(col(name)), lossy.cast(wanted)))


def total(value: Column, kind: T.DataType) -> Column:
    """Total of an addend over all rows at two decimals, of any size.

    Whole parts and fractions are added up apart: neither can outgrow 38 digits as a sum of scale 18 does.
    """
    if not isinstance(kind, T.DecimalType) or kind.scale == 0:
        held = F.sum(value.cast("decimal(20,0)") if kind == T.LongType() else value).cast(TOTAL_TYPE)
        return settled_total(F.count(value), held)
    whole, rest = F.sum(F.floor(value)), F.sum(F.pmod(value, F.lit(1).cast("decimal(1,0)")))
    return settled_total(F.count(value), whole_and_rest(whole, rest))


def settled_total(present: Column, value: Column) -> Column:
    """A total of nothing is 0; one that is NULL although there are values could not be held, and stays NULL."""
    return F.when(present == 0, F.lit(0).cast(TOTAL_TYPE)).otherwise(value)


def whole_and_rest(whole: Column, rest: Column) -> Column:
    return (whole.cast("decimal(36,2)") + F.round(rest, 2).cast("decimal(30,2)")).cast(TOTAL_TYPE)


def _merged(spec: Spec, rule: Rule, source: T.DataType, span: Span) -> list[Column]:
    """What is aggregated for a rule."""
    name = rule.column
    if rule.method != "count" and is_free(spec, name, source):
        value = F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))
        return [*[d.alias(DIGIT.format(name, k)) for k, d in enumerate(exact.digit_sums(value, span))],
                F.count(value).alias(PRESENT.format(name)), exact.outside(value, span).alias(LOST.format(name))]
    return [_plainly_merged(spec, rule, source)]


def _presented(spec: Spec, rule: Rule, source: T.DataType, span: Span) -> Column:
    """The merged column from what was aggregated."""
    name = rule.column
    if rule.method == "count" or not is_free(spec, name, source):
        return col(held_as(spec, name))
    value, present = col(SUM.format(name)), col(PRESENT.format(name))
    if span != exact.ALL:
        lost = F.raise_error(F.lit(f"{name} has values beyond the places {span}: give wider spans")).cast("double")
        value = F.when(col(LOST.format(name)) == 0, value).otherwise(lost)
    if rule.method == "mean":
        value = F.when(present > 0, value / present)
    return value.alias(name)


def _plainly_merged(spec: Spec, rule: Rule, source: T.DataType) -> Column:
    name = rule.column
    if rule.method == "count":
        # In a plain table a missing number may also stand as NaN.
        present = F.when(col(name).isNotNull() & ~F.isnan(col(name)), True)
        number = isinstance(source, (T.DoubleType, T.FloatType))
        return F.count(present if number else col(name)).alias(held_as(spec, name))
    value = addend(spec, name, source)
    if rule.method == "sum":
        return F.coalesce(F.sum(value), F.lit(0).cast(sum_type(spec, name, source))).alias(name)
    # The quotient of exact parts does not depend on how rows were spread over tasks; integers
    # are added up as decimals, as their sum need not be a 64-bit number for the mean to be one.
    exact = value.cast("decimal(20,0)") if sum_type(spec, name, source) == T.LongType() else value
    return (F.sum(exact).cast("double") / F.nullif(F.count(value), F.lit(0))).alias(name)


def held_as(spec: Spec, name: str) -> str:
    """Column of ``grouped`` that holds a result column."""
    return COUNTED.format(name) if name in spec.counted_keys else name


def grouped(rows: DataFrame, spec: Spec, spans: Spans | None = None) -> DataFrame:
    """One row per key combination (missing keys are a value of their own) with merged columns.

    ``spans`` are the places of doubles of any size, by column, if they are known or need to be wider than usual.

    Sum, mean and count all aggregate partially before the shuffle, so a key held by a large
    share of all rows reaches its reducer as one row per task.
    """
    types = {f.name: f.dataType for f in rows.schema}
    spans = {n: exact.USUAL for n in spec.free} | dict(spans or {})
    merged = rows.groupBy(*[col(k) for k in spec.keys]).agg(
        *[c for r in spec.rules for c in _merged(spec, r, types[r.column], spans.get(r.column, exact.USUAL))])
    free = [r.column for r in spec.rules if r.method != "count" and is_free(spec, r.column, types[r.column])]
    if not free:
        return merged
    merged = exact.with_nearest(merged, {
        SUM.format(n): ([DIGIT.format(n, k) for k in range(spans[n][1] - spans[n][0] + 1)], spans[n][0]) for n in free})
    return merged.select(*[col(k) for k in spec.keys], *[
        _presented(spec, r, types[r.column], spans.get(r.column, exact.USUAL)) for r in spec.rules])


def result_order(spec: Spec) -> list[str]:
    """Sort columns of ``grouped``: as declared, then the true keys to make the order total."""
    declared = [held_as(spec, n) for n in spec.sort_by]
    return declared + [k for k in spec.keys if k not in declared]


def presented(merged: DataFrame, spec: Spec) -> DataFrame:
    """The result columns in their declared order."""
    return merged.select(*[col(held_as(spec, n)).alias(n) for n in spec.order])


def consolidate(rows: DataFrame, spec: Spec, ordered: bool = True, spans: Spans | None = None) -> DataFrame:
    """Merge typed rows into the result: group, sort, then project."""
    merged = grouped(rows, spec, spans)
    return presented(merged.orderBy(*ascending(result_order(spec))) if ordered else merged, spec)
