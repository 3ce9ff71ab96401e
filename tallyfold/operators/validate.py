"""List validation: every finding of every list, as rows of one issue table."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions import exact
from tallyfold.functions.exact import Span
from tallyfold.operators.consolidate import TOTAL_TYPE, settled_total, whole_and_rest
from tallyfold.sources.catalog import decoded_name
from tallyfold.sources.scan import BAD_TEXT, FILE, MALFORMED, UNCLOSED, part_names
from tallyfold.spec import Spec

ISSUE_SCHEMA = T.StructType([
    T.StructField("list_id", T.StringType()),       # NULL: concerns the result, not one list
    T.StructField("level", T.StringType()),         # load, column, cell or result
    T.StructField("severity", T.StringType()),      # error or warning
    T.StructField("rule", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("row_no", T.LongType()),          # NULL: concerns the whole list or column
    T.StructField("bad_value", T.StringType()),
])
ISSUE_COLUMNS = ISSUE_SCHEMA.names
FEW_PLACES = 9  # decimals of numbers whose units are counted
FEW_UNITS = 1e8  # numbers of fewer units of their last place: 92 billion of them fit a 64-bit total


def issue(list_id: Column, level: str, severity: str, rule: Column, column: Column | None = None,
          row_no: Column | None = None, bad_value: Column | None = None) -> list[Column]:
    """One issue row in the common layout."""
    parts = [list_id, F.lit(level), F.lit(severity), rule, column, row_no, bad_value]
    return [(F.lit(None) if p is None else p).cast(f.dataType).alias(f.name) for p, f in zip(parts, ISSUE_SCHEMA)]


# -- whole lists and columns ------------------------------------------------------------


def load_issues(catalog: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """One error per list that cannot be read, whatever else is wrong with it."""
    rule = F.col("load_rule")
    if profile is not None:
        catalog = catalog.join(profile.select("list_id", MALFORMED, BAD_TEXT), "list_id", "left")
        rule = (F.when(rule.isNotNull(), rule).when(F.col(BAD_TEXT) > 0, F.lit("encoding"))
                .when(F.col(MALFORMED) > 0, F.lit("malformed_record")))
    found = catalog.withColumn("rule", rule).where(F.col("rule").isNotNull())
    return found.select(*issue(F.col("list_id"), "load", "error", F.col("rule")))


def column_issues(catalog: DataFrame, spec: Spec) -> DataFrame:
    """Missing required columns (errors) and unknown columns (warnings) of readable lists."""
    required = F.array(*[F.lit(n) for n in spec.required])
    header = F.col("columns")
    frames = []
    for rule, severity, names in (("missing_column", "error", F.array_except(required, header)),
                                  ("unknown_column", "warning", F.array_except(header, required))):
        each = catalog.select("list_id", F.explode(names).alias("name"))
        frames.append(each.select(*issue(F.col("list_id"), "column", severity, F.lit(rule), F.col("name"))))
    return frames[0].unionByName(frames[1])


def escalate(issues: DataFrame, strict: bool) -> DataFrame:
    """In strict mode every warning counts as an error."""
    return issues.withColumn("severity", F.lit("error")) if strict else issues


# -- cells ------------------------------------------------------------------------------


def _rules(spec: Spec) -> list[tuple[str, int, Column]]:
    """Cell rules generated from the spec: (rule, column position, violated?)."""
    rules = []
    for i, c in enumerate(spec.columns):
        value, missing, _ = (F.col(p) for p in part_names(spec, c.name))
        # A converted value settles both rules, so the rest is only looked at without one.
        if not c.allow_missing:
            rules.append(("missing_value", i, missing if c.type == "string" else value.isNull() & missing))
        if c.type != "string":
            rules.append(("wrong_type", i, value.isNull() & ~missing))
    return rules


def cell_issues(cells: DataFrame, spec: Spec, carry: Iterable[str]) -> DataFrame:
    """One row per violating cell, found in a single pass over all rules.

    ``carry`` columns travel along; they say which list and row a finding belongs to.
    """
    carry = list(carry)
    rules = _rules(spec)
    if not rules:
        return cells.select(*carry, F.lit("").alias("rule"), F.lit("").alias("column_name"),
                            F.lit("").alias("bad_value")).limit(0)
    found = F.array_compact(F.array(*[
        F.when(violated, F.struct(F.lit(rule).alias("rule"), F.lit(spec.required[i]).alias("column_name"),
                                  F.when(~F.col(f"m{i}"), F.col(f"r{i}")).alias("bad_value")))
        for rule, i, violated in rules]))
    any_found = reduce(or_, [violated for _, _, violated in rules])
    return (cells.where(any_found)
            .select(*carry, F.explode(found).alias("found")).select(*carry, "found.*"))


def typed_rows(cells: DataFrame, spec: Spec, carry: Iterable[str] = ()) -> DataFrame:
    """The converted values under the column names of the spec."""
    return cells.select(*carry, *[F.col(part_names(spec, n)[0]).alias(n) for n in spec.required])


def list_profile(scanned: DataFrame, spec: Spec) -> DataFrame:
    """One row per scanned list: records, broken records, violations per rule, column totals.

    Everything the gate and the report need to know about the input comes from this single
    pass.  All buffers are fixed-width numbers, so rows collapse in a hash aggregate before
    the shuffle, which then carries one small row per list and task.
    """
    counts = [F.count_if(v).alias(f"n{i}") for i, (_, _, v) in enumerate(_rules(spec))]
    totals, scales = [], {}
    for i, n in enumerate(spec.columns_with("sum")):
        value = F.col(f"v{spec.required.index(n)}")
        if n in spec.free:
            totals += [F.array(*exact.digit_sums(value)).alias(f"d{i}"), exact.outside(value).alias(f"o{i}")]
            continue
        totals.append(F.count(value).alias(f"c{i}"))
        if n in spec.exact and spec.column(n).scale:
            # Whole parts and fractions apart, so that no total outgrows its type.
            if spec.column(n).scale <= FEW_PLACES:
                # Numbers of a few digits, as most are, are added up as 64-bit integers.
                few, units = _units(value, spec.column(n).scale)
                value = F.when(~few, value)
                totals += [F.sum(F.when(few, units)).alias(f"u{i}"), F.count(value).alias(f"g{i}")]
                scales[i] = spec.column(n).scale
            totals += [F.sum(F.floor(value)).alias(f"t{i}"),
                       F.sum(F.pmod(value, F.lit(1).cast("decimal(1,0)"))).alias(f"f{i}")]
        else:
            totals.append(F.sum(value if n in spec.exact else value.cast("decimal(20,0)")).alias(f"t{i}"))
    for i, n in enumerate(spec.free):
        size = F.abs(F.col(f"v{spec.required.index(n)}"))
        totals += [F.min(F.when(size > 0, size)).alias(f"l{i}"), F.max(size).alias(f"m{i}")]
    flat = scanned.groupBy(FILE).agg(F.count(F.lit(1)).alias("rows"), F.count_if(MALFORMED).alias(MALFORMED),
                                     F.count_if(BAD_TEXT).alias(BAD_TEXT), F.count_if(UNCLOSED).alias(UNCLOSED),
                                     *counts, *totals)
    for i, scale in scales.items():
        flat = flat.withColumns(dict(zip((f"t{i}", f"f{i}"), _with_units(i, scale))))
    return flat.select(decoded_name(FILE).alias("list_id"), "rows", MALFORMED, BAD_TEXT, UNCLOSED,
                       *[c for c in flat.columns if c[0] in "ntfcdolm" and c[1:].isdigit()])


def _units(value: Column, scale: int) -> tuple[Column, Column]:
    """Whether a decimal has so few digits that doubles count the units of its last place, and their number."""
    units = value.cast("double") * F.lit(float(10 ** scale))
    return F.abs(units) < FEW_UNITS, F.rint(units).cast("bigint")


def _with_units(i: int, scale: int) -> tuple[Column, Column]:
    """Whole parts and fractions of a total, units included; of nothing they are NULL, and so is what could not be held."""
    units, one = F.col(f"u{i}").cast("decimal(19,0)"), F.lit(10 ** scale).cast(f"decimal({scale + 1},0)")
    rest = F.pmod(units, one)
    whole = ((units - rest) / one).cast("decimal(20,0)")
    fraction = (rest * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal({scale + 1},{scale})")
    return tuple(F.when(F.col(f"g{i}") == 0, x).when(x.isNull(), F.col(c)).otherwise(F.col(c) + x)
                 for c, x in ((f"t{i}", whole), (f"f{i}", fraction)))


def cell_issue_counts(profile: DataFrame, spec: Spec) -> DataFrame:
    """(list_id, rule, column_name, n) for every rule violated in a list."""
    rules = _rules(spec)
    if not rules:
        return profile.select("list_id", F.lit("").alias("rule"), F.lit("").alias("column_name"),
                              F.col("rows").alias("n")).limit(0)
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(spec.required[at]).alias("column_name"),
                              F.col(f"n{i}").alias("n")) for i, (rule, at, _) in enumerate(rules)])
    return profile.select("list_id", F.inline(each)).where("n > 0")


def spans(profile: DataFrame, spec: Spec) -> dict[str, Span]:
    """Places that the doubles of all lists need, by column."""
    if not spec.free:
        return {}
    found = profile.agg(*[f(f"{c}{i}").alias(f"{c}{i}") for i in range(len(spec.free))
                          for f, c in ((F.min, "l"), (F.max, "m"))]).first()
    return {n: exact.span_of(found[f"l{i}"], found[f"m{i}"]) for i, n in enumerate(spec.free)}


def input_totals(profile: DataFrame, spec: Spec) -> DataFrame:
    """Control totals of the summed columns over all scanned lists (see ``stacked_totals``)."""
    names, sums = spec.columns_with("sum"), []
    for i, n in enumerate(names):
        if n in spec.free:
            width = exact.USUAL[1] - exact.USUAL[0] + 1
            digits = F.array(*[F.coalesce(F.sum(F.get(f"d{i}", F.lit(j))), F.lit(0)) for j in range(width)])
            sums += _free_columns(i, digits, F.coalesce(F.sum(f"o{i}"), F.lit(0)), F.lit(0.0), exact.USUAL)
            continue
        parts = [f"{c}{i}" for c in "tf" if f"{c}{i}" in profile.columns]
        held = whole_and_rest(*map(F.sum, parts)) if len(parts) == 2 else F.sum(parts[0]).cast(TOTAL_TYPE)
        # The total of one list may be what could not be held.
        unknown = F.count_if((F.col(f"c{i}") > 0) & reduce(or_, [F.col(p).isNull() for p in parts])) > 0
        held = F.when(unknown, F.lit(None).cast(TOTAL_TYPE)).otherwise(held)
        sums.append(settled_total(F.coalesce(F.sum(f"c{i}"), F.lit(0)), held).alias(f"t{i}"))
    return stacked_totals(profile.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *sums), names)


def free_total(i: int, value: Column, span: Span) -> list[Column]:
    """Aggregates for the total of doubles of any size."""
    # Rounding a sum to a double changes it by at most half of its last place.
    slack = F.coalesce(F.sum(F.abs(value)), F.lit(0.0)) * F.lit(2.0 ** -53 * 1.000001)
    return _free_columns(i, F.array(*exact.digit_sums(value, span)), exact.outside(value, span), slack, span)


def _free_columns(i: int, digits: Column, lost: Column, slack: Column, span: Span) -> list[Column]:
    held = F.when(lost == 0, digits)
    return [held.alias(f"d{i}"), slack.alias(f"s{i}"), F.lit(span[0]).alias(f"p{i}"), F.lit(span[1]).alias(f"q{i}")]


def stacked_totals(one_row: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Turn ``rows, t0, t1, ...`` into one row per column: (column_name, total, rows, digits, slack).

    ``digits`` are those of a total of doubles of any size, over all places, and ``slack`` what rounding may have
    changed it by; both are NULL for other columns.  A total that could not be held is NULL.
    """
    if not names:
        return one_row.select(F.lit("").alias("column_name"), F.lit(0).cast(TOTAL_TYPE).alias("total"), F.col("rows"),
                              F.lit(None).cast("array<bigint>").alias("digits"),
                              F.lit(None).cast("double").alias("slack")).limit(0)
    each = []
    for i, n in enumerate(names):
        free = f"d{i}" in one_row.columns
        digits, slack = F.lit(None).cast("array<bigint>"), F.lit(None).cast("double")
        value = F.col(f"t{i}") if not free else None
        if free:
            zero, lo, hi = F.lit(0).cast("bigint"), F.col(f"p{i}"), F.col(f"q{i}")
            digits = F.concat(F.array_repeat(zero, lo - exact.ALL[0]), F.col(f"d{i}"),
                              F.array_repeat(zero, F.lit(exact.ALL[1]) - hi))
            slack, value = F.col(f"s{i}"), exact.two_decimals(digits, exact.ALL[0])
        each.append(F.struct(F.lit(n).alias("column_name"), value.alias("total"), digits.alias("digits"),
                             slack.alias("slack")))
    return one_row.select(F.inline(F.array(*each)), F.col("rows")).select("column_name", "total", "rows", "digits", "slack")
