"""Cell conversion: one native expression decides validity and yields the typed value.

A cell is valid exactly when its converted value is not NULL, so a check can never pass a
value that the conversion then loses.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold import spec as S

# Texts that mean "missing" in a delimited list.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# A decimal number with optional exponent; ``{mark}`` is the decimal mark.  Casts alone accept
# more (Java suffixes, infinities), and an exponent of many digits would make a cast build a
# giant number.
NUMBER = r"^\s*[+-]?(\d+({mark}\d*)?|{mark}\d+)([eE][+-]?0*\d{{1,3}})?\s*$"
# The usual form of a number, short enough that converting it cannot lose anything.
PLAIN = r"^[+-]?\d{{1,{whole}}}({mark}\d{{0,{decimals}}})?$"

# The same with a short exponent, for doubles: it is below 1e300, so it is finite.
DOUBLE = r"^[+-]?\d{{1,200}}({mark}\d{{0,300}})?([eE][+-]?\d{{1,2}})?$"

# Pattern letters that make a date pattern a timestamp pattern.
TIME_LETTERS = frozenset("HhKkmsSaAnN")

WIDE = T.DecimalType(38, 18)


def is_missing(text: Column, null_tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Whether a text cell is NULL or a missing token (exact match)."""
    return text.isNull() | text.isin(*null_tokens) if null_tokens else text.isNull()


def reads_as_number(token: str, decimal: str = ".") -> bool:
    return re.match(NUMBER.format(mark=re.escape(decimal)), token) is not None


def value_type(column: S.Column, exact: bool) -> T.DataType:
    """Spark type of the converted column."""
    if column.type == "string":
        return T.StringType()
    if column.type == "int":
        return T.LongType()
    if column.type == "float":
        return T.DecimalType(38, column.scale) if exact else T.DoubleType()
    return T.TimestampNTZType() if has_time(column.formats) else T.DateType()


def has_time(formats: Sequence[str]) -> bool:
    """Whether any pattern carries a time of day (quoted literals aside)."""
    return any(TIME_LETTERS & set("".join(f.split("'")[::2])) for f in formats)


def from_text(text: Column, column: S.Column, exact: bool, decimal: str = ".") -> Column:
    """Typed value of a text cell, NULL where it cannot be converted without loss.

    Numbers in their usual form take a short path; only the rest is looked at closely.
    """
    if column.type == "string":
        return text
    if column.type == "date":
        trimmed = F.trim(text)
        if has_time(column.formats):
            return F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(f)).cast("timestamp_ntz") for f in column.formats])
        return F.coalesce(*[_date(trimmed, f) for f in column.formats])
    mark = re.escape(decimal)
    dotted = text if decimal == "." else F.replace(text, F.lit(decimal), F.lit("."))
    if column.type == "int":
        # ``12.0`` needs no decimal arithmetic either.
        zeros = text.rlike(rf"^[+-]?\d{{1,18}}{mark}0*$")
        usual = F.coalesce(text.try_cast("bigint"),
                           F.when(zeros, F.substring_index(text, decimal, 1).try_cast("bigint")))
    else:
        form = PLAIN.format(mark=mark, whole=38 - column.scale, decimals=column.scale) if exact else DOUBLE.format(mark=mark)
        usual = F.when(text.rlike(form), dotted.try_cast(value_type(column, exact)))
    closely = F.when(text.rlike(NUMBER.format(mark=mark)), _number(F.trim(dotted), column, exact))
    return F.coalesce(usual, closely)


def from_typed(value: Column, source: T.DataType, column: S.Column, exact: bool) -> Column:
    """Typed value of a cell whose source column has a Spark type other than string."""
    if column.type == "string":
        return value.cast("string")
    if column.type == "date":
        temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
        wanted = value_type(column, exact)
        if not isinstance(source, temporal):
            return F.lit(None).cast(wanted)
        return F.when(value.cast(wanted) == value, value.cast(wanted))
    if isinstance(source, T.BooleanType):
        value = value.cast("int")
    elif not isinstance(source, T.NumericType):
        return F.lit(None).cast(value_type(column, exact))
    if column.type == "int" and isinstance(source, T.IntegralType):
        return value.cast("bigint")
    return _number(value, column, exact)


def _date(text: Column, pattern: str) -> Column:
    """Date in one pattern.  A miss in the general parser costs an exception per row, so text in
    a pattern of fixed places is matched first, rearranged and cast."""
    separators = re.sub("yyyy|MM|dd", "", pattern)
    if sorted(re.findall("yyyy|MM|dd", pattern)) != ["MM", "dd", "yyyy"] or separators.strip("-./ "):
        return F.try_to_date(text, pattern)
    shape = re.sub("yyyy|MM|dd", lambda m: rf"\d{{{len(m[0])}}}", pattern.replace(".", r"\."))
    places = [F.substring(text, pattern.index(part) + 1, len(part)) for part in ("yyyy", "MM", "dd")]
    return F.when(text.rlike(f"^{shape}$"), F.concat_ws("-", *places).try_cast("date"))


def _number(value: Column, column: S.Column, exact: bool) -> Column:
    as_double = value.try_cast("double")
    if column.type == "int" or exact:
        # Digits beyond the scale may only go where a double would not have kept them either.
        fixed = value.try_cast(T.DecimalType(38, column.scale) if exact else WIDE)
        lossless = fixed.cast("double") == as_double
        if exact:
            return F.when(lossless, fixed)
        return F.when(lossless & (fixed == F.floor(fixed)), fixed.try_cast("bigint"))
    return F.when(F.abs(as_double) < F.lit(float("inf")), as_double)
