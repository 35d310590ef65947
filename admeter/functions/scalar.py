"""Scalar column helpers: guarded parsing, half-even rounding, safe division.

All of them are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

UNKNOWN = "Unknown"

# What counts as a number in text.  A plain try_cast would also take Java
# suffixes such as "1.5d" and would turn "nan" into NaN.
NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
INTEGER_TEXT = r"^\s*[+-]?\d+(\.0*)?\s*$"
ISO_DATE_TEXT = r"^\s*\d{4}-\d{1,2}-\d{1,2}"

# Month first with slashes, as advertising exports write it.
DEFAULT_DATE_FORMATS = ("M/d/yyyy",)


def number(df: DataFrame, name: str) -> Column:
    """Column ``name`` as DOUBLE; what is not a number becomes null."""
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return F.when(col.rlike(NUMERIC_TEXT), F.trim(col).try_cast("double"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = col.cast("double")
        return F.when(~F.isnan(value), value)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return col.cast("double")
    return col.try_cast("double")


def parse_timestamp(df: DataFrame, name: str, formats=DEFAULT_DATE_FORMATS) -> Column:
    """Column ``name`` as TIMESTAMP; unparseable text becomes null.

    ISO text is read by the cast; other layouts must be named in ``formats``.
    Each value is parsed on its own, whatever the first row looks like.
    """
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if not isinstance(kind, T.StringType):
        return col.try_cast("timestamp")
    value = F.trim(col)
    iso = F.when(value.rlike(ISO_DATE_TEXT), value.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(value, F.lit(f)) for f in formats])


def half_even(col: Column, digits: int = 2) -> Column:
    """Round to ``digits`` places, ties to even, in binary floating point."""
    scale = float(10 ** digits)
    return F.rint(col * scale) / scale


def safe_ratio(numerator: Column, denominator: Column, digits: int | None = 2) -> Column:
    """numerator / denominator; null on a zero denominator; rounded half-even."""
    ratio = numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
    return ratio if digits is None else half_even(ratio, digits)


def rounded(col: Column, digits: int = 2) -> Column:
    """A tidy float: two places, and null for NaN or an infinite value."""
    value = col.try_cast("double")
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite, half_even(value, digits))


def truncated_long(col: Column) -> Column:
    """A whole number, truncated toward zero; null when it does not fit."""
    value = col.try_cast("double")
    return F.when(~F.isnan(value), value.try_cast("bigint"))


def json_int(col: Column) -> Column:
    """A whole number that arrived as JSON text: 3, "3" and 3.0 but not 3.5."""
    return F.when(col.rlike(INTEGER_TEXT), F.trim(col).try_cast("double").try_cast("int"))


def text_or_unknown(df: DataFrame, name: str) -> Column:
    """Column ``name`` as text; "Unknown" for a null or an absent column."""
    if name not in df.columns:
        return F.lit(UNKNOWN)
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(UNKNOWN))


def only_if(condition: Column, value: Column) -> Column:
    """``[value]`` where ``condition`` holds, else ``[]``; to be joined with ``F.concat``.

    Unlike filtering an array with a lambda, this stays inside generated code,
    together with everything the values are computed from.
    """
    return F.when(condition, F.array(value)).otherwise(F.array())


def micros(col: Column) -> Column:
    """Money or a count in millionths, as a whole DECIMAL.

    Sums of decimals do not depend on the order of the rows, so totals are the same after a retry or a different
    partitioning, and 38 digits hold any total that a double can tell apart.
    """
    return F.rint(col.cast("double") * 1e6).cast("decimal(28,0)")


def micros_total(col: Column) -> Column:
    """Exact sum of a double column, as DOUBLE."""
    return F.sum(micros(col)).cast("double") / F.lit(1e6)
