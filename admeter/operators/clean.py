"""Types, missing values and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.scalar import DEFAULT_DATE_FORMATS, number, parse_timestamp
from ..schema import IDENTITY_KEYS, NUMERIC_COLUMNS, ZERO_FILLED_COLUMNS
from .cohorts import positions


def enforce_types(df: DataFrame, *, parse_dates: bool = True, fill_missing_metrics_with_zero: bool = True,
                  date_formats=DEFAULT_DATE_FORMATS) -> DataFrame:
    """Cast ``date`` and the numeric columns; what does not parse becomes null, then 0 for core counts."""
    casts = {c: number(df, c) for c in NUMERIC_COLUMNS if c in df.columns}
    if parse_dates and "date" in df.columns:
        casts["date"] = parse_timestamp(df, "date", date_formats)
    typed = df.withColumns(casts) if casts else df
    return zero_fill(typed) if fill_missing_metrics_with_zero else typed


def zero_fill(df: DataFrame, columns=ZERO_FILLED_COLUMNS) -> DataFrame:
    """Null (or NaN) to 0 in the core counts; reach and frequency keep their gaps."""
    present = [c for c in columns if c in df.columns]
    return df.fillna(0, subset=present) if present else df


def _last_per_key(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    # "row_number = 1" is planned with a group limit before the shuffle, so each
    # task sends one row per key: a key with a third of all rows stays cheap.
    newest_first = W.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(F.col(ordinal).desc())
    return (
        df.withColumn("_copy", F.row_number().over(newest_first))
        .filter(F.col("_copy") == 1)
        .drop("_copy")
    )


def dedup_keep_last(df: DataFrame, *, ordinal: str = "ordinal", keys=None, extra_keys=()) -> DataFrame:
    """One row per identity key: the last one by ``ordinal``.  Nulls are equal.

    The default key ignores the campaign ``index``, so rows of two campaigns on
    one date and platform collapse; pass ``extra_keys=("index",)`` to keep both.
    Without any key column whole rows are compared.
    """
    wanted = [*(keys or IDENTITY_KEYS), *extra_keys]
    present = [c for c in wanted if c in df.columns]
    return _last_per_key(df, present, ordinal) if present else dedup_full_row(df, ordinal=ordinal)


def dedup_full_row(df: DataFrame, *, ordinal: str = "ordinal") -> DataFrame:
    """One copy of every distinct row: the last by ``ordinal``."""
    return _last_per_key(df, [c for c in df.columns if c != ordinal], ordinal)


def clean(df: DataFrame, *, ordinal: str = "ordinal", parse_dates: bool = True,
          fill_missing_metrics_with_zero: bool = True, remove_duplicates: bool = True,
          date_formats=DEFAULT_DATE_FORMATS, extra_keys=()) -> DataFrame:
    """Types, zero-fill and keyed de-duplication; each step can be switched off."""
    out = enforce_types(
        df, parse_dates=parse_dates, date_formats=date_formats,
        fill_missing_metrics_with_zero=fill_missing_metrics_with_zero,
    )
    return dedup_keep_last(out, ordinal=ordinal, extra_keys=extra_keys) if remove_duplicates else out


# Up to here a limit is one task's top-k; beyond it rows are numbered in slices.
TOP_K_ROWS = 100_000


def first_rows(df: DataFrame, n: int | None, *, ordinal: str = "ordinal") -> DataFrame:
    """The first ``n`` rows by ``ordinal``; None keeps all."""
    if n is None:
        return df
    if n <= TOP_K_ROWS:
        return df.orderBy(ordinal).limit(n)
    return positions(df, ordinal=ordinal, output="_place").filter(F.col("_place") < n).drop("_place")
