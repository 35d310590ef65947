"""Splitting ad rows into campaign cohorts, and places of rows within them."""

from __future__ import annotations

from functools import reduce
from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.scalar import UNKNOWN, text_or_unknown

CONTEXT_FIELDS = ("primary_goal", "industry", "offering", "audience", "funnel_stage")


# A group up to this size is numbered by one task whatever the size of the table.
SLICE_ROWS = 10_000
# Offsets are broadcast up to this number of rows, some tens of megabytes.
BROADCAST_ROWS = 500_000


def _sort_slices(df: DataFrame, ordinal: str, n_slices: int) -> DataFrame:
    """Add ``_slice``: consecutive slices of the order of ``ordinal``.

    A scan ordinal (a struct) is sliced by input split.  Any other ordinal is
    sliced at approximate quantiles of its place in the order; they only balance
    the slices, so the result does not depend on how exact they are.  The slice is a function of the row
    alone, hence the same on every attempt.
    """
    kind = df.schema[ordinal].dataType
    if isinstance(kind, T.StructType):
        return df.withColumn("_slice", F.struct(*[F.col(f"{ordinal}.{f}") for f in kind.names[:-1]]))
    placed = df.withColumn("_place", _place(df, ordinal))
    # n - 1 numbers, whatever the size of the table
    cuts = placed.agg(F.percentile_approx("_place", [i / n_slices for i in range(1, n_slices)], 10 * n_slices)).first()[0]
    inner = sorted({c for c in cuts or [] if isfinite(c)}) or [0.0]
    splits = [float("-inf"), *inner, float("inf")]
    slicer = Bucketizer(splits=splits, inputCol="_place", outputCol="_slice", handleInvalid="keep")
    # nulls come first in the order, so they are a slice of their own before all others
    return slicer.transform(placed).withColumn("_slice", F.coalesce(F.col("_slice").cast("int"), F.lit(-1))).drop("_place")


def _place(df: DataFrame, ordinal: str) -> Column:
    """A number that never falls along the order of ``ordinal``, whatever its type; it need not tell all values apart."""
    kind, value = df.schema[ordinal].dataType, F.col(ordinal)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value)
        return F.unix_date(value.cast("date")).cast("double") * 86400.0 + seconds
    if isinstance(kind, (T.StringType, T.BinaryType)):
        # bytes decide the order; six of them, after those that the smallest and the largest value share, make a number
        ends = df.agg(F.min(ordinal), F.max(ordinal)).first()
        first, last = [v.encode() if isinstance(v, str) else bytes(v or b"") for v in ends]
        shared = next((i for i, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))
        digits = F.hex(F.substring(value.cast("binary"), shared + 1, 6))
        return F.conv(F.rpad(digits, 12, "0"), 16, 10).cast("double")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    return F.when(value.isNotNull(), F.lit(0.0))  # no known order: one slice


def positions(df: DataFrame, *, ordinal: str = "ordinal", by=(), output: str = "position",
              total: str | None = None, slice_rows: int | None = None) -> DataFrame:
    """Add the 0-based place of each row in the order of ``ordinal``, per ``by``.

    A group with more than ``slice_rows`` rows (default: a task's fair share of
    the table) is numbered within slices of the order, then shifted by the size
    of its earlier slices, so no task ever sorts a large group.  All others are
    numbered by a plain window.  ``total`` names a column for the group's size.
    Runs a job to measure the groups and, if one is large, two to slice it.
    """
    by = list(by)
    n_tasks = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    n_rows, largest = (v or 0 for v in sizes.agg(F.sum("_n"), F.max("_n")).first())
    limit = slice_rows or max(n_rows // n_tasks, SLICE_ROWS)
    if largest <= limit:
        group = W.partitionBy(*by)
        out = df.withColumn(output, F.row_number().over(group.orderBy(ordinal)).cast("bigint") - 1)
        return out.withColumn(total, F.count("*").over(group)) if total else out

    n_slices = min(n_tasks, -(-n_rows // limit))
    sliced = _sort_slices(df, ordinal, n_slices)
    if by:
        # Fewer than n_rows / limit groups can be larger than the limit.
        large = sizes.filter(F.col("_n") > limit).select(*by).collect()
        marks = df.sparkSession.createDataFrame(large, df.select(*by).schema)
        marks = marks.toDF(*[f"_large_{k}" for k in by]).withColumn("_large", F.lit(True))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in by])
        sliced = sliced.join(F.broadcast(marks), same, "left").withColumn(
            "_slice", F.when(F.col("_large"), F.col("_slice")))
        measured = sliced.filter("_large")
    else:
        measured = sliced
    earlier = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    # one row per large group and slice
    offsets = measured.groupBy(*by, "_slice").agg(F.count("*").alias("_n")).select(
        *[F.col(k).alias(f"_key_{k}") for k in by], F.col("_slice").alias("_key_slice"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(W.partitionBy(*by)).alias("_total"))
    group = W.partitionBy(*by, "_slice")
    placed = sliced.withColumn("_within", F.row_number().over(group.orderBy(ordinal)))
    if total:
        placed = placed.withColumn("_in_group", F.count("*").over(group))
    # The number of input splits is not bounded, that of quantile slices is, with one more for nulls.
    counted = not isinstance(df.schema[ordinal].dataType, T.StructType)
    if counted and (len(large) if by else 1) * (n_slices + 1) <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)  # at most this many rows of a key and two numbers
    on = F.col("_slice").eqNullSafe(F.col("_key_slice"))
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    place = F.coalesce(F.col("_offset"), F.lit(0)) + F.col("_within") - 1
    return placed.join(offsets, on, "left").select(
        *df.columns, place.cast("bigint").alias(output),
        *([F.coalesce("_total", "_in_group").alias(total)] if total else []))


def by_index(df: DataFrame, index: str = "index") -> tuple[DataFrame, DataFrame]:
    """Cohorts ``campaign_<index>``; returns (rows with ``cohort_id``, rows without an index)."""
    key = F.col(f"`{index}`").cast("string")
    rows = df.filter(key.isNotNull()).withColumn("cohort_id", F.concat(F.lit("campaign_"), key))
    return rows, df.filter(key.isNull())


def cohort_order(df: DataFrame, *, cohort: str = "cohort_id", ordinal: str = "ordinal") -> DataFrame:
    """One row per cohort with its size and first ordinal: order by it for first-seen order."""
    return df.groupBy(cohort).agg(F.min(ordinal).alias("first_ordinal"), F.count("*").alias("n_rows"))


def by_batch(df: DataFrame, size: int = 6, *, ordinal: str = "ordinal", slice_rows: int | None = None) -> DataFrame:
    """Cohorts of ``size`` consecutive rows, labelled ``batch_<first>_<last>``, counted from 1."""
    if size < 1:
        raise ValueError(f"batch size must be positive, got: {size}")
    placed = positions(df, ordinal=ordinal, output="_i", total="_rows", slice_rows=slice_rows)
    start = F.floor(F.col("_i") / size).cast("bigint") * size
    end = F.least(start + size, F.col("_rows"))  # the last batch may be short
    label = F.concat(F.lit("batch_"), (start + 1).cast("string"), F.lit("_"), end.cast("string"))
    return placed.withColumn("cohort_id", label).drop("_i", "_rows")


def assign(df: DataFrame, *, batch_size: int = 6, ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame | None]:
    """Cohorts by ``index`` when the column exists, else by batch: (rows, rejects)."""
    if "index" in df.columns:
        return by_index(df)
    return by_batch(df, batch_size, ordinal=ordinal), None


def first_row_context(df: DataFrame, *, cohort: str = "cohort_id", ordinal: str = "ordinal") -> DataFrame:
    """Goal and business domain of each cohort, taken from its first row.

    Output ``cohort_id, campaign_target STRUCT, business_domain STRUCT``.  The
    first row is an aggregate with map-side combine, not a per-cohort sort.
    """
    fields = F.struct(*[text_or_unknown(df, name).alias(name) for name in CONTEXT_FIELDS])
    first = df.groupBy(cohort).agg(F.min_by(fields, F.col(ordinal)).alias("c"))
    return first.select(
        cohort,
        F.struct(F.col("c.primary_goal").alias("primary_goal")).alias("campaign_target"),
        F.struct(*[F.col(f"c.{n}").alias(n) for n in CONTEXT_FIELDS[1:]]).alias("business_domain"),
    )


def row_positions(df: DataFrame, *, cohort: str = "cohort_id", ordinal: str = "ordinal",
                  slice_rows: int | None = None) -> DataFrame:
    """Add ``position``, the 0-based place of each row in its cohort, and the cohort's ``n_rows``."""
    return positions(df, ordinal=ordinal, by=[cohort], total="n_rows", slice_rows=slice_rows)


def with_goal(df: DataFrame, context: DataFrame, *, cohort: str = "cohort_id", output: str = "goal") -> DataFrame:
    """Add each row's cohort goal.

    One small row per cohort is joined to the rows; the planner broadcasts it
    while its measured size allows, and otherwise splits a skewed cohort.
    """
    goals = context.select(cohort, F.col("campaign_target.primary_goal").alias(output))
    return df.join(goals, cohort, "left").withColumn(output, F.coalesce(F.col(output), F.lit(UNKNOWN)))
