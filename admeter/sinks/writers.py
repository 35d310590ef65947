"""Writing run tables.

Partitioned writes go through ``REBALANCE``: rows of one partition value are
brought together so that a small cohort gives one file, and adaptive execution
splits a value that holds a large share of the rows over many tasks.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.cohorts import positions

FORMATS = ("parquet", "csv", "json")


def run_stamp(now: datetime | None = None) -> str:
    """``run_YYYYMMDD_HHMMSS``."""
    return f"run_{(now or datetime.now(timezone.utc)):%Y%m%d_%H%M%S}"


def stamp_run(df: DataFrame, run_id: str | None = None) -> DataFrame:
    """Add the run's id as a column, the key all run tables are partitioned by."""
    return df.withColumn("run_id", F.lit(run_id or run_stamp()))


def _flat(df: DataFrame, format: str) -> DataFrame:
    """CSV has no nested types: nested columns become JSON text."""
    if format != "csv":
        return df
    nested = ("struct", "array", "map")
    return df.select(*[
        F.to_json(name).alias(name) if kind.startswith(nested) else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ])


def write_run_table(df: DataFrame, path: str, *, partition_by=("run_id",), format: str = "parquet",
                    mode: str = "append", max_records_per_file: int = 0) -> None:
    """Write ``df`` partitioned by ``partition_by``.  Runs a job.

    ``mode="replace"`` replaces the partitions that ``df`` has and keeps all others, so a run that is repeated
    under its id does not double its rows.
    """
    if format not in FORMATS:
        raise ValueError(f"unknown format '{format}', choose from {', '.join(FORMATS)}")
    keys = list(partition_by)
    out = _flat(df, format)
    if keys:
        out = out.hint("rebalance", *keys)
    writer = out.write.mode("overwrite" if mode == "replace" else mode).format(format)
    if mode == "replace":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if format == "csv":
        writer = writer.option("header", True)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if keys:
        writer = writer.partitionBy(*keys)
    writer.save(path)


def write_results(df: DataFrame, base_dir: str, name: str, *, format: str = "json", mode: str = "append") -> None:
    """Write a per-cohort result table under ``<base>/<name>/cohort_id=…/run_id=…``.  Runs a job."""
    write_run_table(df, f"{base_dir}/{name}", partition_by=("cohort_id", "run_id"), format=format, mode=mode)


def append_scores(df: DataFrame, path: str, format: str = "csv", *, keys=()) -> None:
    """Append flattened scores to a table that grows run by run.  Runs a job.

    ``keys`` name what a run's scores are known by, such as ``("cohort_id", "version")``: rows whose keys the table has already are
    left out, so that a repeated append, or one after a crash, adds nothing twice.  A write appears whole or not at all.
    """
    if keys:
        df = df.join(_written_keys(df, path, format, list(keys)), [df[k].eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
    write_run_table(df, path, partition_by=(), format=format, mode="append")


def _written_keys(df: DataFrame, path: str, format: str, keys: list[str]) -> DataFrame:
    """The different keys of a table, as ``_<key>``; none where it does not exist yet."""
    spark, schema = df.sparkSession, df.schema
    try:
        reader = spark.read.schema(schema if format != "csv" else T.StructType([T.StructField(c, T.StringType()) for c in schema.names])).format(format)
        rows = (reader.option("header", True) if format == "csv" else reader).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    return rows.select(*[F.col(k).cast(schema[k].dataType).alias(f"_{k}") for k in keys]).distinct()


def write_dated_json(df: DataFrame, path: str, run_date: str | None = None) -> None:
    """Write rows as JSON under ``run_date=YYYY-MM-DD``.  Runs a job."""
    day = run_date or f"{datetime.now(timezone.utc):%Y-%m-%d}"
    write_run_table(df.withColumn("run_date", F.lit(day)), path, partition_by=("run_date",), format="json")


PROMPT_KEYS = ("cohort_id", "run_id", "prompt_name")


def archive_prompts(prompts: DataFrame, order_by: str = "part", *, marks: DataFrame | None = None) -> DataFrame:
    """Number the prompts of one ``(cohort, run, name)``: 0, 1, 2, …, or on from where ``marks`` says.

    The number replaces the counter that keeps file names apart.  ``order_by``
    tells the prompts of a group apart.  ``marks`` has, per key, the next free
    number (``high_water``).  Runs a job to find sort slices.
    """
    numbered = positions(prompts, ordinal=order_by, by=list(PROMPT_KEYS), output="attempt")
    if marks is None:
        return numbered
    known = marks.select(*[F.col(k).alias(f"_{k}") for k in PROMPT_KEYS], F.col("next").alias("_next"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in PROMPT_KEYS])
    on_from = F.col("attempt") + F.coalesce("_next", F.lit(0))
    return numbered.join(known, on, "left").select(*prompts.columns, on_from.cast("bigint").alias("attempt"))


def high_water(*marks: DataFrame) -> DataFrame:
    """``cohort_id, run_id, prompt_name, next``: the next free number per key, of archives (``attempt``) and tables of marks, merged by maximum."""
    parts = [m.select(*PROMPT_KEYS, (F.col("next") if "next" in m.columns else F.col("attempt") + 1).alias("next")) for m in marks]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy(*PROMPT_KEYS).agg(F.max("next").cast("bigint").alias("next"))


def append_prompts(prompts: DataFrame, path: str, order_by: str = "part") -> DataFrame:
    """Append prompts to an archive table; their numbers go on from those it holds.  Returns the numbered prompts.  Runs jobs.

    Marks stand beside the archive, a row per key and call; they are written first, so that a call that breaks off
    leaves a gap rather than a number twice.
    """
    spark, marked = prompts.sparkSession, f"{path}_marks"
    schema = T.StructType([*[T.StructField(k, prompts.schema[k].dataType) for k in PROMPT_KEYS], T.StructField("next", T.LongType())])
    try:
        known = high_water(spark.read.schema(schema).parquet(marked))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], schema)
    numbered = archive_prompts(prompts, order_by, marks=known)
    high_water(numbered).write.mode("append").parquet(marked)
    # the marks just written name the numbers: next less the rows of this call
    counted = prompts.groupBy(*PROMPT_KEYS).agg(F.count("*").alias("n"))
    upto = high_water(spark.read.schema(schema).parquet(marked))
    same = reduce(lambda a, b: a & b, [upto[k].eqNullSafe(counted[k]) for k in PROMPT_KEYS])
    first = upto.join(counted, same).select(*[upto[k] for k in PROMPT_KEYS], (F.col("next") - F.col("n")).alias("next"))
    numbered = archive_prompts(prompts, order_by, marks=first)
    write_run_table(numbered, path, partition_by=PROMPT_KEYS, mode="append")
    return numbered
