"""Reading ad tables from files."""

from __future__ import annotations

import os
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import drop_null_columns, strip_headers

ORDINAL = "ordinal"
FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}


def _format_of(path: str) -> str:
    suffix = os.path.splitext(re.sub(r"[*?\]}/]+$", "", path))[1].lower()
    if suffix not in FORMATS:
        supported = ", ".join(FORMATS)
        raise ValueError(
            f"cannot read '{suffix}' files, only {supported}. "
            "For a directory or a glob pass format=."
        )
    return FORMATS[suffix]


def read(spark: SparkSession, source, *, format: str | None = None, options: dict | None = None,
         with_ordinal: bool = True) -> DataFrame:
    """Scan a file, directory, glob or list of paths; a DataFrame is passed through.

    CSV columns arrive as text: types are set later by a checked cast, never by
    inference, so a scan is one pass.  ``ordinal`` is the row's place in the
    input, ``STRUCT<file, block, pos>``: it does not depend on which task reads
    which split, so "last row wins" means the same after a retry.
    """
    if isinstance(source, DataFrame):
        return source
    paths = [str(p) for p in source] if isinstance(source, (list, tuple)) else [str(source)]
    kinds = {(format or _format_of(p)).lower() for p in paths}
    if len(kinds) > 1:
        raise ValueError(f"paths of several formats ({', '.join(sorted(kinds))}): read them one by one, or pass format=")
    kind = kinds.pop()
    if kind not in FORMATS.values():
        raise ValueError(f"unknown format '{kind}', choose from {', '.join(FORMATS.values())}")
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    elif kind == "json":
        reader = reader.option("multiLine", True)
    try:
        df = reader.options(**(options or {})).load(paths)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no such input: {', '.join(paths)}") from error
        raise
    if not with_ordinal:
        return df
    # Parquet knows a row's index, and filters still reach the scan past it.
    place = F.col("_metadata.row_index") if kind == "parquet" else F.monotonically_increasing_id()
    ordinal = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        place.alias("pos"),
    )
    return df.select("*", ordinal.alias(ORDINAL))


def load(spark: SparkSession, source, *, format: str | None = None, options: dict | None = None,
         strip_column_whitespace: bool = True, drop_all_null_columns: bool = True,
         with_ordinal: bool = True) -> DataFrame:
    """``read``, then strip headers and drop all-null columns (runs a job)."""
    df = read(spark, source, format=format, options=options, with_ordinal=with_ordinal)
    if strip_column_whitespace:
        df = strip_headers(df)
    if drop_all_null_columns:
        df = drop_null_columns(df)
    return df
