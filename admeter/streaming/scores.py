"""Appending scores of new runs as their result files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.compare import flatten_scores
from ..sinks import append_scores
from ..sources.runs import PATH_PARTS, RESULT_GLOB, evaluation_records


def score_stream(spark: SparkSession, base_dir: str, file_name: str, module_type: str, *,
                 max_files_per_trigger: int = 10_000) -> DataFrame:
    """Flattened scores of a growing run tree, as a stream.

    The same reader and flattening as in batch; each result file is read once.
    """
    files = (
        spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
        .text(f"{base_dir}/{RESULT_GLOB}/{file_name}", wholetext=True)
    )
    path = F.col("_metadata.file_path")
    named = files.select(
        F.regexp_extract(path, PATH_PARTS, 1).alias("cohort_id"),
        F.regexp_extract(path, PATH_PARTS, 2).alias("run_id"),
        F.col("value").alias("raw"),
    )
    return flatten_scores(evaluation_records(named), module_type)


def append_score_stream(scores: DataFrame, path: str, checkpoint_dir: str, *, format: str = "parquet",
                        available_now: bool = True, keys=("cohort_id", "version")) -> StreamingQuery:
    """Append a score stream to a table, once per run of a cohort.  Starts a query.

    A batch that is tried again, or a stream that starts over without its checkpoint, finds its runs in the table and leaves them out.
    """
    writer = (
        scores.writeStream.option("checkpointLocation", checkpoint_dir)
        .foreachBatch(lambda batch, _: append_scores(batch, path, format, keys=keys))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
