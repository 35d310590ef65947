"""Hooks for user code: a model call over a prompt table, and error columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def call_model(prompts: DataFrame, fn: Callable[[list[dict]], str], *, stage: str, keys=("cohort_id", "run_id", "part"),
               max_parallel: int | None = None) -> DataFrame:
    """Call ``fn(messages) -> str`` once per prompt: ``<keys>, stage, attempt, raw, error``.

    Runs inside ``mapInPandas`` tasks.  An exception becomes the row's ``error``
    and never fails the job.  ``max_parallel`` bounds concurrent callers.  Write
    the result before using it twice, since a recomputed task calls again.
    """
    keys = [k for k in keys if k in prompts.columns]
    kinds = dict(prompts.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", stage string, attempt bigint, raw string, error string"
    todo = prompts.filter(F.col("messages").isNotNull()).select(*keys, F.to_json("messages").alias("_m"))
    if max_parallel:
        todo = todo.repartition(max_parallel)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            raws, errors = [], []
            for text in batch["_m"]:
                try:
                    raws.append(fn(json.loads(text)))
                    errors.append(None)
                except Exception as error:  # one bad prompt must not stop the others
                    raws.append(None)
                    errors.append(f"{stage}: {type(error).__name__}: {error}")
            yield batch[keys].assign(stage=stage, attempt=0, raw=raws, error=errors)

    return todo.mapInPandas(run, schema)


def add_error(df: DataFrame, condition: Column, message: str, *, output: str = "errors") -> DataFrame:
    """Append ``message`` to a row's error list where ``condition`` holds."""
    before = F.col(output) if output in df.columns else F.array().cast("array<string>")
    failed = F.coalesce(condition, F.lit(True))
    return df.withColumn(output, F.when(failed, F.array_append(before, message)).otherwise(before))


def guarded(df: DataFrame, value: Column, output: str, message: str) -> DataFrame:
    """Add ``value`` as a column and note ``message`` in ``errors`` where it is null."""
    return add_error(df.withColumn(output, value), F.col(output).isNull(), message)
