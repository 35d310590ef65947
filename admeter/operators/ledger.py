"""What became of every cohort: one row each, through all stages of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import only_if

#: Different messages of one cohort and stage that are spelled out; of the others the number is told.
MESSAGES = 20


def stage_outcome(rows: DataFrame, *, cohort: str = "cohort_id") -> DataFrame:
    """``cohort, n, n_valid, messages`` of a stage's checked rows (``valid``, ``violations`` and, if there, ``error``).

    Messages are the most frequent first, each with its number of rows if there are several.  They are counted before any are
    gathered, once for all uses, and ranked per cohort, so a cohort with many broken rows stays one short list.
    """
    error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
    message = F.when(~F.col("valid"), F.coalesce(error, F.array_join("violations", "; ")))
    kinds = rows.groupBy(cohort, message.alias("message")).agg(F.count("*").alias("rows"))
    failed = F.col("message").isNotNull()
    counted = kinds.groupBy(F.col(cohort).alias("_cohort")).agg(
        F.sum("rows").alias("n"), F.coalesce(F.sum(F.when(~failed, F.col("rows"))), F.lit(0)).alias("n_valid"), F.count_if(failed).alias("kinds"))
    in_order = W.partitionBy(cohort).orderBy(F.col("rows").desc(), "message")
    shown = kinds.filter(failed).withColumn("place", F.row_number().over(in_order)).filter(F.col("place") <= MESSAGES)
    text = F.concat("message", F.when(F.col("rows") > 1, F.concat(F.lit(" ("), F.col("rows").cast("string"), F.lit(" rows)"))).otherwise(""))
    listed = shown.groupBy(cohort).agg(F.sort_array(F.collect_list(F.struct("place", text.alias("text")))).alias("listed"))
    rest = F.col("kinds") - MESSAGES
    all_of = F.concat(F.coalesce(F.col("listed.text"), F.array().cast("array<string>")), only_if(rest > 0, F.concat(rest.cast("string"), F.lit(" more kinds"))))
    return counted.join(listed, F.col("_cohort").eqNullSafe(F.col(cohort)), "left").select(F.col("_cohort").alias(cohort), "n", "n_valid", all_of.alias("messages"))


def _prefixed(messages: Column, stage: str) -> Column:
    return F.transform(F.coalesce(messages, F.array().cast("array<string>")), lambda m: F.concat(F.lit(f"{stage}: "), m))


def outcome_ledger(cohorts: DataFrame, stages: dict[str, DataFrame], *, cohort: str = "cohort_id") -> DataFrame:
    """One row per cohort: ``cohort, last_stage, complete, errors``.

    ``cohorts`` names every cohort that came in; ``stages`` has the checked rows of each stage in order, one or more per cohort.
    Outer joins carry every cohort through, also one that only a stage knows.  ``last_stage`` is the last one with a valid row,
    "none" without; ``complete`` that all rows of all stages are valid; ``errors`` tells per stage what went wrong,
    or that it was not reached.
    """
    ledger = cohorts.select(cohort).distinct()
    for name, rows in stages.items():
        own = stage_outcome(rows, cohort=cohort)
        ledger = ledger.join(own.select(cohort, *[F.col(c).alias(f"_{name}_{c}") for c in ("n", "n_valid", "messages")]), cohort, "full")
    last, complete = F.lit("none"), F.lit(True)
    errors: list[Column] = []
    for name in stages:
        n, valid, messages = (F.col(f"_{name}_{c}") for c in ("n", "n_valid", "messages"))
        last = F.when(valid > 0, F.lit(name)).otherwise(last)
        complete = complete & F.coalesce(valid == n, F.lit(False))
        errors.append(only_if(n.isNull(), F.lit(f"{name}: not reached")))
        errors.append(_prefixed(messages, name))
    return ledger.select(cohort, last.alias("last_stage"), complete.alias("complete"), F.concat(*errors).alias("errors"))
