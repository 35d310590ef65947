"""Comparing runs: one scan of all saved evaluations, one aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..operators import compare
from ..sinks import read_committed, write_run_table
from ..sources import evaluation_records, read_result_text
from ..sources.runs import ANALYSIS_EVALUATION, RECOMMENDATION_EVALUATION, list_results

FILES = {compare.ANALYSIS: ANALYSIS_EVALUATION, compare.RECOMMENDATION: RECOMMENDATION_EVALUATION}


def compare_versions(records: DataFrame, module_type: str, *, last_n: int | None = None, strict: bool = False) -> DataFrame:
    """Version summary of evaluation records (``cohort_id, version, scores``)."""
    flat = compare.flatten_scores(records, module_type, strict=strict)
    return compare.sort_versions(compare.version_summary(flat, module_type, last_n=last_n))


def _scores_of_flow(spark: SparkSession, base_dir: str, module_type: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Runs and flat scores of the tables that ``run_campaigns`` committed; a run's cohorts are those with a prompt."""
    runs, saved = read_committed(spark, base_dir, "analysis_messages"), read_committed(spark, base_dir, f"{module_type}_evaluations")
    if runs is not None:
        runs = runs.select("cohort_id", "run_id")
    if saved is None:
        return runs, None
    scored = saved.filter("valid").withColumnRenamed("run_id", "version")
    return runs, compare.flatten_scores(scored, module_type)


def _scores_of_files(spark: SparkSession, base_dir: str, module_type: str, strict: bool) -> tuple[DataFrame, DataFrame]:
    """Runs and flat scores of a tree of JSON result files.  Runs are ranked by a listing, without opening files."""
    files = read_result_text(spark, base_dir)
    scored = files.filter(files["file_name"] == FILES[module_type])
    return list_results(spark, base_dir).select("cohort_id", "run_id"), compare.flatten_scores(evaluation_records(scored), module_type, strict=strict)


def compare_runs(spark: SparkSession, base_dir: str, module_type: str, *, last_n: int | None = None,
                 strict: bool = False, output: str | None = None) -> DataFrame:
    """Version summary of every campaign under ``base_dir``: of the flow's own tables, of a tree of result files, or of both.

    ``last_n`` counts all runs of a campaign, also those that were never scored.  ``strict`` stops at a result file
    whose scores are of no known kind.  ``output`` names a folder to write the summary to as CSV.
    """
    compare.metrics_of(module_type)
    runs, flat = _scores_of_flow(spark, base_dir, module_type)
    found = [(runs, flat)] if runs is not None else []
    try:
        found.append(_scores_of_files(spark, base_dir, module_type, strict))
    except FileNotFoundError:
        if not found:
            raise
    scores = [f for _, f in found if f is not None and not f.isEmpty()]
    if not scores:
        raise FileNotFoundError(f"no {module_type} scores below {base_dir}")
    flat = compare.union_runs(scores)
    if last_n is not None:
        newest = compare.last_n_runs(reduce(DataFrame.unionByName, [r for r, _ in found]).distinct(), last_n)
        flat = flat.join(newest.withColumnRenamed("run_id", "version"), ["cohort_id", "version"], "left_semi")
    summary = compare.sort_versions(compare.version_summary(flat, module_type))
    if output is not None:
        write_run_table(summary, output, partition_by=(), format="csv", mode="overwrite")
    return summary
