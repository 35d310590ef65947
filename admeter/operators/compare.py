"""Comparing run versions by their evaluation scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.scalar import micros
from .responses import ANALYSIS_CRITERIA
from .scoring import AVERAGED_CRITERIA

ANALYSIS, RECOMMENDATION = "analysis", "recommendation"
METRICS = {
    ANALYSIS: (*ANALYSIS_CRITERIA, "overall"),
    RECOMMENDATION: (*AVERAGED_CRITERIA, "Overall"),
}


def metrics_of(module_type: str) -> tuple[str, ...]:
    """Score names that are compared for a kind of reply."""
    if module_type not in METRICS:
        raise ValueError(f"unknown kind of scores: {module_type}")
    return METRICS[module_type]


def score_type(scores: Column) -> Column:
    """"analysis" or "recommendation" by the keys of a score map; null for neither."""
    keys = F.map_keys(scores)

    def has_all(kind: str) -> Column:
        return F.size(F.array_except(F.array(*[F.lit(m) for m in METRICS[kind]]), keys)) == 0

    return F.when(has_all(ANALYSIS), ANALYSIS).when(has_all(RECOMMENDATION), RECOMMENDATION)


def unknown_scores(records: DataFrame) -> DataFrame:
    """Records whose score maps are of no known kind, with the names they lack for each kind.

    These are what ``flatten_scores`` leaves out: older or broken result files.
    """
    keys = F.coalesce(F.map_keys("scores"), F.array().cast("array<string>"))
    lacking = {f"missing_for_{kind}": F.array_except(F.array(*[F.lit(m) for m in names]), keys) for kind, names in METRICS.items()}
    return records.filter(score_type(F.col("scores")).isNull()).withColumns(lacking)


def flatten_scores(records: DataFrame, module_type: str, *, keys=("cohort_id", "version"), strict: bool = False) -> DataFrame:
    """One column per compared score, from the records whose ``scores`` are of this kind.

    ``scores`` is a map, as read from files, or the struct that scoring gives,
    whose kind is known from its type.  Records of no known kind are left out
    (``unknown_scores`` gives them); with ``strict`` they end the job instead.
    """
    names = metrics_of(module_type)
    kind = records.schema["scores"].dataType
    if isinstance(kind, T.StructType):
        absent = [n for n in names if n not in kind.names]
        if absent:
            raise ValueError(f"scores lack {absent} for '{module_type}'")
        return records.select(*keys, *[F.col(f"scores.{n}").cast("double").alias(n) for n in names])
    found = score_type(F.col("scores"))
    if strict:
        message = F.concat(F.lit("scores of no known kind: "), F.coalesce(F.to_json(F.map_keys("scores")), F.lit("none")))
        found = F.coalesce(found, F.raise_error(message).cast("string"))
    return records.filter(found == module_type).select(
        *keys, *[F.element_at("scores", n).alias(n) for n in names])


def check_score_columns(df: DataFrame, module_type: str) -> DataFrame:
    """Raise when a score column is missing."""
    missing = [c for c in ("version", *metrics_of(module_type)) if c not in df.columns]
    if missing:
        raise ValueError(
            f"{module_type} scores lack columns {missing}, the table has {df.columns}")
    return df


def union_runs(frames: list[DataFrame]) -> DataFrame:
    """Stack score tables; a column that one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def version_summary(df: DataFrame, module_type: str, *, cohort: str = "cohort_id", last_n: int | None = None) -> DataFrame:
    """Mean of each score per cohort and version, for all cohorts in one aggregate.

    ``last_n`` keeps each cohort's newest versions.  It ranks the summary, one
    row per version, rather than the scored rows.
    """
    check_score_columns(df, module_type)
    summary = df.groupBy(cohort, "version").agg(*[F.avg(m).alias(m) for m in metrics_of(module_type)])
    return summary if last_n is None else _newest(summary, "version", last_n, cohort)


STATE_KEYS = ("version", "metric")


def summary_state(df: DataFrame, module_type: str, *, cohort: str = "cohort_id") -> DataFrame:
    """What a mean needs of scored rows: ``cohort, version, metric, total, n``; totals in whole millionths, so their order doesn't matter."""
    check_score_columns(df, module_type)
    long = df.unpivot([cohort, "version"], list(metrics_of(module_type)), "metric", "score").filter(F.col("score").isNotNull())
    return long.groupBy(cohort, *STATE_KEYS).agg(F.sum(micros(F.col("score"))).cast("decimal(38,0)").alias("total"), F.count("*").alias("n"))


def merge_states(*states: DataFrame, cohort: str = "cohort_id") -> DataFrame:
    """One state of several: of the stored one and of those of new runs, in any order."""
    both = reduce(lambda a, b: a.unionByName(b), states)
    return both.groupBy(cohort, *STATE_KEYS).agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"))


def summary_of_state(state: DataFrame, module_type: str, *, cohort: str = "cohort_id", last_n: int | None = None) -> DataFrame:
    """The version summary that a state holds, as ``version_summary`` gives it; reads a few rows per version, however many were scored."""
    mean = F.col("total").cast("double") / F.lit(1e6) / F.col("n")
    summary = state.groupBy(cohort, "version").agg(*[F.max(F.when(F.col("metric") == m, mean)).alias(m) for m in metrics_of(module_type)])
    return summary if last_n is None else _newest(summary, "version", last_n, cohort)


def sort_versions(summary: DataFrame, *, cohort: str = "cohort_id") -> DataFrame:
    return summary.orderBy(cohort, "version")


def _newest(one_per_run: DataFrame, run: str, n: int, cohort: str) -> DataFrame:
    if n <= 0:
        raise ValueError(f"last_n counts runs and must be at least 1, got {n}")
    newest = W.partitionBy(cohort).orderBy(F.col(run).desc())
    return one_per_run.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def last_n_runs(df: DataFrame, n: int | None, *, run: str = "run_id", cohort: str = "cohort_id") -> DataFrame:
    """Rows of the newest ``n`` runs of each cohort; None keeps all.

    Runs are ranked after a distinct, so the rows of a hot cohort are never
    brought to one task; they then meet the few kept runs in a semi join.
    """
    if n is None:
        return df
    runs = _newest(df.select(cohort, run).distinct(), run, n, cohort)
    return df.join(runs, [cohort, run], "left_semi")


def metric_version_matrix(summary: DataFrame, module_type: str, versions: list[str] | None = None, *,
                          cohort: str = "cohort_id") -> DataFrame:
    """Scores as rows, versions as columns: the table behind a comparison chart.

    Pass ``versions`` to fix the columns; otherwise a job collects their names.
    """
    names = list(metrics_of(module_type))
    long = summary.unpivot([cohort, "version"], names, "metric", "score")
    return long.groupBy(cohort, "metric").pivot("version", versions).agg(F.first("score"))


def lower_text(df: DataFrame, column: str = "version") -> DataFrame:
    """Lower-case a text column so that spellings of one version meet."""
    return df.withColumn(column, F.lower(column))
