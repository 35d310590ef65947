"""Row summaries and cohort payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import rounded, text_or_unknown, truncated_long
from . import cohorts
from .diagnostics import totals
from .kpis import CORE_KPIS, GOAL_KPIS, METRICS, MetricRegistry, as_map, compute_metrics, goal_value, goals_with

IDENTITY_FIELDS = ("platform", "campaign_name", "date", "industry", "offering", "audience", "funnel_stage")
# Metrics every summary has, with the column each comes from.
MONEY = {"spend": "spend", "revenue": "conversion_value"}
COUNTS = ("impressions", "clicks", "conversions")
BASE_KPIS = ("roas", "cpa", "cvr", "ctr")


def identity_struct(df: DataFrame, goal: Column) -> Column:
    """The eight identity strings; the goal is the cohort's, the others the row's."""
    own = [text_or_unknown(df, name).alias(name) for name in IDENTITY_FIELDS]
    return F.struct(*own, F.coalesce(goal, text_or_unknown(df, "primary_goal")).alias("primary_goal"))


def _base_values(df: DataFrame) -> dict[str, Column]:
    def value(name: str, tidy) -> Column:
        return tidy(F.col(name)).cast("double") if name in df.columns else F.lit(None).cast("double")

    values = {name: value(source, rounded) for name, source in MONEY.items()}
    values |= {name: value(name, truncated_long) for name in COUNTS}
    return values | {name: value(name, rounded) for name in BASE_KPIS}


def summary_metrics(df: DataFrame, goal: Column, *, registry: MetricRegistry = METRICS) -> dict[str, Column]:
    """Nine base metrics overlaid by the goal's KPIs, each computed once.

    A goal KPI counts in rows of its goals only; where it is null a base metric
    of that name shows through.
    """
    values = _base_values(df)
    for kpi in dict.fromkeys(k for kpis in GOAL_KPIS.values() for k in kpis):
        own = F.when(goal.isin(goals_with(kpi)), goal_value(df, kpi, registry))
        values[kpi] = F.coalesce(own, values[kpi]) if kpi in values else own
    return values


def row_summaries(df: DataFrame, *, goal: str = "goal", registry: MetricRegistry = METRICS) -> DataFrame:
    """Add ``summary STRUCT<campaign_identity, performance_metrics>`` per row.

    ``goal`` names the column with the cohort's goal.  Base metrics keep their
    nulls, goal KPIs that are null are left out.
    """
    known = compute_metrics(df, CORE_KPIS, registry=registry)
    goal_col = F.col(goal) if goal in df.columns else F.lit(None).cast("string")
    values = summary_metrics(known, goal_col, registry=registry)
    done = as_map(known, values, "_metrics", always=tuple(_base_values(known)))
    summary = F.struct(
        identity_struct(known, goal_col).alias("campaign_identity"),
        F.col("_metrics").alias("performance_metrics"),
    )
    return done.withColumn("summary", summary).select(*df.columns, "summary")


def cohort_payloads(df: DataFrame, *, cohort: str = "cohort_id", ordinal: str = "ordinal", goal: str = "goal",
                    rows_per_part: int = 1000, slice_rows: int | None = None) -> DataFrame:
    """Row summaries of each cohort in order: ``cohort_id, part, n_parts, n_rows, payload ARRAY``.

    A payload is one value, so a cohort of more than ``rows_per_part`` rows
    becomes several parts; together, in order, they are the whole cohort.  Every
    group that is gathered has a bounded size, whatever the size of the cohort.

    ``df`` has ad rows.  Positions are found before the summaries are built, so
    that the wide summaries are shuffled once; columns ``position`` and
    ``n_rows`` (see ``cohorts.row_positions``) or ``summary`` that are already
    there are used.
    """
    if rows_per_part < 1:
        raise ValueError(f"rows_per_part must be positive, got: {rows_per_part}")
    placed = df
    if not {"position", "n_rows"} <= set(df.columns):
        placed = cohorts.row_positions(df, cohort=cohort, ordinal=ordinal, slice_rows=slice_rows)
    done = placed if "summary" in df.columns else row_summaries(placed, goal=goal)
    # structs sort by their first field, the position; a summary holds a map, which has no order, so it comes back from its entries
    entries = F.struct(F.col("summary.campaign_identity").alias("campaign_identity"), F.map_entries("summary.performance_metrics").alias("performance_metrics"))
    in_order = F.sort_array(F.collect_list(F.struct("position", entries.alias("summary"))))
    return (
        done.withColumn("part", F.floor(F.col("position") / rows_per_part).cast("bigint"))
        .groupBy(cohort, "part")
        .agg(F.max("n_rows").alias("n_rows"), in_order.alias("_rows"))
        .select(
            cohort, "part",
            F.ceil(F.col("n_rows") / rows_per_part).cast("bigint").alias("n_parts"),
            "n_rows",
            F.transform("_rows", lambda r: F.struct(
                r["summary"]["campaign_identity"].alias("campaign_identity"),
                F.map_from_entries(r["summary"]["performance_metrics"]).alias("performance_metrics"))).alias("payload"),
        )
    )


def overview_payloads(df: DataFrame, *, cohort: str = "cohort_id", goal: str = "goal", segment: str = "platform", most: int = 1000) -> DataFrame:
    """A payload per cohort that stands for all its rows: ``cohort_id, part, payload``, one summary of the totals per segment, those with
    the highest spend first and ``most`` at most."""
    summed = totals(df, [cohort, goal, segment])
    by_spend = W.partitionBy(cohort).orderBy(F.col("spend").desc_nulls_last(), segment)
    few = summed.withColumn("position", F.row_number().over(by_spend).cast("bigint") - 1).filter(F.col("position") < most)
    placed = few.withColumn("n_rows", F.count("*").over(W.partitionBy(cohort)))
    return cohort_payloads(placed, cohort=cohort, goal=goal, rows_per_part=most).select(cohort, "part", "payload")
