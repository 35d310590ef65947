"""Checks an analyst runs on a cohort: platforms, trends, saturation, unit economics.

Input tables have one row per ad row with ``cohort_id, platform, date`` and the
measures.  Totals are ratios of sums.  Trends and thresholds work on the daily
table, one row per (cohort, platform, date), so that window groups are bounded
by the number of days and not by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import half_even, micros_total, number
from .kpis import GOAL_KPIS, METRICS as REGISTRY, RATIOS, MetricRegistry, goal_kpi_map, goal_value, ratio_of

# --- fixed values --------------------------------------------------------------
ADDITIVE = (
    "impressions", "clicks", "spend", "conversions", "conversion_value", "reach", "landing_page_views", "sessions",
    "purchases", "total_revenue", "total_marketing_spend", "refunds", "orders",
    "lifetime_value", "cac", "monthly_gross_profit_per_customer",
)
# goal: KPI that ranks platforms, and whether more is better
GOAL_RANKING = {
    "Increase Sales": ("roas", True),
    "Brand Awareness": ("cpm", False),
    "Revenue Efficiency": ("mer", True),
    "Traffic": ("ctr", True),
}
DEFAULT_RANKING = ("roas", True)
SATURATION_FREQUENCY = 4.0
MIN_LTV_TO_CAC = 3.0
BREAK_EVEN_ROAS = 1.0
# -------------------------------------------------------------------------------


def totals(df: DataFrame, keys, *, rounding: str = "stepwise") -> DataFrame:
    """Sums of the measures per ``keys`` and the KPIs as ratios of those sums."""
    measures = [c for c in ADDITIVE if c in df.columns]
    summed = df.groupBy(*keys).agg(*[micros_total(number(df, c)).alias(c) for c in measures])
    ratios = {
        name: ratio_of(name, F.col(n), F.col(d), rounding)
        for name, (n, d) in RATIOS.items() if n in measures and d in measures and name not in keys
    }
    return summed.withColumns(ratios)


def daily(df: DataFrame, *, cohort: str = "cohort_id", rounding: str = "stepwise") -> DataFrame:
    """Totals per (cohort, platform, date)."""
    day = df.withColumn("date", F.to_date("date"))
    return totals(day, [cohort, "platform", "date"], rounding=rounding)


def platform_comparison(df: DataFrame, *, cohort: str = "cohort_id", goal: str = "goal",
                        rounding: str = "stepwise") -> DataFrame:
    """Totals and KPIs per platform of each cohort, ranked by the goal's KPI.

    ``goal`` is a column that is constant within a cohort; without it platforms
    are ranked by ROAS.
    """
    has_goal = goal in df.columns
    out = totals(df, [cohort, *([goal] if has_goal else []), "platform"], rounding=rounding)

    def signed(kpi: str, more_is_better: bool) -> Column:
        value = F.col(kpi) if kpi in out.columns else F.lit(None).cast("double")
        return value if more_is_better else -value

    score = signed(*DEFAULT_RANKING)
    if has_goal:
        for name, ranking in GOAL_RANKING.items():
            score = F.when(F.col(goal) == name, signed(*ranking)).otherwise(score)
    best_first = W.partitionBy(cohort).orderBy(F.col("_score").desc_nulls_last())
    return (
        out.withColumn("_score", score)
        .withColumn("platform_rank", F.rank().over(best_first).cast("bigint"))
        .drop("_score")
    )


def kpi_trend(df: DataFrame, kpis, *, cohort: str = "cohort_id", rounding: str = "stepwise") -> DataFrame:
    """Daily KPIs with ``<kpi>_change``: the difference to the previous date of the platform."""
    in_time = W.partitionBy(cohort, "platform").orderBy("date")
    days = daily(df, cohort=cohort, rounding=rounding)
    changes = {f"{k}_change": half_even(F.col(k) - F.lag(k).over(in_time)) for k in kpis}
    return days.select(cohort, "platform", "date", *kpis).withColumns(changes)


def rising_cpc(df: DataFrame, **options) -> DataFrame:
    """Days on which CPC rose while neither CTR nor clicks did."""
    trend = kpi_trend(df, ["cpc", "ctr", "clicks"], **options)
    return trend.filter((F.col("cpc_change") > 0) & (F.col("ctr_change") <= 0) & (F.col("clicks_change") <= 0))


def cpm_drift(df: DataFrame, *, tolerance: float = 0.0, **options) -> DataFrame:
    """Daily CPM with its change and ``direction``: up, down or flat within ``tolerance``."""
    change = F.col("cpm_change")
    direction = F.when(change > tolerance, "up").when(change < -tolerance, "down").when(change.isNotNull(), "flat")
    return kpi_trend(df, ["cpm"], **options).withColumn("direction", F.coalesce(direction, F.lit("unknown")))


def mer_decline(df: DataFrame, **options) -> DataFrame:
    """Days on which the marketing efficiency ratio fell."""
    return kpi_trend(df, ["mer"], **options).filter(F.col("mer_change") < 0)


# Bins of the quantile sketch: 32 for each doubling of a value's size.
BINS = 32.0


def _bin(value: Column) -> Column:
    """A whole number that never falls as the value rises."""
    size = F.floor(F.log2(F.abs(value)) * BINS) + 40_000
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("bigint")


def exact_quantiles(df: DataFrame, quantiles: dict[str, tuple[str, float]], *, by: str) -> DataFrame:
    """One row per group: ``by`` and, for each ``{output: (column, q)}``, the least value that a share of ``q`` of the values does not exceed.

    Counts of logarithmic bins, a sketch that any two tasks' rows merge into by adding, tell in which bin a quantile lies and how
    far up; only the different values of that bin are then counted.  No task holds the values of a group.
    """
    value = F.array(*[F.struct(F.lit(name).alias("name"), F.col(column).cast("double").alias("value"), F.lit(float(q)).alias("q")) for name, (column, q) in quantiles.items()])
    long = df.select(by, F.explode(value).alias("x")).select(by, "x.*").filter(F.col("value").isNotNull())
    # one count per value of two decimals, made before the shuffle
    counted = long.groupBy(by, "name", "q", "value").agg(F.count("*").alias("n")).withColumn("bin", _bin(F.col("value")))
    bins = counted.groupBy(by, "name", "q", "bin").agg(F.sum("n").alias("n"))
    group = W.partitionBy(by, "name")
    upto = F.sum("n").over(group.orderBy("bin"))
    rank = F.greatest(F.ceil(F.col("q") * F.sum("n").over(group)), F.lit(1))
    placed = bins.withColumns({"upto": upto, "rank": rank}).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    cut = placed.select(F.col(by).alias("_by"), F.col("name").alias("_name"), F.col("bin").alias("_bin"), (F.col("rank") - F.col("upto") + F.col("n")).alias("_left"))
    inside = counted.join(cut, F.col(by).eqNullSafe(F.col("_by")) & (F.col("name") == F.col("_name")) & (F.col("bin") == F.col("_bin")))
    running = inside.withColumn("_upto", F.sum("n").over(W.partitionBy(by, "name").orderBy("value")))
    found = running.filter(F.col("_upto") >= F.col("_left")).groupBy(by, "name").agg(F.min("value").alias("value"))
    return found.groupBy(by).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in quantiles])


def with_thresholds(df: DataFrame, quantiles: dict[str, tuple[str, float]], *, cohort: str = "cohort_id") -> DataFrame:
    """Add per-cohort quantiles: ``{output: (column, q)}``, exact and discrete; null for a column without values in the cohort."""
    cuts = exact_quantiles(df, quantiles, by=cohort).withColumnRenamed(cohort, "_cohort")
    return df.join(cuts, F.col(cohort).eqNullSafe(F.col("_cohort")), "left").drop("_cohort")


def weak_traffic(df: DataFrame, *, quantile: float = 0.25, cohort: str = "cohort_id", **options) -> DataFrame:
    """Days with a low CPC and a low CTR for the cohort: cheap clicks of little intent."""
    days = daily(df, cohort=cohort, **options).select(cohort, "platform", "date", "cpc", "ctr")
    cut = with_thresholds(days, {"cpc_low": ("cpc", quantile), "ctr_low": ("ctr", quantile)}, cohort=cohort)
    return cut.filter((F.col("cpc") <= F.col("cpc_low")) & (F.col("ctr") <= F.col("ctr_low")))


def clicks_without_conversions(df: DataFrame, *, high: float = 0.75, low: float = 0.25,
                               cohort: str = "cohort_id", **options) -> DataFrame:
    """Days with many clicks but a low conversion rate for the cohort."""
    days = daily(df, cohort=cohort, **options).select(cohort, "platform", "date", "clicks", "cvr", "spend")
    cut = with_thresholds(days, {"clicks_high": ("clicks", high), "cvr_low": ("cvr", low)}, cohort=cohort)
    return cut.filter((F.col("clicks") >= F.col("clicks_high")) & (F.col("cvr") <= F.col("cvr_low")))


def scale_opportunities(df: DataFrame, *, target_cpa: float | None = None, quantile: float = 0.25,
                        cohort: str = "cohort_id", segment: str = "platform", **options) -> DataFrame:
    """Segments with a CPA at or below a target, or in the cohort's lowest quantile."""
    parts = totals(df, [cohort, segment], **options).select(cohort, segment, "spend", "conversions", "cpa")
    if target_cpa is not None:
        return parts.filter(F.col("cpa") <= target_cpa)
    return with_thresholds(parts, {"cpa_low": ("cpa", quantile)}, cohort=cohort).filter(
        F.col("cpa") <= F.col("cpa_low"))


def value_leakage(df: DataFrame, *, segment: str = "campaign_type", high: float = 0.75, low: float = 0.25,
                  cohort: str = "cohort_id", **options) -> DataFrame:
    """Segments with a high refund rate or a low order value for the cohort."""
    parts = totals(df, [cohort, segment], **options).select(cohort, segment, "refund_rate", "aov")
    cut = with_thresholds(parts, {"refund_high": ("refund_rate", high), "aov_low": ("aov", low)}, cohort=cohort)
    refunds = F.coalesce(F.col("refund_rate") >= F.col("refund_high"), F.lit(False))
    cheap = F.coalesce(F.col("aov") <= F.col("aov_low"), F.lit(False))
    return cut.withColumns({"high_refunds": refunds, "low_order_value": cheap}).filter(
        F.col("high_refunds") | F.col("low_order_value"))


def saturation(df: DataFrame, *, threshold: float = SATURATION_FREQUENCY, **options) -> DataFrame:
    """Daily frequency with ``saturated`` (at the threshold or above) and
    ``fatigued`` (saturated while CTR falls)."""
    trend = kpi_trend(df, ["frequency", "ctr"], **options)
    saturated = F.coalesce(F.col("frequency") >= threshold, F.lit(False))
    falling = F.coalesce(F.col("ctr_change") < 0, F.lit(False))
    return trend.withColumns({"saturated": saturated, "fatigued": saturated & falling})


def landing_page_gap(df: DataFrame, *, registry: MetricRegistry = REGISTRY) -> DataFrame:
    """Add ``bounce_proxy_rate`` per row and ``landing_views_missing`` when it cannot be told."""
    rate = registry.column(df, "bounce_proxy_rate")
    rate = rate if rate is not None else F.lit(None).cast("double")
    absent = F.col("landing_page_views").isNull() if "landing_page_views" in df.columns else F.lit(True)
    return df.withColumns({"bounce_proxy_rate": rate, "landing_views_missing": absent})


def low_ltv_to_cac(df: DataFrame, *, minimum: float = MIN_LTV_TO_CAC, registry: MetricRegistry = REGISTRY) -> DataFrame:
    """Rows whose lifetime value is below ``minimum`` times the acquisition cost."""
    ratio = registry.column(df, "ltv_to_cac")
    if ratio is None:
        return df.withColumn("ltv_to_cac", F.lit(None).cast("double")).filter(F.lit(False))
    return df.withColumn("ltv_to_cac", ratio).filter(F.col("ltv_to_cac") < minimum)


def below_break_even(df: DataFrame, *, break_even: float = BREAK_EVEN_ROAS, cohort: str = "cohort_id",
                     segment: str = "platform", **options) -> DataFrame:
    """Segments that earn revenue at a ROAS below break-even."""
    parts = totals(df, [cohort, segment], **options).select(cohort, segment, "spend", "conversion_value", "roas")
    return parts.filter((F.col("conversion_value") > 0) & (F.col("roas") < break_even))


def missing_kpis(df: DataFrame, goal: Column, *, registry: MetricRegistry = REGISTRY) -> Column:
    """Names of the row's goal KPIs that are null or lack their inputs."""
    kpis = goal_kpi_map(df, goal, keep_null=True, registry=registry)
    return F.map_keys(F.map_filter(kpis, lambda _, v: v.isNull()))


def missing_info(df: DataFrame, *, goal: str = "goal", cohort: str = "cohort_id",
                 registry: MetricRegistry = REGISTRY) -> DataFrame:
    """Per cohort and goal KPI: ``n_missing`` of ``n_rows`` and ``absent`` when no row has it."""
    # Counters in one aggregate; only its few rows, one per cohort and goal, are unpivoted.
    names = sorted({k for kpis in GOAL_KPIS.values() for k in kpis})
    known = df.groupBy(cohort, goal).agg(
        F.count("*").alias("_n"), *[F.count(goal_value(df, k, registry)).alias(f"_{k}") for k in names])
    wanted = F.array().cast("array<string>")
    for name, kpis in GOAL_KPIS.items():
        wanted = F.when(F.col(goal) == name, F.array(*[F.lit(k) for k in kpis])).otherwise(wanted)
    filled = F.create_map(*[c for k in names for c in (F.lit(k), F.col(f"_{k}"))])
    long = known.select(cohort, "_n", filled.alias("_filled"), F.explode(wanted).alias("kpi"))
    counted = long.groupBy(cohort, "kpi").agg(
        F.sum(F.col("_n") - F.element_at("_filled", F.col("kpi"))).alias("n_missing"), F.sum("_n").alias("n_rows"))
    return counted.filter(F.col("n_missing") > 0).withColumn("absent", F.col("n_missing") == F.col("n_rows"))


def payback_rank(df: DataFrame, *, cohort: str = "cohort_id", segment: str = "platform", **options) -> DataFrame:
    """Segments by acquisition payback period, the slowest first."""
    parts = totals(df, [cohort, segment], **options).select(cohort, segment, "cac_payback_period")
    slowest = W.partitionBy(cohort).orderBy(F.col("cac_payback_period").desc_nulls_last())
    return parts.withColumn("payback_rank", F.rank().over(slowest).cast("bigint"))
