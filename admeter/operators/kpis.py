"""Marketing KPIs: a registry of column builders, and the KPIs of each goal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import half_even, number, only_if, safe_ratio

# --- fixed values: KPI definitions ---------------------------------------------
# name: (numerator, denominator)
RATIOS = {
    "ctr": ("clicks", "impressions"),
    "cpc": ("spend", "clicks"),
    "cpm": ("spend", "impressions"),
    "cvr": ("conversions", "clicks"),
    "cpa": ("spend", "conversions"),
    "roas": ("conversion_value", "spend"),
    "aov": ("conversion_value", "conversions"),
    "frequency": ("impressions", "reach"),
    "mer": ("total_revenue", "total_marketing_spend"),
    "ltv_to_cac": ("lifetime_value", "cac"),
    "cac_payback_period": ("cac", "monthly_gross_profit_per_customer"),
    "refund_rate": ("refunds", "orders"),
    "purchase_conversion_rate": ("purchases", "landing_page_views"),
    "bounce_proxy_rate": ("landing_page_views", "clicks"),
    "session_quality_score": ("landing_page_views", "sessions"),
}
# What is done to a ratio after it was rounded to two places.
SCALED = {"cpm": 1000.0, "purchase_conversion_rate": 100.0}
COMPLEMENTED = ("bounce_proxy_rate",)
# name: columns to take the value from, the first that exists
RAW_COLUMNS = {
    "spend": ("spend",),
    "revenue": ("revenue", "conversion_value"),
    "conversion_value": ("conversion_value",),
    "impressions": ("impressions",),
    "clicks": ("clicks",),
    "conversions": ("conversions",),
    "purchases": ("purchases",),
    "reach": ("reach",),
    "frequency_raw": ("frequency",),
    "landing_page_views": ("landing_page_views",),
    "sessions": ("sessions",),
}
GOAL_KPIS = {
    "Increase Sales": ("roas", "cpa", "cvr", "ctr", "cpc", "aov", "revenue", "purchases"),
    "Brand Awareness": ("cpm", "reach", "impressions", "frequency"),
    "Revenue Efficiency": ("mer", "ltv_to_cac", "cac_payback_period", "roas", "aov", "refund_rate"),
    "Traffic": ("clicks", "ctr", "cpc", "landing_page_views", "cpm", "bounce_proxy_rate", "session_quality_score"),
}
CORE_KPIS = ("roas", "cpa", "cvr", "ctr", "cpc")
# -------------------------------------------------------------------------------

Builder = Callable[[DataFrame], "Column | None"]


def _after_ratio(name: str, ratio: Column) -> Column:
    if name in SCALED:
        return ratio * SCALED[name]
    return 1.0 - ratio if name in COMPLEMENTED else ratio


def ratio_of(name: str, numerator: Column, denominator: Column, rounding: str = "stepwise") -> Column:
    """KPI ``name`` from its two inputs.

    ``rounding="stepwise"`` rounds the bare ratio, then scales it: a CPM of
    44.46 comes out as 40.0.  ``rounding="exact"`` scales first.
    """
    if rounding == "stepwise":
        return _after_ratio(name, safe_ratio(numerator, denominator))
    if rounding == "exact":
        return half_even(_after_ratio(name, safe_ratio(numerator, denominator, digits=None)))
    raise ValueError(f"rounding must be 'stepwise' or 'exact', got: {rounding}")


def _ratio_builder(name: str, rounding: str) -> Builder:
    numerator, denominator = RATIOS[name]

    def build(df: DataFrame) -> Column | None:
        if numerator not in df.columns or denominator not in df.columns:
            return None
        return ratio_of(name, number(df, numerator), number(df, denominator), rounding)

    return build


def _raw_builder(name: str) -> Builder:
    def build(df: DataFrame) -> Column | None:
        present = [c for c in RAW_COLUMNS[name] if c in df.columns]
        return F.col(present[0]) if present else None

    return build


class MetricRegistry:
    """Named metrics.  A metric is a function from a DataFrame to a Column, or to
    None when the DataFrame lacks its inputs."""

    def __init__(self, rounding: str = "stepwise"):
        self._builders: dict[str, Builder] = {}
        for name in RATIOS:
            self._builders[name] = _ratio_builder(name, rounding)
        for name in RAW_COLUMNS:
            self._builders[name] = _raw_builder(name)

    def register(self, name: str, builder: Builder) -> None:
        """Add or replace a metric; its Column may come from a ``pandas_udf``."""
        self._builders[name] = builder

    @property
    def names(self) -> list[str]:
        return list(self._builders)

    def column(self, df: DataFrame, name: str) -> Column | None:
        builder = self._builders.get(name)
        return builder(df) if builder else None


METRICS = MetricRegistry()


def compute_metrics(df: DataFrame, names=None, *, overwrite: bool = False,
                    registry: MetricRegistry = METRICS) -> DataFrame:
    """Add metrics as columns.

    Unknown names and metrics without their inputs are skipped; an existing
    column stays unless ``overwrite``.  Metrics are added in order, and a later
    one may use an earlier one; runs of independent metrics become one
    projection.
    """
    wanted = list(names) if names is not None else registry.names
    pending: dict[str, Column] = {}

    def flushed() -> DataFrame:
        return df.withColumns(pending) if pending else df

    for name in wanted:
        feeds_on = {c for c in RATIOS.get(name, RAW_COLUMNS.get(name, ()))}
        built_in = name in RATIOS or name in RAW_COLUMNS
        if pending and (not built_in or feeds_on & set(pending)):
            df, pending = flushed(), {}
        if not overwrite and (name in df.columns or name in pending):
            continue
        column = registry.column(df, name)
        if column is not None:
            pending[name] = column
    return flushed()


def goal_kpi_names(goal: str) -> tuple[str, ...]:
    """KPIs of a goal; empty for a goal that is not one of the four."""
    return GOAL_KPIS.get(goal, ())


def goal_kpi_table(spark) -> DataFrame:
    """The goals as a small table: ``goal, kpis ARRAY<STRING>``."""
    rows = [F.struct(F.lit(goal).alias("goal"), F.array(*[F.lit(k) for k in kpis]).alias("kpis"))
            for goal, kpis in GOAL_KPIS.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def goal_value(df: DataFrame, kpi: str, registry: MetricRegistry = METRICS) -> Column:
    """A KPI as DOUBLE; null when it is NaN or its inputs are absent."""
    column = registry.column(df, kpi)
    if column is None:
        return F.lit(None).cast("double")
    value = column.try_cast("double")
    return F.when(~F.isnan(value), value)


def goals_with(kpi: str) -> list[str]:
    return [goal for goal, kpis in GOAL_KPIS.items() if kpi in kpis]


def as_map(df: DataFrame, values: dict[str, Column], output: str, *, always=()) -> DataFrame:
    """Add ``output MAP<STRING,DOUBLE>`` of the values that are not null, and of those named in ``always``.

    The values are laid out as plain columns first.  Built from expressions in
    one go, the map becomes a generated method too large for the JVM to compile.
    """
    flat = df.withColumns({f"_v_{name}": value for name, value in values.items()})

    def entry(name: str) -> Column:
        return F.struct(F.lit(name).alias("key"), F.col(f"_v_{name}").alias("value"))

    fixed = [F.array(*[entry(n) for n in values if n in always])] if always else []
    optional = [only_if(F.col(f"_v_{n}").isNotNull(), entry(n)) for n in values if n not in always]
    return flat.withColumn(output, F.map_from_entries(F.concat(*fixed, *optional))).drop(*[f"_v_{n}" for n in values])


def with_goal_kpis(df: DataFrame, *, goal: str = "goal", output: str = "goal_kpis",
                   registry: MetricRegistry = METRICS) -> DataFrame:
    """Add the row's non-null goal KPIs as a map; the way to do it for many rows."""
    names = sorted({k for kpis in GOAL_KPIS.values() for k in kpis})
    return as_map(df, {k: F.when(F.col(goal).isin(goals_with(k)), goal_value(df, k, registry)) for k in names}, output)


def goal_kpi_map(df: DataFrame, goal: Column, *, keep_null: bool = False,
                 registry: MetricRegistry = METRICS) -> Column:
    """The row's goal KPIs as ``MAP<STRING,DOUBLE>``, always computed anew.

    Null KPIs are left out unless ``keep_null``.  A row evaluates the KPIs of its
    goal only.  For large tables ``with_goal_kpis`` is faster.
    """
    chosen = F.create_map().cast("map<string,double>")
    for name, kpis in GOAL_KPIS.items():
        pairs = [c for kpi in kpis for c in (F.lit(kpi), goal_value(df, kpi, registry))]
        chosen = F.when(goal == name, F.create_map(*pairs)).otherwise(chosen)
    return chosen if keep_null else F.map_filter(chosen, lambda _, v: v.isNotNull())
