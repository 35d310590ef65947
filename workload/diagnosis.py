"""Checked queries for cohort diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from admeter.operators import cohorts as H, diagnostics as D, kpis as K, quality as Q
from admeter.schema import canonicalize
from admeter.operators.clean import enforce_types

from .ads import GOAL_SQL, day
from .registry import div2, query, r2, total
from .views import ads_dirty, ads_events, ads_orders


def _events(spark, sf):
    rows, _ = H.by_index(ads_events(spark, sf))
    return rows.withColumn("goal", F.col("primary_goal"))


def _orders(spark, sf):
    return H.by_index(ads_orders(spark, sf))[0]


_EV = ("impressions", "clicks", "spend", "conversions", "conversion_value", "reach", "landing_page_views", "sessions")
_OR = ("impressions", "clicks", "spend", "conversions", "conversion_value", "total_revenue", "total_marketing_spend",
       "refunds", "orders", "cac", "lifetime_value", "monthly_gross_profit_per_customer")


def totals_sql(view: str, keys: str, measures) -> str:
    sums = ", ".join(f"{total(m)} AS {m}" for m in measures)
    exprs = []
    for k, (n, d) in K.RATIOS.items():
        if n in measures and d in measures:
            e = div2(n, d)
            e = f"({e} * 1000)" if k == "cpm" else f"(1 - {e})" if k == "bounce_proxy_rate" else e
            exprs.append(f"{e} AS {k}")
    return (f"SELECT *, {', '.join(exprs)} FROM (SELECT concat('campaign_', CAST(\"index\" AS VARCHAR)) AS cohort_id, "
            f"{keys}, {sums} FROM {view} GROUP BY ALL)")


DAILY_EV = totals_sql("ads_events", "platform, CAST(date AS VARCHAR) AS date", _EV)
DAILY_OR = totals_sql("ads_orders", "platform, CAST(date AS VARCHAR) AS date", _OR)


def _trend_sql(daily: str, kpis) -> str:
    changes = ", ".join(
        f"{r2(f'{k} - lag({k}) OVER (PARTITION BY cohort_id, platform ORDER BY date)')} AS {k}_change" for k in kpis)
    return f"SELECT cohort_id, platform, date, {', '.join(kpis)}, {changes} FROM ({daily})"


# The flagship: platforms of each cohort by the KPI of its goal.
@query("platform_comparison", "ads_events", f""", t AS ({totals_sql('ads_events', 'primary_goal AS goal, platform', _EV)})
SELECT *, rank() OVER (PARTITION BY cohort_id ORDER BY CASE goal WHEN 'Brand Awareness' THEN -cpm WHEN 'Revenue Efficiency' THEN NULL
  WHEN 'Traffic' THEN ctr ELSE roas END DESC NULLS LAST) AS platform_rank FROM t""")
def platform_comparison_q(spark, sf):
    return D.platform_comparison(_events(spark, sf))


@query("platform_comparison_orders", "ads_orders", f""", t AS ({totals_sql('ads_orders', 'platform', _OR)})
SELECT *, rank() OVER (PARTITION BY cohort_id ORDER BY roas DESC NULLS LAST) AS platform_rank FROM t""")
def platform_orders_q(spark, sf):
    return D.platform_comparison(_orders(spark, sf))


@query("kpi_trend", "ads_orders", _trend_sql(DAILY_OR, ("ctr", "cpc", "cpa", "roas")))
def kpi_trend_q(spark, sf):
    return day(D.kpi_trend(_orders(spark, sf), ["ctr", "cpc", "cpa", "roas"]))


@query("rising_cpc", "ads_events",
       f"SELECT * FROM ({_trend_sql(DAILY_EV, ('cpc', 'ctr', 'clicks'))}) WHERE cpc_change > 0 AND ctr_change <= 0 AND clicks_change <= 0")
def rising_cpc_q(spark, sf):
    return day(D.rising_cpc(_events(spark, sf)))


@query("weak_traffic", "ads_events", f""", d AS ({DAILY_EV}), q AS (
  SELECT cohort_id, quantile_disc(cpc, 0.25) AS cpc_low, quantile_disc(ctr, 0.25) AS ctr_low FROM d GROUP BY 1)
SELECT cohort_id, platform, date, cpc, ctr, cpc_low, ctr_low FROM d JOIN q USING (cohort_id) WHERE cpc <= cpc_low AND ctr <= ctr_low""")
def weak_traffic_q(spark, sf):
    return day(D.weak_traffic(_events(spark, sf)))


@query("landing_page_gap", "ads_events", f"""SELECT ordinal, 1 - {div2('landing_page_views', 'clicks')} AS bounce_proxy_rate,
  landing_page_views IS NULL AS landing_views_missing FROM ads_events""")
def landing_page_gap_q(spark, sf):
    return D.landing_page_gap(_events(spark, sf)).select("ordinal", "bounce_proxy_rate", "landing_views_missing")


@query("saturation", "ads_events", f""", t AS ({_trend_sql(DAILY_EV, ('frequency', 'ctr'))})
SELECT *, coalesce(frequency >= 4, false) AS saturated, coalesce(frequency >= 4, false) AND coalesce(ctr_change < 0, false) AS fatigued FROM t""")
def saturation_q(spark, sf):
    return day(D.saturation(_events(spark, sf)))


@query("cpm_drift", "ads_events", f"""SELECT *, CASE WHEN cpm_change > 1 THEN 'up' WHEN cpm_change < -1 THEN 'down'
  WHEN cpm_change IS NOT NULL THEN 'flat' ELSE 'unknown' END AS direction FROM ({_trend_sql(DAILY_EV, ('cpm',))})""")
def cpm_drift_q(spark, sf):
    return day(D.cpm_drift(_events(spark, sf), tolerance=1.0))


@query("mer_decline", "ads_orders", f"SELECT * FROM ({_trend_sql(DAILY_OR, ('mer',))}) WHERE mer_change < 0")
def mer_decline_q(spark, sf):
    return day(D.mer_decline(_orders(spark, sf)))


@query("ltv_cac_flag", "ads_orders", f"""SELECT * FROM (SELECT ordinal, {div2('lifetime_value', 'cac')} AS ltv_to_cac FROM ads_orders)
WHERE ltv_to_cac < 15""")
def ltv_cac_q(spark, sf):
    return D.low_ltv_to_cac(_orders(spark, sf), minimum=15.0).select("ordinal", "ltv_to_cac")


_SEGMENT = totals_sql("ads_orders", "campaign_type", _OR)
_PLATFORM = totals_sql("ads_orders", "platform", _OR)


@query("value_leakage", "ads_orders", f""", t AS ({_SEGMENT}), q AS (
  SELECT cohort_id, quantile_disc(refund_rate, 0.75) AS refund_high, quantile_disc(aov, 0.25) AS aov_low FROM t GROUP BY 1),
f AS (SELECT cohort_id, campaign_type, refund_rate, aov, refund_high, aov_low, coalesce(refund_rate >= refund_high, false) AS high_refunds,
  coalesce(aov <= aov_low, false) AS low_order_value FROM t JOIN q USING (cohort_id))
SELECT * FROM f WHERE high_refunds OR low_order_value""")
def value_leakage_q(spark, sf):
    return D.value_leakage(_orders(spark, sf))


@query("scale_opportunity", "ads_orders", f""", t AS ({_PLATFORM}), q AS (SELECT cohort_id, quantile_disc(cpa, 0.25) AS cpa_low FROM t GROUP BY 1)
SELECT cohort_id, platform, spend, conversions, cpa, cpa_low FROM t JOIN q USING (cohort_id) WHERE cpa <= cpa_low""")
def scale_opportunity_q(spark, sf):
    return D.scale_opportunities(_orders(spark, sf))


@query("scale_opportunity_target", "ads_events",
       f"SELECT cohort_id, platform, spend, conversions, cpa FROM ({totals_sql('ads_events', 'platform', _EV)}) WHERE cpa <= 40")
def scale_target_q(spark, sf):
    return D.scale_opportunities(_events(spark, sf), target_cpa=40.0)


@query("below_breakeven", "ads_events", f"""SELECT cohort_id, campaign_name, spend, conversion_value, roas
FROM ({totals_sql('ads_events', 'campaign_name', _EV)}) WHERE conversion_value > 0 AND roas < 1""")
def below_breakeven_q(spark, sf):
    return D.below_break_even(_events(spark, sf), segment="campaign_name")


@query("click_no_convert", "ads_events", f""", d AS ({DAILY_EV}), q AS (
  SELECT cohort_id, quantile_disc(clicks, 0.75) AS clicks_high, quantile_disc(cvr, 0.25) AS cvr_low FROM d GROUP BY 1)
SELECT cohort_id, platform, date, clicks, cvr, spend, clicks_high, cvr_low FROM d JOIN q USING (cohort_id)
WHERE clicks >= clicks_high AND cvr <= cvr_low""")
def click_no_convert_q(spark, sf):
    return day(D.clicks_without_conversions(_events(spark, sf)))


@query("missing_info", "ads_events", f""", g AS ({GOAL_SQL}), c AS (
  SELECT concat('campaign_', CAST("index" AS VARCHAR)) AS cohort_id, kpi, count(*) - count(value) AS n_missing, count(*) AS n_rows FROM g GROUP BY 1, 2)
SELECT *, n_missing = n_rows AS absent FROM c WHERE n_missing > 0""")
def missing_info_q(spark, sf):
    return D.missing_info(_events(spark, sf))


@query("missing_kpis_per_row", "ads_events", f""", g AS ({GOAL_SQL})
SELECT ordinal, string_agg(kpi, ',' ORDER BY kpi) AS missing FROM g WHERE value IS NULL GROUP BY 1""")
def missing_kpis_q(spark, sf):
    df = _events(spark, sf)
    names = F.array_sort(D.missing_kpis(df, F.col("goal")))
    return df.select("ordinal", F.array_join(names, ",").alias("missing")).filter("missing <> ''")


@query("payback_rank", "ads_orders", f"""SELECT cohort_id, platform, cac_payback_period,
  rank() OVER (PARTITION BY cohort_id ORDER BY cac_payback_period DESC NULLS LAST) AS payback_rank FROM ({_PLATFORM})""")
def payback_rank_q(spark, sf):
    return D.payback_rank(_orders(spark, sf))


@query("reported_vs_derived", "ads_dirty ads_typed", f"""SELECT * FROM (SELECT ordinal, 'ctr' AS kpi, reported_ctr AS reported,
  {div2('clicks', 'impressions')} AS derived FROM ads_typed) WHERE reported IS NOT NULL AND (derived IS NULL OR abs(reported - derived) > 0.005)""")
def reported_vs_derived_q(spark, sf):
    df = enforce_types(canonicalize(ads_dirty(spark, sf)).drop("Empty"))
    return Q.reported_vs_derived(df.select("ordinal", "clicks", "impressions", "reported_ctr")).select(
        "ordinal", "kpi", "reported", "derived")
