"""Checked queries over ad tables: contract, cleaning, KPIs, cohorts, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from admeter.operators import clean as C, cohorts as H, kpis as K, summary as S
from admeter.schema import canonicalize, drop_null_columns, numeric_report, strip_headers

from .registry import div2, query, r2
from .views import ads_dirty, ads_events, ads_orders

MONEY = ("impressions", "clicks", "conversions", "spend")


def day(df: DataFrame) -> DataFrame:
    """Dates as text, so that both engines print them alike."""
    return df.withColumn("date", F.to_date("date").cast("string"))


# --- contract -------------------------------------------------------------------

@query("canonicalize", "ads_dirty", "SELECT * EXCLUDE (date), date FROM ads_dirty")
def canonicalize_q(spark, sf):
    return canonicalize(ads_dirty(spark, sf))


@query("numeric_validation_report", "ads_dirty", """
, bad AS (
  SELECT 'impressions' AS "column", impressions AS value, ordinal FROM ads_dirty WHERE impressions IS NOT NULL AND TRY_CAST(trim(impressions) AS DOUBLE) IS NULL
  UNION ALL SELECT 'spend', spend, ordinal FROM ads_dirty WHERE spend IS NOT NULL AND TRY_CAST(trim(spend) AS DOUBLE) IS NULL),
vals AS (SELECT "column", value, count(*) AS n, min(ordinal) AS f FROM bad GROUP BY 1, 2)
SELECT "column", CAST(sum(n) AS BIGINT) AS n_invalid, string_agg(value, '|' ORDER BY f) FILTER (WHERE rk <= 3) AS examples
FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY f) AS rk FROM vals) GROUP BY 1""")
def numeric_report_q(spark, sf):
    report = numeric_report(canonicalize(ads_dirty(spark, sf)), "ordinal")
    return report.withColumn("examples", F.array_join("examples", "|"))


@query("drop_null_columns", "ads_dirty", "SELECT * EXCLUDE (Empty) FROM ads_dirty")
def drop_null_q(spark, sf):
    return drop_null_columns(canonicalize(strip_headers(ads_dirty(spark, sf))))


# --- cleaning -------------------------------------------------------------------

def _typed(spark, sf):
    return C.enforce_types(canonicalize(ads_dirty(spark, sf)).drop("Empty"))


@query("enforce_types", "ads_dirty ads_typed",
       """SELECT t.* EXCLUDE (date, impressions, clicks, conversions, spend), CAST(t.date AS VARCHAR) AS date,
  TRY_CAST(trim(d.impressions) AS DOUBLE) AS impressions, TRY_CAST(trim(d.clicks) AS DOUBLE) AS clicks,
  TRY_CAST(trim(d.conversions) AS DOUBLE) AS conversions, TRY_CAST(trim(d.spend) AS DOUBLE) AS spend
FROM ads_typed t JOIN ads_dirty d ON t.ordinal = d.ordinal""")
def enforce_types_q(spark, sf):
    raw = canonicalize(ads_dirty(spark, sf)).drop("Empty")
    return day(C.enforce_types(raw, fill_missing_metrics_with_zero=False))


@query("zero_fill", "ads_dirty ads_typed", "SELECT * EXCLUDE (date), CAST(date AS VARCHAR) AS date FROM ads_typed")
def zero_fill_q(spark, sf):
    return day(_typed(spark, sf))


_LAST = """(SELECT * EXCLUDE (rk) FROM (
  SELECT *, row_number() OVER (PARTITION BY date, platform ORDER BY ordinal DESC) AS rk FROM ads_typed) WHERE rk = 1)"""


@query("dedup_keep_last", "ads_dirty ads_typed", f"SELECT * EXCLUDE (date), CAST(date AS VARCHAR) AS date FROM {_LAST}")
def dedup_q(spark, sf):
    return day(C.dedup_keep_last(_typed(spark, sf)))


@query("dedup_extra_keys", "ads_dirty ads_typed", """SELECT * EXCLUDE (date, rk), CAST(date AS VARCHAR) AS date FROM (
  SELECT *, row_number() OVER (PARTITION BY date, platform, campaign_type ORDER BY ordinal DESC) AS rk FROM ads_typed) WHERE rk = 1""")
def dedup_extra_q(spark, sf):
    return day(C.dedup_keep_last(_typed(spark, sf), extra_keys=("campaign_type",)))


@query("dedup_full_row", "ads_dirty ads_typed",
       """, twice AS (SELECT * FROM ads_typed UNION ALL SELECT * REPLACE (ordinal + 1000000000 AS ordinal) FROM ads_typed WHERE ordinal % 3 = 0)
SELECT * EXCLUDE (date, ordinal), CAST(date AS VARCHAR) AS date, max(ordinal) AS ordinal FROM twice GROUP BY ALL""")
def dedup_full_q(spark, sf):
    """Whole rows, of which a third stands twice."""
    typed = _typed(spark, sf)
    again = typed.filter("ordinal % 3 = 0").withColumn("ordinal", F.col("ordinal") + 1_000_000_000)
    return day(C.dedup_full_row(typed.unionByName(again)))


@query("clean_rows", "ads_dirty ads_typed", f"""SELECT platform, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(sum(impressions) AS DOUBLE) AS impressions, CAST(sum(clicks) AS DOUBLE) AS clicks FROM {_LAST} GROUP BY platform""")
def clean_q(spark, sf):
    cleaned = C.clean(canonicalize(ads_dirty(spark, sf)))
    return cleaned.groupBy("platform").agg(F.count("*").alias("n_rows"), F.sum("impressions").alias("impressions"),
                                           F.sum("clicks").alias("clicks"))


@query("row_limit", "ads_dirty ads_typed",
       f"SELECT * EXCLUDE (date), CAST(date AS VARCHAR) AS date FROM {_LAST} ORDER BY ordinal LIMIT 100")
def row_limit_q(spark, sf):
    return day(C.first_rows(C.dedup_keep_last(_typed(spark, sf)), 100))


# --- KPIs -----------------------------------------------------------------------

def _kpi_query(name, view, names, fn):
    keys = '"index", CAST(date AS VARCHAR) AS date, platform, campaign_type, ordinal'
    cpm = f"({div2('spend', 'impressions')} * 1000)"
    special = {"cpm": cpm, "bounce_proxy_rate": f"(1 - {div2('landing_page_views', 'clicks')})"}
    exprs = ", ".join(f"{special.get(k) or div2(*K.RATIOS[k])} AS {k}" for k in names)

    @query(name, view, f"SELECT {keys}, {exprs} FROM {view}")
    def run(spark, sf):
        out = K.compute_metrics(fn(spark, sf), names)
        return day(out).select("index", "date", "platform", "campaign_type", "ordinal", *names)


_kpi_query("kpi_core", "ads_orders", ("ctr", "cpc", "cvr", "cpa", "roas"), ads_orders)
_kpi_query("kpi_cost", "ads_orders", ("cpm", "aov", "cpa"), ads_orders)
_kpi_query("kpi_unit_economics", "ads_orders", ("mer", "ltv_to_cac", "cac_payback_period", "refund_rate"), ads_orders)
_kpi_query("kpi_traffic_quality", "ads_events",
           ("frequency", "bounce_proxy_rate", "session_quality_score"), ads_events)


@query("kpi_purchase_rate", "ads_events", f"""SELECT ordinal, {div2('conversions', 'landing_page_views')} * 100 AS purchase_conversion_rate,
  CAST(conversions AS BIGINT) AS purchases, conversion_value AS revenue FROM ads_events""")
def kpi_purchase_q(spark, sf):
    df = ads_events(spark, sf).withColumnRenamed("conversions", "purchases")
    return K.compute_metrics(df, ["purchase_conversion_rate", "revenue", "unknown_metric", "roas_of_nothing"]).select(
        "ordinal", "purchase_conversion_rate", "purchases", "revenue")


@query("kpi_exact_rounding", "ads_orders", f"SELECT ordinal, \"index\", platform, campaign_type, CAST(date AS VARCHAR) AS date, "
       f"{r2('spend/nullif(CAST(impressions AS DOUBLE),0)*1000')} AS cpm FROM ads_orders")
def kpi_exact_q(spark, sf):
    out = K.compute_metrics(ads_orders(spark, sf), ["cpm"], registry=K.MetricRegistry("exact"))
    return day(out).select("ordinal", "index", "platform", "campaign_type", "date", "cpm")


@query("user_metric", "ads_orders", f"""SELECT ordinal, "index", platform, campaign_type, CAST(date AS VARCHAR) AS date,
  {div2('conversion_value - spend', 'spend')} AS roi FROM ads_orders""")
def user_metric_q(spark, sf):
    registry = K.MetricRegistry()
    registry.register("roi", lambda df: F.rint((F.col("conversion_value") - F.col("spend"))
                                               / F.nullif(F.col("spend"), F.lit(0.0)) * 100.0) / 100.0)
    out = K.compute_metrics(ads_orders(spark, sf), ["roi"], registry=registry)
    return day(out).select("ordinal", "index", "platform", "campaign_type", "date", "roi")


def _goal_sql(prefix: str = "") -> str:
    """Goal KPIs of ads_events as (kpi, value) pairs per goal."""
    have = {"clicks": "clicks", "impressions": "impressions", "reach": "reach", "landing_page_views": "landing_page_views",
            "revenue": "conversion_value"}
    parts = []
    for goal, names in K.GOAL_KPIS.items():
        for k in names:
            if k in have:
                expr = have[k]
            elif k == "cpm":
                expr = f"{div2('spend', 'impressions')} * 1000"
            elif k == "bounce_proxy_rate":
                expr = f"1 - {div2('landing_page_views', 'clicks')}"
            elif k in ("mer", "ltv_to_cac", "cac_payback_period", "refund_rate", "purchases"):
                expr = "NULL"
            else:
                expr = div2(*K.RATIOS[k])
            parts.append(f"SELECT ordinal, '{k}' AS kpi, CAST({expr} AS DOUBLE) AS value, \"index\", primary_goal AS goal "
                         f"FROM ads_events WHERE primary_goal = '{goal}'")
    return " UNION ALL ".join(parts)


GOAL_SQL = _goal_sql()


@query("goal_kpis", "ads_events", f", g AS ({GOAL_SQL}) SELECT ordinal, kpi, value FROM g WHERE value IS NOT NULL")
def goal_kpis_q(spark, sf):
    df = ads_events(spark, sf)
    return K.with_goal_kpis(df, goal="primary_goal").select("ordinal", F.explode("goal_kpis").alias("kpi", "value"))


# --- cohorts ----------------------------------------------------------------------

@query("cohort_by_index", "ads_orders", """SELECT concat('campaign_', CAST("index" AS VARCHAR)) AS cohort_id,
  CAST(count(*) AS BIGINT) AS n_rows, min(ordinal) AS first_ordinal FROM ads_orders GROUP BY 1""")
def cohort_by_index_q(spark, sf):
    rows, _ = H.by_index(ads_orders(spark, sf))
    return H.cohort_order(rows)


@query("cohort_rejects", "ads_dirty ads_typed", """SELECT CAST(date AS VARCHAR) AS date, platform, ordinal FROM ads_typed
WHERE date IS NULL""")
def cohort_rejects_q(spark, sf):
    _, rejects = H.by_index(_typed(spark, sf).withColumn("index", F.to_date("date")))
    return day(rejects).select("date", "platform", "ordinal")


@query("cohort_batches", "ads_dirty ads_typed", """, placed AS (
  SELECT ordinal, row_number() OVER (ORDER BY ordinal) - 1 AS i, count(*) OVER () AS n FROM ads_typed)
SELECT ordinal, concat('batch_', CAST(i - i % 6 + 1 AS VARCHAR), '_', CAST(least(i - i % 6 + 6, n) AS VARCHAR)) AS cohort_id FROM placed""")
def cohort_batches_q(spark, sf):
    return H.by_batch(_typed(spark, sf), 6).select("ordinal", "cohort_id")


@query("cohort_context", "ads_events", """SELECT concat('campaign_', CAST("index" AS VARCHAR)) AS cohort_id,
  arg_min(primary_goal, ordinal) AS primary_goal, arg_min(industry, ordinal) AS industry, arg_min(offering, ordinal) AS offering,
  'Unknown' AS audience, 'Unknown' AS funnel_stage FROM ads_events GROUP BY 1""")
def cohort_context_q(spark, sf):
    rows, _ = H.by_index(ads_events(spark, sf))
    return H.first_row_context(rows).select("cohort_id", "campaign_target.*", "business_domain.*")


@query("cohort_row_position", "ads_events", """SELECT ordinal, concat('campaign_', CAST("index" AS VARCHAR)) AS cohort_id,
  row_number() OVER (PARTITION BY "index" ORDER BY ordinal) - 1 AS position FROM ads_events""")
def cohort_position_q(spark, sf):
    rows, _ = H.by_index(ads_events(spark, sf))
    return H.row_positions(rows.select("cohort_id", "ordinal")).select("ordinal", "cohort_id", "position")


# --- summaries ---------------------------------------------------------------------

def _summaries(spark, sf):
    rows, _ = H.by_index(ads_events(spark, sf))
    return S.row_summaries(rows.withColumn("goal", F.col("primary_goal")))


_BASE = f"""
  SELECT ordinal, unnest(['spend','revenue','impressions','clicks','conversions','roas','cpa','cvr','ctr']) AS metric,
    unnest([{r2('spend')}, {r2('conversion_value')}, CAST(impressions AS DOUBLE), CAST(clicks AS DOUBLE), CAST(conversions AS DOUBLE),
      {div2('conversion_value', 'spend')}, {div2('spend', 'conversions')}, {div2('conversions', 'clicks')}, {div2('clicks', 'impressions')}]) AS value
  FROM ads_events"""
_METRICS = f""", base AS ({_BASE}), goal AS (SELECT ordinal, kpi AS metric, value FROM ({GOAL_SQL}) WHERE value IS NOT NULL),
summary AS (SELECT * FROM goal UNION ALL SELECT b.* FROM base b LEFT JOIN goal g ON b.ordinal = g.ordinal AND b.metric = g.metric WHERE g.metric IS NULL)
"""


@query("row_summary_metrics", "ads_events", f"{_METRICS} SELECT ordinal, metric, value FROM summary")
def row_summary_q(spark, sf):
    return _summaries(spark, sf).select("ordinal", F.explode("summary.performance_metrics").alias("metric", "value"))


@query("row_summary_identity", "ads_events", """SELECT ordinal, platform, campaign_name, CAST(date AS VARCHAR) AS date, industry, offering,
  'Unknown' AS audience, 'Unknown' AS funnel_stage, primary_goal FROM ads_events""")
def row_identity_q(spark, sf):
    return _summaries(spark, sf).select("ordinal", "summary.campaign_identity.*")


@query("cohort_payload", "ads_events", f"""{_METRICS}, placed AS (
  SELECT ordinal, concat('campaign_', CAST("index" AS VARCHAR)) AS cohort_id, count(*) OVER (PARTITION BY "index") AS n_rows,
    row_number() OVER (PARTITION BY "index" ORDER BY ordinal) - 1 AS i, campaign_name, platform, industry FROM ads_events)
SELECT cohort_id, i // 100 AS part, CAST(ceil(n_rows / CAST(100 AS DOUBLE)) AS BIGINT) AS n_parts, n_rows, i % 100 AS place, campaign_name, platform, industry,
  metric, value FROM placed JOIN summary ON placed.ordinal = summary.ordinal""")
def cohort_payload_q(spark, sf):
    rows, _ = H.by_index(ads_events(spark, sf))
    parts = S.cohort_payloads(rows, goal="primary_goal", rows_per_part=100)
    return parts.select("cohort_id", "part", "n_parts", "n_rows", F.posexplode("payload").alias("p", "s")).select(
        "cohort_id", "part", "n_parts", "n_rows", F.col("p").cast("bigint").alias("place"),
        *[F.col(f"s.campaign_identity.{c}").alias(c) for c in ("campaign_name", "platform", "industry")],
        F.explode("s.performance_metrics").alias("metric", "value"))
