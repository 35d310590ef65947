"""Checked queries for input contracts, requests, evaluation prompts and the types inside replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from admeter.operators import compare as V, kpis as K, prompts as P, quality as Q, responses as R
from admeter.plans import requests as O
from admeter.schema import REPORTED_KPIS, canonicalize, is_empty, missing_columns, validate_required

from .ads import _METRICS
from .registry import div2, query, r2
from .replies import _AVG, _FLAT, _GOAL_OF, _INSTRUCTION, _quoted, version_summary_q
from .views import ads_dirty, ads_events, ads_orders, table


# --- contracts of the ad table and of score tables ----------------------------------

@query("contract_columns", "", """SELECT event_id AS ordinal, 'date,platform,campaign_type,impressions,clicks' AS missing_as_given,
  '' AS missing_after FROM events""")
def contract_columns_q(spark, sf):
    given = ads_dirty(spark, sf)
    named = validate_required(canonicalize(given), strict=False)
    return named.select("ordinal", F.lit(",".join(missing_columns(given))).alias("missing_as_given"),
                        F.lit(",".join(missing_columns(named))).alias("missing_after"))


_WANTED = ("o_orderkey", "o_custkey", "event_id", "user_id", "l_orderkey", "l_quantity", "doc_id", "lang", "ts")


@query("contract_violations", "", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, w AS missing, (SELECT count(*) FROM {t}) AS n_rows FROM (SELECT unnest([{', '.join(f"'{w}'" for w in _WANTED)}]) AS w)
  WHERE w NOT IN (SELECT column_name FROM (DESCRIBE SELECT * FROM {t}))""" for t in ("orders", "events", "lineitem", "documents")) + ")")
def contract_violations_q(spark, sf):
    """Four tables held against one contract: the columns that each lacks, beside its rows."""
    def lacking(name: str):
        df = table(spark, sf, name)
        missing = F.array(*[F.lit(c) for c in missing_columns(df, _WANTED)])
        return df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), F.explode(missing).alias("missing"), "n_rows")

    return reduce(lambda a, b: a.unionByName(b), [lacking(t) for t in ("orders", "events", "lineitem", "documents")])


_PARTS = {"all": "true", "bought": "conversions > 0", "clicked without impressions": "clicks > 0 AND impressions <= 0"}


@query("empty_parts", "ads_events", " UNION ALL ".join(
    f"SELECT '{name}' AS part, count(*) = 0 AS is_empty FROM ads_events WHERE {rule}" for name, rule in _PARTS.items()))
def empty_parts_q(spark, sf):
    ads = ads_events(spark, sf)
    rows = [F.struct(F.lit(name).alias("part"), F.lit(is_empty(ads.filter(rule))).alias("is_empty")) for name, rule in _PARTS.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


@query("sorted_versions", "eval_scores", f"""{_FLAT}, s AS (SELECT cohort_id, version, {_AVG}, {r2('avg(overall)')} AS overall FROM flat GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY cohort_id, version) AS place FROM s""")
def sorted_versions_q(spark, sf):
    """The summary in its order; ids grow along sorted rows, so their rank is the place.  One row per cohort and version."""
    checked = V.check_score_columns(version_summary_q(spark, sf), "analysis")
    placed = V.sort_versions(checked).withColumn("_id", F.monotonically_increasing_id())
    return placed.selectExpr("* EXCEPT (_id)", "CAST(row_number() OVER (ORDER BY _id) AS BIGINT) AS place")


_REPORTED = "CASE WHEN ordinal % 5 <> 0 THEN (ordinal % 9) / CAST(100 AS DOUBLE) END"
_DERIVED = {k: f"({div2('spend', 'impressions')} * 1000)" if k == "cpm" else div2(*K.RATIOS[k]) for k in REPORTED_KPIS}


@query("reported_vs_derived_all", "ads_orders", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT ordinal, \"index\", platform, campaign_type, CAST(date AS VARCHAR) AS date, '{k}' AS kpi, {_REPORTED} AS reported, {expr} AS derived FROM ads_orders"
    for k, expr in _DERIVED.items()) + ") WHERE reported IS NOT NULL AND (derived IS NULL OR abs(reported - derived) > 0.005)")
def reported_vs_derived_all_q(spark, sf):
    reported = {f"reported_{k}": F.expr(_REPORTED) for k in REPORTED_KPIS}
    out = Q.reported_vs_derived(ads_orders(spark, sf).withColumns(reported))
    return out.select("ordinal", "index", "platform", "campaign_type", F.col("date").cast("string").alias("date"), "kpi", "reported", "derived")


# --- requests -----------------------------------------------------------------------------

def _requests(spark, sf):
    """Each ad row as a request; every third brings its analysis."""
    ads = ads_events(spark, sf)
    data = F.to_json(F.struct("platform", "campaign_name", "impressions", "clicks", "conversions", "spend", "conversion_value", "reach",
                              "landing_page_views", "sessions"))
    given = F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit('{"given":'), F.col("ordinal").cast("string"), F.lit("}")))
    return ads.select(F.col("ordinal").alias("request_id"), data.alias("campaign_data"),
                      F.to_json(F.struct("industry", "offering")).alias("business_domain"),
                      F.to_json(F.struct("primary_goal")).alias("campaign_target"), given.alias("analysis_results"))


def _system(stage: str) -> str:
    return f"replace({_quoted(P.DEFAULT_TEMPLATES[f'{stage}/system'])}, '{{{{GOAL_INSTRUCTIONS}}}}', {_INSTRUCTION})"


@query("request_metrics", "ads_events", f"{_METRICS} SELECT ordinal AS request_id, metric, value FROM summary")
def request_metrics_q(spark, sf):
    metrics = F.explode(F.get("payload", F.lit(0))["performance_metrics"]).alias("metric", "value")
    return O.request_payloads(_requests(spark, sf)).select(F.col("cohort_id").cast("bigint").alias("request_id"), metrics)


@query("request_analysis_prompts", "ads_events", f"""SELECT ordinal AS request_id, '' AS unresolved, md5({_system('analysis')}) AS system_md5
FROM (SELECT *, primary_goal AS goal FROM ads_events) WHERE ordinal % 3 <> 0""")
def request_analysis_q(spark, sf):
    out = O.analysis_requests(_requests(spark, sf), P.default_templates(spark))
    return out.select(F.col("cohort_id").cast("bigint").alias("request_id"), F.array_join("unresolved", ",").alias("unresolved"),
                      F.md5(F.get("messages", F.lit(0))["content"]).alias("system_md5"))


@query("request_recommendation_prompts", "ads_events", f"""SELECT ordinal AS request_id,
  concat(CASE WHEN ordinal % 3 = 0 THEN '{{"given":' ELSE '{{"made":' END, CAST(ordinal AS VARCHAR), '}}') AS analysis, md5({_system('recommendation')}) AS system_md5
FROM (SELECT *, primary_goal AS goal FROM ads_events) WHERE ordinal % 3 <> 2""")
def request_recommendation_q(spark, sf):
    requests = _requests(spark, sf)
    made = requests.filter("request_id % 3 = 1").select(
        F.col("request_id").cast("string").alias("cohort_id"),
        F.concat(F.lit('{"made":'), F.col("request_id").cast("string"), F.lit("}")).alias("generated_analysis"))
    out = O.recommendation_requests(requests, made, P.default_templates(spark))
    return out.select(F.col("cohort_id").cast("bigint").alias("request_id"), "analysis",
                      F.md5(F.get("messages", F.lit(0))["content"]).alias("system_md5"))


# --- evaluation prompts --------------------------------------------------------------------

# The same text serves both engines.
_EVALUATED = f"""
SELECT doc_id AS cohort_id,
  CASE WHEN doc_id % 13 <> 0 THEN '{{"primary_goal":"' || CASE WHEN doc_id % 17 = 0 THEN '' ELSE {_GOAL_OF} END || '"}}' END AS campaign_target,
  '{{"industry":"' || lang || '"}}' AS business_domain,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '{{"platform":"x"}}'
    ELSE '[{{"performance_metrics":{{"cpc":1.5,"clicks":2}}}},{{"performance_metrics":{{"aov":' || n_chars || '}}}}]' END AS campaign_data,
  CASE WHEN doc_id % 9 = 0 THEN text || ' {{{{RAW_DATA}}}}' ELSE text END AS report,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN '' ELSE {_GOAL_OF} END AS goal,
  CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN '' ELSE 'aov, clicks, cpc' END AS kpis,
  CASE WHEN doc_id % 9 = 0 AND text IS NOT NULL THEN '{{{{RAW_DATA}}}}' ELSE '' END AS unresolved
FROM documents"""


def _evaluated(spark, sf):
    table(spark, sf, "documents").createOrReplaceTempView("documents")
    return spark.sql(_EVALUATED).drop("goal", "kpis", "unresolved")


def _filled(template: str, values: dict[str, str]) -> str:
    out = _quoted(P.DEFAULT_TEMPLATES[template])
    for name, value in values.items():
        out = f"replace({out}, '{{{{{name}}}}}', coalesce({value}, 'null'))"
    return out


_CONTEXT = "'{{\"{0}\":' || coalesce({1}, 'null') || ',\"{2}\":' || coalesce({3}, 'null') || '}}'"
_ASKED_ANALYSIS = _filled("analysis_evaluation/user", {
    "PRIMARY_GOAL": "goal", "KPIS": "kpis",
    "CAMPAIGN_CONTEXT": _CONTEXT.format("target", "campaign_target", "business_domain", "business_domain"),
    "RAW_DATA": "campaign_data", "ANALYSIS_REPORT": "report"})
_ASKED_CARDS = _filled("recommendation_evaluation/user", {
    "BUSINESS_CONTEXT": _CONTEXT.format("business_domain", "business_domain", "campaign_target", "campaign_target"),
    "RAW_DATA": "campaign_data", "ANALYSIS_CONTEXT": "campaign_target", "RECOMMENDATION": "report"})


@query("analysis_evaluation_prompts", "", f"""WITH e AS ({_EVALUATED}), v AS (SELECT *, concat_ws('; ',
    CASE WHEN campaign_target IS NULL THEN 'no campaign_target' END, CASE WHEN campaign_data IS NULL THEN 'no campaign_data' END,
    CASE WHEN coalesce(goal, '') = '' THEN 'no primary_goal' END, CASE WHEN kpis = '' THEN 'no KPI names' END) AS violations FROM e)
SELECT cohort_id, unresolved, violations, CASE WHEN unresolved = '' AND violations = '' THEN md5({_ASKED_ANALYSIS}) ELSE '-' END AS user_md5 FROM v""")
def analysis_evaluation_prompts_q(spark, sf):
    inputs = _evaluated(spark, sf).withColumnRenamed("report", "analysis_report")
    out = P.analysis_evaluation_prompts(inputs, P.default_templates(spark))
    return out.select("cohort_id", F.array_join("unresolved", ",").alias("unresolved"), F.array_join("violations", "; ").alias("violations"),
                      F.coalesce(F.md5(F.get("messages", F.lit(1))["content"]), F.lit("-")).alias("user_md5"))


@query("recommendation_evaluation_prompts", "", f"""WITH e AS ({_EVALUATED})
SELECT cohort_id, unresolved, CASE WHEN unresolved = '' THEN md5({_ASKED_CARDS}) ELSE '-' END AS user_md5 FROM e""")
def recommendation_evaluation_prompts_q(spark, sf):
    inputs = _evaluated(spark, sf).withColumnRenamed("report", "recommendations").withColumn("analysis_context", F.col("campaign_target"))
    out = P.recommendation_evaluation_prompts(inputs, P.default_templates(spark))
    return out.select("cohort_id", F.array_join("unresolved", ",").alias("unresolved"),
                      F.coalesce(F.md5(F.get("messages", F.lit(1))["content"]), F.lit("-")).alias("user_md5"))


# --- types inside replies ---------------------------------------------------------------------

def _with(docs, template: str, parts: dict[str, dict[int, str]], good: dict[str, str], modes: int):
    """Replies from a template: ``doc_id`` modulo ``modes`` picks the part that differs; TEXT is the whole text as JSON."""
    whole = F.to_json(F.array(F.concat(F.lit("Mixed results. "), F.coalesce("text", F.lit("")))))
    raw = F.lit(template)
    for name, value in good.items():
        part = F.lit(value)
        for mode, other in parts.get(name, {}).items():
            part = F.when(F.col("doc_id") % modes == mode, other).otherwise(part)
        raw = F.replace(raw, F.lit(f"<{name}>"), part)
    raw = F.replace(raw, F.lit("<TEXT>"), F.substring(whole, F.lit(2), F.length(whole) - 2))
    return docs.select("doc_id", F.col("source").alias("cohort_id"), F.concat(F.lit("run_"), "lang").alias("run_id"), raw.alias("raw"))


_INSIGHT = '[{"insight":"held","evidence":"CPC 1.2","business_impact":"sales"}]'
_ANALYSIS = ('{"analysis":{"executive_summary":<SUMMARY>,"budget_and_efficiency":' + _INSIGHT + ',"results_and_value":' + _INSIGHT
             + ',"cross_channel_patterns_and_risks":[{"pattern_or_risk":"a","evidence":"b","why_it_matters":"c"}],'
             '"channel_notes":[<NOTE>],"missing_info":<MISSING>}}')
_NOTE = '{"platform":"Search","what_we_see":["x"],"what_it_likely_means":["y"],"risks_or_watchouts":["z"]}'
_NOTES = {
    1: _NOTE.replace('["x"]', "[null]"), 2: _NOTE.replace('"platform"', '"note":{"platform":5},"platform"'), 3: '"a text"',
    4: _NOTE.replace('["y"]', "[1]"), 8: _NOTE.replace('"Search"', "7"),
}


@query("analysis_types", "", "SELECT doc_id, doc_id % 9 IN (0, 2) AS valid, false AS parse_error FROM documents")
def analysis_types_q(spark, sf):
    """Wrong types at every depth; only mode 0 and a further nested field (2) are right."""
    parts = {"NOTE": _NOTES, "MISSING": {5: "null", 6: "[1]"}, "SUMMARY": {7: "12345678901"}}
    replies = _with(table(spark, sf, "documents"), _ANALYSIS, parts, {"SUMMARY": "<TEXT>", "NOTE": _NOTE, "MISSING": '["budget"]'}, 9)
    return R.check_analyses(replies).select("doc_id", "valid", "parse_error")


_EVALUATION = ('{"evaluation":{"clarity_score":4,"accuracy_score":4,"hallucination_score":4,"structure_score":4,"kpi_alignment_score":4,'
               '"clarity_reasoning":<REASON>,"accuracy_reasoning":"a","hallucination_reasoning":"b","structure_reasoning":"c",'
               '"kpi_alignment_reasoning":"d","total_score":20,"verdict":"accept","key_issues":<ISSUES>,"improvement_suggestions":[]}}')


@query("evaluation_types", "", "SELECT doc_id, doc_id % 8 IN (0, 7) AS valid, false AS parse_error FROM documents")
def evaluation_types_q(spark, sf):
    """Reasoning and issue lists of wrong types; only mode 0 and an empty list (7) are right."""
    parts = {"REASON": {3: "5", 4: '{"a":1}'}, "ISSUES": {1: "[1]", 2: '"[not a list"', 5: '[{"a":1}]', 6: "[null]", 7: "[]"}}
    replies = _with(table(spark, sf, "documents"), _EVALUATION, parts, {"REASON": "<TEXT>", "ISSUES": '["none"]'}, 8)
    return R.check_analysis_evaluations(replies).select("doc_id", "valid", "parse_error")
