"""Views that give the test tables the shapes of ad tables and reply tables.

Each view exists twice: as a Spark function and as SQL in ``VIEW_SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

GOALS = ("Increase Sales", "Brand Awareness", "Revenue Efficiency", "Traffic", "Community Growth")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(expr: str, values) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE {expr} {cases} END)"


# --- ads_events: one ad row per user and day ------------------------------------
# The same text serves both engines; {day} and {q} differ.

_EVENTS = """
SELECT user_id % 10 AS {q}index{q}, {day} AS date, concat('platform_', CAST(user_id % 3 AS {text})) AS platform,
  concat('c', CAST(user_id AS {text})) AS campaign_name,
  {ctype} AS campaign_type, {goal} AS primary_goal, concat('industry_', CAST(user_id % 4 AS {text})) AS industry,
  concat('offer_', CAST(user_id % 6 AS {text})) AS offering,
  CAST(sum(CASE WHEN event_type = 'view' THEN 500 + event_id % 997 ELSE 50 + event_id % 53 END) AS BIGINT) AS impressions,
  CAST(sum(CASE WHEN event_type = 'click' THEN 20 + event_id % 31 ELSE event_id % 5 END) AS BIGINT) AS clicks,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 + event_id % 7 ELSE 0 END) AS BIGINT) AS conversions,
  CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS spend,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS conversion_value,
  CAST(sum(40 + event_id % 211) AS BIGINT) AS reach,
  CASE WHEN user_id % 7 <> 0 THEN CAST(sum(CASE WHEN event_type = 'signup' THEN event_id % 29 ELSE event_id % 3 END) AS BIGINT) END AS landing_page_views,
  CAST(count(*) * 5 AS BIGINT) AS sessions,
  min(event_id) AS ordinal
FROM events GROUP BY user_id, {day}
"""
_EVENT_PARTS = {
    "ctype": _pick("user_id % 10 % 4", ("Search", "Shopping", "Video", "Display")),
    "goal": _pick("user_id % 10 % 5", GOALS),
    "day": "CAST(ts AS DATE)",
}


def ads_events(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql(_EVENTS.format(q="`", text="STRING", **_EVENT_PARTS))


# --- ads_orders: one ad row per nation, day, segment and priority ---------------

_ORDERS = """
SELECT CAST(c_nationkey AS BIGINT) AS {q}index{q}, CAST(o_orderdate AS DATE) AS date, c_mktsegment AS platform,
  o_orderpriority AS campaign_type,
  CAST(sum(quantity) AS BIGINT) AS clicks, CAST(sum(quantity) * 10 AS BIGINT) AS impressions,
  CAST(sum(discounted) AS DOUBLE) AS spend, CAST(sum(net) AS DOUBLE) AS conversion_value,
  CAST(sum(net) AS DOUBLE) AS total_revenue, CAST(sum(discounted) AS DOUBLE) AS total_marketing_spend,
  CAST(count(*) AS BIGINT) AS orders, CAST(count(*) AS BIGINT) AS conversions, CAST(sum(returned) AS BIGINT) AS refunds,
  CAST(sum(discounted) AS DOUBLE) / count(DISTINCT c_custkey) AS cac,
  CAST(sum(net) AS DOUBLE) / count(DISTINCT c_custkey) AS lifetime_value,
  CAST(sum(net) AS DOUBLE) / count(DISTINCT c_custkey) / CAST(12 AS DOUBLE) AS monthly_gross_profit_per_customer,
  min(o_orderkey) AS ordinal
FROM (
  SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
    sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS discounted,
    sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))) AS net,
    sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned
  FROM lineitem GROUP BY l_orderkey
) l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
GROUP BY c_nationkey, CAST(o_orderdate AS DATE), c_mktsegment, o_orderpriority
"""


def ads_orders(spark: SparkSession, sf: str) -> DataFrame:
    for name in ("lineitem", "orders", "customer"):
        table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(_ORDERS.format(q="`"))


# --- ads_dirty: raw text rows with messy headers ----------------------------------

def ads_dirty(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.when(e % 97 == 0, "bad-date").otherwise(F.date_format("ts", "M/d/yyyy")).alias(" Day "),
        F.lit("9").alias("Cost"),
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("Platform"),
        F.col("event_type").alias("Campaign Type"),
        F.when(e % 101 == 0, "1e3").when(e % 103 == 0, "1,000")
        .otherwise(F.concat(F.lit(" "), (100 + e % 400).cast("string"))).alias("Impr."),
        (e % 37).cast("string").alias("Clicks"),
        F.when(e % 4 != 0, (e % 5).cast("string")).alias("Results"),
        F.lit(None).cast("string").alias("Empty"),
        F.when(e % 53 == 0, F.lit(None)).when(e % 89 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("spend"),
        (e % 9 / 100.0).cast("double").alias("CTR"),
        F.when(e % 3 == 0, F.lit(None)).otherwise((e % 1000).cast("double")).alias("reach"),
        e.alias("ordinal"),
    )


_DIRTY = """
SELECT CASE WHEN event_id % 97 = 0 THEN 'bad-date' ELSE strftime(ts, '%-m/%-d/%Y') END AS date,
  concat('p', CAST(user_id AS VARCHAR)) AS platform, event_type AS campaign_type,
  CASE WHEN event_id % 101 = 0 THEN '1e3' WHEN event_id % 103 = 0 THEN '1,000'
    ELSE concat(' ', CAST(100 + event_id % 400 AS VARCHAR)) END AS impressions,
  CAST(event_id % 37 AS VARCHAR) AS clicks,
  CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 5 AS VARCHAR) END AS conversions,
  CAST(NULL AS VARCHAR) AS Empty,
  CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS spend,
  (event_id % 9) / CAST(100 AS DOUBLE) AS reported_ctr,
  CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 1000 AS DOUBLE) END AS reach,
  event_id AS ordinal
FROM events
"""
_TYPED = """
SELECT CASE WHEN date <> 'bad-date' THEN CAST(strptime(date, '%-m/%-d/%Y') AS DATE) END AS date, platform, campaign_type,
  coalesce(TRY_CAST(trim(impressions) AS DOUBLE), 0) AS impressions, coalesce(TRY_CAST(trim(clicks) AS DOUBLE), 0) AS clicks,
  coalesce(TRY_CAST(trim(conversions) AS DOUBLE), 0) AS conversions, coalesce(TRY_CAST(trim(spend) AS DOUBLE), 0) AS spend,
  reported_ctr, reach, ordinal
FROM ads_dirty
"""

# --- eval_scores: scores of one reply per document --------------------------------

_EVAL = """
SELECT doc_id, source AS cohort_id, concat('run_', lang) AS run_id,
  CASE WHEN doc_id % 11 <> 0 THEN CAST(1 + doc_id % 5 AS BIGINT) END AS clarity,
  CAST(1 + (doc_id * 3) % 5 AS BIGINT) AS accuracy, CAST(1 + (doc_id * 7 + 1) % 5 AS BIGINT) AS hallucination,
  CAST(1 + n_chars % 5 AS BIGINT) AS structure, CAST(1 + (doc_id + n_chars) % 5 AS BIGINT) AS kpi_alignment,
  CAST(1 + doc_id % 5 + 1 + (doc_id * 3) % 5 + 1 + (doc_id * 7 + 1) % 5 + 1 + n_chars % 5 + 1 + (doc_id + n_chars) % 5
    + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS BIGINT) AS total_score,
  CASE doc_id % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'revise' WHEN 2 THEN 'reject' ELSE 'maybe' END AS verdict, n_chars
FROM documents
"""
_REC_EVAL = """
SELECT doc_id, source AS cohort_id, concat('run_', lang) AS run_id,
  CAST(1 + doc_id % 3 AS BIGINT) AS structure, CAST(1 + (doc_id + n_chars) % 3 AS BIGINT) AS feasibility,
  CAST(1 + n_chars % 3 AS BIGINT) AS recommendation_count, CAST(3 - doc_id % 2 AS BIGINT) AS analysis_grounding,
  CAST(3 - n_chars % 2 AS BIGINT) AS action_step_completeness, CAST(2 + n_chars % 2 AS BIGINT) AS priority_alignment,
  CASE WHEN doc_id % 7 <> 0 THEN CAST(3 - doc_id % 2 AS BIGINT) END AS tone,
  CASE WHEN doc_id % 17 = 0 THEN CAST(4 AS BIGINT) ELSE CAST(3 AS BIGINT) END AS expected_impact,
  CAST(3 AS BIGINT) AS instruction_adherence,
  CASE WHEN n_chars % 2 = 0 THEN 'accept' ELSE 'reject' END AS verdict
FROM documents
"""


def _documents(spark: SparkSession, sf: str) -> None:
    table(spark, sf, "documents").createOrReplaceTempView("documents")


def eval_scores(spark: SparkSession, sf: str) -> DataFrame:
    _documents(spark, sf)
    return spark.sql(_EVAL)


def recommendation_scores(spark: SparkSession, sf: str) -> DataFrame:
    _documents(spark, sf)
    return spark.sql(_REC_EVAL)


def _reply(fields: dict) -> F.Column:
    """JSON text of an evaluation; nulls become absent keys."""
    return F.to_json(F.struct(F.struct(*[v.alias(k) for k, v in fields.items()]).alias("evaluation")))


def evaluation_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Analysis evaluations as raw replies.  Some quote their scores, some have no issue list."""
    scores = eval_scores(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    quoted = {f"{c}_score": F.col(c) for c in ("accuracy", "hallucination", "structure", "kpi_alignment")}
    fields = {"clarity_score": F.col("clarity").cast("string"), **quoted}
    fields |= {f"{c}_reasoning": F.lit(f"about {c}") for c in ("accuracy", "hallucination", "structure", "kpi_alignment")}
    fields |= {
        "clarity_reasoning": F.col("text"), "total_score": F.col("total_score"), "verdict": F.col("verdict"),
        "key_issues": F.when(F.col("doc_id") % 19 != 0, F.array(F.lit("none"))),
        "improvement_suggestions": F.array().cast("array<string>"),
    }
    raw = _reply(fields)
    raw = F.when(F.col("doc_id") % 23 == 0, F.concat(F.lit("{"), raw)).otherwise(raw)
    return scores.select("doc_id", "cohort_id", "run_id", raw.alias("raw"))


def recommendation_evaluation_replies(spark: SparkSession, sf: str) -> DataFrame:
    scores = recommendation_scores(spark, sf)
    names = {
        "structure": "structure", "feasibility": "feasibility", "recommendation_count": "Recommendation_Count",
        "analysis_grounding": "Analysis_Grounding", "action_step_completeness": "Action_Step_Completeness",
        "priority_alignment": "Priority_Alignment", "tone": "Tone_&_Audience_Compliance",
        "expected_impact": "Expected_Impact_Quality", "instruction_adherence": "instruction_adherence",
    }
    fields = {f"{n}_score": F.col(c) for c, n in names.items()}
    fields |= {f"{n}_reasoning": F.lit(f"about {n}") for n in names.values()}
    fields |= {"verdict": F.col("verdict"), "key_issues": F.array(F.lit("none")),
               "improvement_suggestions": F.array(F.lit("none"))}
    return scores.select("doc_id", "cohort_id", "run_id", _reply(fields).alias("raw"))


# --- replies of the first two stages ------------------------------------------------

def recommendation_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Four cards per document; ``doc_id % 12`` says what is wrong with them."""
    docs = table(spark, sf, "documents")
    m = F.col("doc_id") % 12
    n = F.when(m == 1, 3).when(m == 2, 5).otherwise(4)
    priority = F.element_at(F.array(F.lit("High"), F.lit("Medium"), F.lit("Low")), (F.col("doc_id") % 3 + 1).cast("int"))

    def card(i):
        return F.struct(
            F.when((m != 5) | (i != 2), F.concat(F.lit("Fix Item "), (i % F.when(m == 8, 2).otherwise(9)).cast("string"))).alias("title"),
            F.col("text").alias("whats_happening"),
            F.when((m == 4) & (i == 1), F.array().cast("array<string>"))
            .otherwise(F.array(F.when(F.col("doc_id") % 2 == 0, "First, obtain the data").otherwise("Shift the budget"),
                               F.lit("Then check"))).alias("what_you_should_do"),
            F.lit("it costs sales").alias("why_this_matters"),
            F.when((m == 3) & (i == 2), "Urgent").otherwise(priority).alias("priority"),
            F.when(i % 2 == 0, "Lower CPC by a tenth").otherwise("More visits").alias("expected_impact"),
            F.lit("Growth Team").alias("owner_suggestion"),
        )

    cards = F.transform(F.sequence(F.lit(1), n), card)
    raw = F.to_json(F.struct(F.when(m != 6, cards).alias("recommendations")))
    raw = F.when(m == 0, F.concat(F.lit("{"), raw)).otherwise(raw)
    return docs.select("doc_id", F.col("source").alias("cohort_id"), F.concat(F.lit("run_"), "lang").alias("run_id"),
                       F.lit("recommendation").alias("stage"), (F.col("doc_id") % 3).alias("attempt"), raw.alias("raw"))


def analysis_replies(spark: SparkSession, sf: str) -> DataFrame:
    """One analysis per document with its whole text; ``doc_id % 12`` says what is wrong."""
    docs = table(spark, sf, "documents")
    m = F.col("doc_id") % 12
    insight = F.struct(F.lit("spend held").alias("insight"),
                       F.when(m != 5, F.when(m == 9, "CPC $1.26").otherwise("CPC $1.26, ROAS 1.8")).alias("evidence"),
                       F.lit("sales").alias("business_impact"))
    pattern = F.struct(F.lit("overlap").alias("pattern_or_risk"), F.lit("CTR 0.04").alias("evidence"),
                       F.lit("waste").alias("why_it_matters"))
    one = F.array(F.lit("a note"))
    note = F.struct(F.lit("Search").alias("platform"),
                    F.when(m == 3, F.array().cast("array<string>")).otherwise(one).alias("what_we_see"),
                    one.alias("what_it_likely_means"), one.alias("risks_or_watchouts"))
    body = F.struct(
        F.when(m == 1, "Too short").when(m == 4, F.lit(None)).otherwise(F.concat(F.lit("Mixed results. "), "text")).alias("executive_summary"),
        F.array(insight).alias("budget_and_efficiency"),
        F.when(m != 7, F.array(insight)).alias("results_and_value"),
        F.when(m == 10, F.filter(F.array(pattern), lambda _: F.lit(False))).otherwise(F.array(pattern)).alias("cross_channel_patterns_and_risks"),
        F.when(m == 2, F.filter(F.array(note), lambda _: F.lit(False))).otherwise(F.array(note)).alias("channel_notes"),
        F.when(m != 8, one).alias("missing_info"),
    )
    raw = F.to_json(F.struct(F.when(m != 6, body).alias("analysis")))
    raw = F.when(m == 0, F.concat(F.lit("{"), raw)).otherwise(raw)
    return docs.select("doc_id", F.col("source").alias("cohort_id"), F.concat(F.lit("run_"), "lang").alias("run_id"),
                       F.lit("analysis").alias("stage"), (F.col("doc_id") % 3).alias("attempt"), raw.alias("raw"))


_KEYED = """SELECT doc_id, source AS cohort_id, concat('run_', lang) AS run_id, doc_id % 3 AS attempt, doc_id % 12 AS m, text FROM documents"""

VIEW_SQL = {
    "ads_events": _EVENTS.format(q='"', text="VARCHAR", **_EVENT_PARTS),
    "ads_orders": _ORDERS.format(q='"'),
    "ads_dirty": _DIRTY,
    "ads_typed": _TYPED,
    "eval_scores": _EVAL,
    "rec_scores": _REC_EVAL,
    "docs": _KEYED,
}
