"""Checked queries over model replies: validity, joins, scores, comparison, prompts, text checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from admeter.functions import bound_figures, numbers_in, unit_of, value_of
from admeter.operators import (
    cohorts as H, compare as V, diagnostics as D, ledger as L, prompts as P, quality as Q, responses as R, scoring as Z, stages as X,
)
from admeter.sinks import archive_prompts, high_water
from admeter.sources import analysis_evaluator_inputs, evaluation_records, recommendation_evaluator_inputs

from .ads import GOAL_SQL
from .registry import query, r2, total
from .views import (
    ads_events, analysis_replies, eval_scores, evaluation_replies, recommendation_evaluation_replies,
    recommendation_replies, recommendation_scores, table,
)


def _violations(df):
    return df.select("doc_id", F.array_join("violations", "; ").alias("violations"), "parse_error", "valid")


# --- validity -----------------------------------------------------------------------

@query("recommendation_valid", "docs", """, v AS (SELECT doc_id, m, CASE m WHEN 0 THEN 'not a JSON object' WHEN 1 THEN 'not exactly 4 cards'
  WHEN 2 THEN 'not exactly 4 cards' WHEN 3 THEN 'priority is not High, Medium or Low' WHEN 4 THEN 'what_you_should_do is empty'
  WHEN 5 THEN 'title is missing' WHEN 6 THEN 'recommendations is missing' ELSE '' END AS violations FROM docs)
SELECT doc_id, violations, m = 0 AS parse_error, violations = '' AS valid FROM v""")
def recommendation_valid_q(spark, sf):
    return _violations(R.check_recommendations(recommendation_replies(spark, sf)))


@query("analysis_valid", "docs", """, v AS (SELECT doc_id, m, CASE m WHEN 0 THEN 'not a JSON object'
  WHEN 1 THEN 'executive_summary is shorter than 10 characters' WHEN 2 THEN 'channel_notes is empty'
  WHEN 3 THEN 'channel_notes has an incomplete note' WHEN 4 THEN 'executive_summary is shorter than 10 characters'
  WHEN 5 THEN 'budget_and_efficiency has an incomplete item; results_and_value has an incomplete item'
  WHEN 6 THEN 'analysis is missing' WHEN 7 THEN 'results_and_value is missing' ELSE '' END AS violations FROM docs)
SELECT doc_id, violations, m = 0 AS parse_error, violations = '' AS valid FROM v""")
def analysis_valid_q(spark, sf):
    return _violations(R.check_analyses(analysis_replies(spark, sf)))


_EVAL_BAD = "doc_id % 23 = 0"
_EVAL_SUM = "clarity + accuracy + hallucination + structure + kpi_alignment"


@query("evaluation_valid", "eval_scores", f"""SELECT doc_id, {_EVAL_BAD} AS parse_error,
  CASE WHEN {_EVAL_BAD} THEN 'not a JSON object' ELSE concat_ws('; ',
    CASE WHEN clarity IS NULL THEN 'clarity score is not 1..5' END,
    CASE WHEN verdict = 'maybe' THEN 'verdict is missing or unknown' END,
    CASE WHEN doc_id % 19 = 0 THEN 'key_issues is not a list' END,
    CASE WHEN NOT coalesce(total_score = {_EVAL_SUM}, false) THEN 'total_score is not the sum of the scores' END) END AS violations,
  NOT ({_EVAL_BAD}) AND clarity IS NOT NULL AND verdict <> 'maybe' AND doc_id % 19 <> 0 AND total_score = {_EVAL_SUM} AS valid
FROM eval_scores""")
def evaluation_valid_q(spark, sf):
    return _violations(R.check_analysis_evaluations(evaluation_replies(spark, sf)))


@query("evaluation_legacy_valid", "eval_scores", f"""SELECT doc_id, NOT ({_EVAL_BAD}) AND coalesce(clarity <= 3, false) AND accuracy <= 3 AND structure <= 3
  AND verdict <> 'maybe' AND doc_id % 19 <> 0 AS valid FROM eval_scores""")
def evaluation_legacy_q(spark, sf):
    return R.check_legacy_evaluations(evaluation_replies(spark, sf)).select("doc_id", "valid")


@query("recommendation_evaluation_valid", "rec_scores", """SELECT doc_id, CASE WHEN expected_impact = 4 THEN 'Expected_Impact_Quality score is not 1..3' ELSE '' END AS violations,
  false AS parse_error, expected_impact <> 4 AS valid, CAST(coalesce(tone, 1) AS BIGINT) AS tone FROM rec_scores""")
def recommendation_evaluation_valid_q(spark, sf):
    out = R.check_recommendation_evaluations(recommendation_evaluation_replies(spark, sf))
    return out.select("doc_id", F.array_join("violations", "; ").alias("violations"), "parse_error", "valid",
                      F.col("scores.Tone_Audience_Compliance").cast("bigint").alias("tone"))


@query("total_check", "eval_scores", f"""SELECT doc_id, {_EVAL_BAD} AS parse_error, CASE WHEN NOT ({_EVAL_BAD}) THEN CAST(total_score AS BIGINT) END AS total_score,
  NOT ({_EVAL_BAD}) AND coalesce(total_score = {_EVAL_SUM}, false) AS total_ok FROM eval_scores""")
def total_check_q(spark, sf):
    out = R.check_analysis_evaluations(evaluation_replies(spark, sf))
    return out.select("doc_id", "parse_error", F.col("total_score").cast("bigint").alias("total_score"), "total_ok")


# --- joins -----------------------------------------------------------------------------

@query("latest_response", "docs", """SELECT cohort_id, run_id, attempt, doc_id FROM (
  SELECT *, row_number() OVER (PARTITION BY cohort_id, run_id ORDER BY attempt DESC, doc_id DESC) AS rk FROM docs) WHERE rk = 1""")
def latest_response_q(spark, sf):
    latest = R.latest_responses(analysis_replies(spark, sf), order_by=("attempt", "doc_id"))
    return latest.select("cohort_id", "run_id", "attempt", "doc_id")


@query("attach_responses", "docs", """, latest AS (SELECT doc_id, max(attempt) AS attempt FROM docs WHERE doc_id % 5 <> 0 GROUP BY 1)
SELECT d.doc_id, d.run_id, l.doc_id IS NOT NULL AS has_reply FROM docs d LEFT JOIN latest l ON d.doc_id = l.doc_id""")
def attach_responses_q(spark, sf):
    replies = analysis_replies(spark, sf)
    cohorts = replies.select("doc_id", "run_id")
    some = replies.filter("doc_id % 5 <> 0")
    out = R.attach_responses(cohorts, some, "analysis", "analysis", keys=("doc_id", "run_id"))
    return out.select("doc_id", "run_id", F.col("analysis").isNotNull().alias("has_reply"))


def _labelled(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.lit("analysis").alias("stage"), F.col("quality").cast("string").alias("raw"))


@query("pending_analysis", "", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_q(spark, sf):
    return R.pending(table(spark, sf, "documents").select("doc_id", "lang"), _labelled(spark, sf), "analysis", ("doc_id",))


@query("ready_for_recommendation", "", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def ready_q(spark, sf):
    return R.ready(table(spark, sf, "documents").select("doc_id", "lang"), _labelled(spark, sf), "analysis", ("doc_id",))


@query("provided_or_generated", "", """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN concat('given ', CAST(quality AS VARCHAR)) ELSE concat('made ', lang) END AS analysis
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def provided_q(spark, sf):
    given = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("given "), F.col("quality").cast("string")).alias("given"))
    docs = table(spark, sf, "documents").join(given, "doc_id", "left").withColumn("made", F.concat(F.lit("made "), "lang"))
    return R.prefer_provided(docs, "given", "made").select("doc_id", "analysis")


def _cards(spark, sf):
    return R.explode_cards(R.check_recommendations(recommendation_replies(spark, sf))).select("doc_id", "cohort_id", "card_no", "card.*")


_CARDS = """, n AS (SELECT doc_id, cohort_id, m, unnest(range(1, CASE m WHEN 1 THEN 4 WHEN 2 THEN 6 ELSE 5 END)) AS i FROM docs WHERE m NOT IN (0, 6)),
cards AS (SELECT doc_id, cohort_id, m, i, i - 1 AS card_no,
  CASE WHEN m = 5 AND i = 2 THEN NULL ELSE concat('Fix Item ', CAST(CASE WHEN m = 8 THEN i % 2 ELSE i % 9 END AS VARCHAR)) END AS title,
  CASE WHEN m = 3 AND i = 2 THEN 'Urgent' ELSE ['High','Medium','Low'][CAST(doc_id % 3 + 1 AS INT)] END AS priority,
  CASE WHEN i % 2 = 0 THEN 'Lower CPC by a tenth' ELSE 'More visits' END AS expected_impact,
  CASE WHEN m = 4 AND i = 1 THEN 0 ELSE 2 END AS n_actions FROM n)
"""


@query("cards_exploded", "docs", f"""{_CARDS} SELECT doc_id, cohort_id, card_no, coalesce(title, '-') AS title, priority, expected_impact,
  CAST(n_actions AS BIGINT) AS n_actions FROM cards""")
def cards_exploded_q(spark, sf):
    return _cards(spark, sf).select(
        "doc_id", "cohort_id", F.col("card_no").cast("bigint").alias("card_no"), F.coalesce("title", F.lit("-")).alias("title"),
        "priority", "expected_impact", F.size("what_you_should_do").cast("bigint").alias("n_actions"))


# --- scores and verdicts -------------------------------------------------------------------

_POINTS = "coalesce(clarity, 0) + accuracy + hallucination + structure + kpi_alignment"


def _eval_struct(spark, sf):
    df = eval_scores(spark, sf)
    return df.withColumn("scores", F.struct(*R.ANALYSIS_CRITERIA))


@query("analysis_scores", "eval_scores", f"""SELECT doc_id, coalesce(clarity, 0) AS clarity, accuracy, hallucination, structure, kpi_alignment,
  CAST({_POINTS} AS BIGINT) AS total, {r2(f'({_POINTS}) / CAST(5 AS DOUBLE)')} AS overall FROM eval_scores""")
def analysis_scores_q(spark, sf):
    return Z.score_analyses(_eval_struct(spark, sf)).select("doc_id", "scores.*")


@query("analysis_verdict", "eval_scores", """, v AS (SELECT doc_id, verdict, least(coalesce(clarity, 0), accuracy, hallucination, structure, kpi_alignment) AS low FROM eval_scores),
w AS (SELECT doc_id, verdict, CASE WHEN low <= 2 THEN 'reject' WHEN low >= 4 THEN 'accept' ELSE 'revise' END AS verdict_rule FROM v)
SELECT doc_id, verdict_rule, verdict = verdict_rule AS verdict_matches FROM w""")
def analysis_verdict_q(spark, sf):
    return Z.analysis_verdict(_eval_struct(spark, sf)).select("doc_id", "verdict_rule", "verdict_matches")


def _checked_recommendation_scores(spark, sf):
    return R.check_recommendation_evaluations(recommendation_evaluation_replies(spark, sf))


_REC_COLUMNS = {
    "Structure": "structure", "Feasibility": "feasibility", "Recommendation_Count": "recommendation_count",
    "Analysis_Grounding": "analysis_grounding", "Action_Step_Completeness": "action_step_completeness",
    "Priority_Alignment": "priority_alignment", "Tone_Audience_Compliance": "coalesce(tone, 1)",
    "Expected_Impact_Quality": "expected_impact",
}
_REC_SELECT = ", ".join(f"CAST({c} AS BIGINT) AS {n}" for n, c in _REC_COLUMNS.items())
_REC_OVERALL = f"({' + '.join(_REC_COLUMNS.values())}) / CAST(8 AS DOUBLE)"


@query("recommendation_scores", "rec_scores", f"SELECT doc_id, {_REC_SELECT}, {_REC_OVERALL} AS Overall_mean FROM rec_scores")
def recommendation_scores_q(spark, sf):
    out = Z.score_recommendations(_checked_recommendation_scores(spark, sf)).select("doc_id", "scores.*")
    return out.withColumnRenamed("Overall", "Overall_mean")


@query("recommendation_verdict", "rec_scores", f""", v AS (SELECT doc_id, verdict, least({', '.join(_REC_COLUMNS.values())}, instruction_adherence) AS low FROM rec_scores),
w AS (SELECT doc_id, verdict, CASE WHEN low >= 3 THEN 'accept' WHEN low <= 1 THEN 'reject' ELSE 'revise' END AS verdict_rule FROM v)
SELECT doc_id, verdict_rule, verdict = verdict_rule AS verdict_matches FROM w""")
def recommendation_verdict_q(spark, sf):
    return Z.recommendation_verdict(_checked_recommendation_scores(spark, sf)).select("doc_id", "verdict_rule", "verdict_matches")


# --- comparison of runs -----------------------------------------------------------------------

def _map_of(df, names, scores="scores"):
    pairs = []
    for n in names:
        pairs += [F.lit(n), F.col(f"{scores}.{n}").cast("double")]
    return F.create_map(*pairs)


def _records(spark, sf):
    """Records with a score map; every tenth lacks ``overall`` and is of no known kind."""
    scored = Z.score_analyses(_eval_struct(spark, sf))
    full = _map_of(scored, (*R.ANALYSIS_CRITERIA, "overall"))
    part = F.map_filter(full, lambda k, _: k != "overall")
    return scored.select("doc_id", "cohort_id", F.col("run_id").alias("version"),
                         F.when(F.col("doc_id") % 10 == 0, part).otherwise(full).alias("scores"))


def _rec_records(spark, sf):
    scored = Z.score_recommendations(_checked_recommendation_scores(spark, sf))
    return scored.select("doc_id", "cohort_id", F.col("run_id").alias("version"),
                         _map_of(scored, V.metrics_of("recommendation")).alias("scores"))


_FLAT = f""", flat AS (SELECT doc_id, cohort_id, run_id AS version, CAST(coalesce(clarity, 0) AS DOUBLE) AS clarity, CAST(accuracy AS DOUBLE) AS accuracy,
  CAST(hallucination AS DOUBLE) AS hallucination, CAST(structure AS DOUBLE) AS structure, CAST(kpi_alignment AS DOUBLE) AS kpi_alignment,
  {r2(f'({_POINTS}) / CAST(5 AS DOUBLE)')} AS overall FROM eval_scores WHERE doc_id % 10 <> 0)
"""


@query("score_type", "eval_scores rec_scores", """SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN 'analysis' ELSE 'none' END AS kind FROM eval_scores
UNION ALL SELECT doc_id, 'recommendation' FROM rec_scores""")
def score_type_q(spark, sf):
    kind = F.coalesce(V.score_type(F.col("scores")), F.lit("none")).alias("kind")
    return _records(spark, sf).select("doc_id", kind).unionByName(_rec_records(spark, sf).select("doc_id", kind))


@query("flatten_scores", "eval_scores", f"{_FLAT} SELECT * FROM flat")
def flatten_scores_q(spark, sf):
    return V.flatten_scores(_records(spark, sf), "analysis", keys=("doc_id", "cohort_id", "version"))


@query("unknown_scores", "eval_scores", """SELECT doc_id, cohort_id, run_id AS version, 'overall' AS lacking FROM eval_scores WHERE doc_id % 10 = 0""")
def unknown_scores_q(spark, sf):
    out = V.unknown_scores(_records(spark, sf))
    return out.select("doc_id", "cohort_id", "version", F.array_join("missing_for_analysis", ",").alias("lacking"))


@query("evaluation_records", "", """WITH r AS (SELECT doc_id, concat('run_', lang) AS version, lang, doc_id % 5 AS c, n_chars % 7 AS o, doc_id % 4 AS shape FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS cohort_id, version, CASE WHEN shape = 3 THEN 'Card' ELSE '-' END AS card_title, CAST(c AS DOUBLE) AS clarity,
  CAST(o AS DOUBLE) AS overall, lang AS verdict FROM r
UNION ALL SELECT CAST(doc_id AS VARCHAR), version, '-', CAST(c + 1 AS DOUBLE), CAST(o AS DOUBLE), lang FROM r WHERE shape = 1""")
def evaluation_records_q(spark, sf):
    """Result files of four shapes: one record, a list, a list in a field, and cards scored one by one."""
    docs = table(spark, sf, "documents")
    shape = F.col("doc_id") % 4

    def record(more: int = 0):
        scores = F.struct((F.col("doc_id") % 5 + more).alias("clarity"), (F.col("n_chars") % 7).alias("overall"))
        return F.struct(scores.alias("scores"), F.col("lang").alias("verdict"), F.col("text").alias("reasoning"))

    raw = (
        F.when(shape == 0, F.to_json(record())).when(shape == 1, F.to_json(F.array(record(), record(1))))
        .when(shape == 2, F.to_json(F.struct(F.lit("x").alias("note"), F.array(record()).alias("records"))))
        .otherwise(F.to_json(F.array(F.struct(F.lit("Card").alias("card_title"), record().alias("evaluation"))))))
    files = docs.select(F.col("doc_id").cast("string").alias("cohort_id"), F.concat(F.lit("run_"), "lang").alias("run_id"), raw.alias("raw"))
    return evaluation_records(files).select(
        "cohort_id", "version", F.coalesce("card_title", F.lit("-")).alias("card_title"),
        *[F.element_at("scores", n).alias(n) for n in ("clarity", "overall")], "verdict")


# Means of whole numbers only, so that both engines divide the same two numbers.
_AVG = ", ".join(f"avg({c}) AS {c}" for c in R.ANALYSIS_CRITERIA)


@query("version_summary_analysis", "eval_scores", f"{_FLAT} SELECT cohort_id, version, {_AVG}, {r2('avg(overall)')} AS overall FROM flat GROUP BY 1, 2")
def version_summary_q(spark, sf):
    out = V.version_summary(V.flatten_scores(_records(spark, sf), "analysis"), "analysis")
    return out.withColumn("overall", F.rint(F.col("overall") * 100.0) / 100.0)


@query("version_summary_recommendation", "rec_scores", f""", f AS (SELECT cohort_id, run_id AS version, {_REC_SELECT}, {_REC_OVERALL} AS o FROM rec_scores)
SELECT cohort_id, version, {', '.join(f'avg({c}) AS {c}' for c in _REC_COLUMNS)}, avg(o) AS Overall FROM f GROUP BY 1, 2""")
def version_summary_rec_q(spark, sf):
    scored = Z.score_recommendations(_checked_recommendation_scores(spark, sf)).withColumnRenamed("run_id", "version")
    return V.version_summary(V.flatten_scores(scored, "recommendation"), "recommendation")


@query("version_summary_last_2", "eval_scores", f"""{_FLAT}, s AS (SELECT cohort_id, version, {_AVG}, {r2('avg(overall)')} AS overall FROM flat GROUP BY 1, 2)
SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY cohort_id ORDER BY version DESC) AS rk FROM s) WHERE rk <= 2""")
def version_summary_last_q(spark, sf):
    out = V.version_summary(V.flatten_scores(_records(spark, sf), "analysis"), "analysis", last_n=2)
    return out.withColumn("overall", F.rint(F.col("overall") * 100.0) / 100.0)


@query("last_n_runs", "docs", """SELECT doc_id, cohort_id, run_id FROM (
  SELECT *, dense_rank() OVER (PARTITION BY cohort_id ORDER BY run_id DESC) AS rk FROM docs) WHERE rk <= 2""")
def last_n_runs_q(spark, sf):
    return V.last_n_runs(analysis_replies(spark, sf).select("doc_id", "cohort_id", "run_id"), 2)


@query("version_summary_merged", "eval_scores", f"{_FLAT} SELECT cohort_id, version, {', '.join(f'{total(c)}/count({c}) AS {c}' for c in (*R.ANALYSIS_CRITERIA, 'overall'))} FROM flat GROUP BY 1, 2")
def version_summary_merged_q(spark, sf):
    """States of four batches of scores, merged two by two, instead of a mean over all scores."""
    flat = V.flatten_scores(_records(spark, sf), "analysis", keys=("doc_id", "cohort_id", "version"))
    batch = lambda n: V.summary_state(flat.filter(F.col("doc_id") % 4 == n).drop("doc_id"), "analysis")
    stored = V.merge_states(batch(2), batch(0))
    return V.summary_of_state(V.merge_states(stored, V.merge_states(batch(3), batch(1))), "analysis")


@query("metric_version_matrix", "eval_scores", f"""{_FLAT}, s AS (SELECT cohort_id, version, {_AVG}, {r2('avg(overall)')} AS overall FROM flat GROUP BY 1, 2),
l AS (UNPIVOT s ON clarity, accuracy, hallucination, structure, kpi_alignment, overall INTO NAME metric VALUE score)
SELECT cohort_id, metric, max(score) FILTER (WHERE version = 'run_de') AS run_de, max(score) FILTER (WHERE version = 'run_en') AS run_en,
  max(score) FILTER (WHERE version = 'run_es') AS run_es, max(score) FILTER (WHERE version = 'run_fr') AS run_fr FROM l GROUP BY 1, 2""")
def matrix_q(spark, sf):
    return V.metric_version_matrix(version_summary_q(spark, sf), "analysis")


@query("union_runs", "eval_scores rec_scores", """SELECT doc_id, clarity, CAST(NULL AS BIGINT) AS feasibility, structure FROM eval_scores
UNION ALL SELECT doc_id, NULL, feasibility, structure FROM rec_scores""")
def union_runs_q(spark, sf):
    return V.union_runs([eval_scores(spark, sf).select("doc_id", "clarity", "structure"),
                         recommendation_scores(spark, sf).select("doc_id", "feasibility", "structure")])


@query("lower_version", "", "SELECT lower(o_orderpriority) AS version, count(*) AS n FROM orders GROUP BY 1")
def lower_version_q(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "version")
    return V.lower_text(orders).groupBy("version").agg(F.count("*").alias("n"))


# --- prompts --------------------------------------------------------------------------------------

_GOAL_OF = "CASE doc_id % 5 WHEN 0 THEN 'Increase Sales' WHEN 1 THEN 'Brand Awareness' WHEN 2 THEN 'Revenue Efficiency' WHEN 3 THEN 'Traffic' ELSE 'Other' END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_INSTRUCTION = "CASE goal " + " ".join(
    f"WHEN {_quoted(g)} THEN {_quoted(P.DEFAULT_TEMPLATES[t])}" for g, t in P.GOAL_TEMPLATES.items()) + " ELSE '' END"


@query("goal_instructions", "", f"SELECT doc_id, {_INSTRUCTION} AS instructions FROM (SELECT doc_id, {_GOAL_OF} AS goal FROM documents)")
def goal_instructions_q(spark, sf):
    texts = P.template_texts(P.default_templates(spark), P.GOAL_TEMPLATES.values())
    docs = table(spark, sf, "documents").withColumn("goal", F.expr(_GOAL_OF))
    return docs.select("doc_id", P.goal_instructions(F.col("goal"), texts).alias("instructions"))


def _prompt_inputs(spark, sf):
    """Documents as cohorts; the data is a whole text, and every ninth one holds a placeholder."""
    docs = table(spark, sf, "documents").withColumn("goal", F.expr(_GOAL_OF))
    data = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" {{CAMPAIGN_DATA}}"))).otherwise(F.col("text"))
    payloads = docs.select(F.col("doc_id").alias("cohort_id"), F.lit(0).alias("part"), data.alias("payload"))
    context = docs.select(
        F.col("doc_id").alias("cohort_id"), F.struct(F.col("goal").alias("primary_goal")).alias("campaign_target"),
        F.struct(F.col("lang").alias("industry")).alias("business_domain"))
    return payloads, context


_PAYLOAD = "CASE WHEN doc_id % 9 = 0 THEN concat(text, ' {{CAMPAIGN_DATA}}') ELSE text END"
_DOMAIN = "concat('{\"industry\":\"', lang, '\"}')"
_TARGET = "concat('{\"primary_goal\":\"', goal, '\"}')"
_USER = (f"replace(replace(replace({_quoted(P.DEFAULT_TEMPLATES['analysis/user'])}, '{{{{CAMPAIGN_DATA}}}}', {_PAYLOAD}), "
         f"'{{{{BUSINESS_DOMAIN}}}}', {_DOMAIN}), '{{{{CAMPAIGN_TARGET}}}}', {_TARGET})")
_SYSTEM = f"replace({_quoted(P.DEFAULT_TEMPLATES['analysis/system'])}, '{{{{GOAL_INSTRUCTIONS}}}}', {_INSTRUCTION})"


@query("analysis_prompts", "", f"""SELECT doc_id AS cohort_id, CASE WHEN doc_id % 9 = 0 THEN '{{{{CAMPAIGN_DATA}}}}' ELSE '' END AS unresolved,
  md5({_SYSTEM}) AS system_md5, md5({_USER}) AS user_md5 FROM (SELECT *, {_GOAL_OF} AS goal FROM documents)""")
def analysis_prompts_q(spark, sf):
    payloads, context = _prompt_inputs(spark, sf)
    out = P.analysis_prompts(payloads, context, P.default_templates(spark), strict=False)
    return out.select("cohort_id", F.array_join("unresolved", ",").alias("unresolved"),
                      F.md5(F.get("messages", F.lit(0))["content"]).alias("system_md5"),
                      F.md5(F.get("messages", F.lit(1))["content"]).alias("user_md5"))


_ASKED = (f"replace(replace(replace(replace({_quoted(P.DEFAULT_TEMPLATES['recommendation/user'])}, '{{{{CAMPAIGN_TARGET}}}}', {_TARGET}), "
          f"'{{{{BUSINESS_DOMAIN}}}}', {_DOMAIN}), '{{{{CAMPAIGN_DATA}}}}', text), '{{{{ANALYSIS_JSON}}}}', concat('{{\"doc\":', CAST(doc_id AS VARCHAR), '}}'))")


@query("recommendation_prompts", "", f"""SELECT doc_id AS cohort_id, CASE WHEN doc_id % 9 = 0 THEN '{{{{CAMPAIGN_DATA}}}}' ELSE '' END AS unresolved,
  CASE WHEN doc_id % 9 <> 0 THEN md5({_ASKED}) ELSE '-' END AS user_md5
FROM (SELECT *, {_GOAL_OF} AS goal FROM documents) WHERE doc_id IN (SELECT doc_id FROM labels)""")
def recommendation_prompts_q(spark, sf):
    payloads, context = _prompt_inputs(spark, sf)
    analyses = table(spark, sf, "labels").select(
        F.col("doc_id").alias("cohort_id"), F.concat(F.lit('{"doc":'), F.col("doc_id").cast("string"), F.lit("}")).alias("analysis"))
    out = P.recommendation_prompts(payloads, context, analyses, P.default_templates(spark))
    return out.select("cohort_id", F.array_join("unresolved", ",").alias("unresolved"),
                      F.coalesce(F.md5(F.get("messages", F.lit(1))["content"]), F.lit("-")).alias("user_md5"))


@query("unresolved_placeholders", "", """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '{{CAMPAIGN_DATA}}|{{LATER}}' ELSE '{{LATER}}' END AS unresolved FROM documents""")
def unresolved_q(spark, sf):
    payloads, _ = _prompt_inputs(spark, sf)
    text = P.fill(F.concat(F.lit("{{DATA}} then "), F.lit("{{LATER}}")), {"DATA": F.col("payload")})
    return payloads.select(F.col("cohort_id").alias("doc_id"), F.array_join(P.unresolved_placeholders(text), "|").alias("unresolved"))


_BAR = "=" * 20


@query("prompt_archive_text", "", f"""SELECT conv_id, md5(concat(string_agg(concat('{_BAR} ', upper(role), ' MESSAGE {_BAR}', chr(10), text, chr(10), chr(10)), '' ORDER BY turn),
  '{"=" * 57}', chr(10))) AS archive_md5 FROM conversations GROUP BY 1""")
def prompt_archive_q(spark, sf):
    # A conversation is one message list: its length is set by its own turns.
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return turns.select("conv_id", F.md5(P.archive_text(F.col("messages"))).alias("archive_md5"))


@query("prompt_attempts", "docs", """SELECT doc_id, cohort_id, run_id, row_number() OVER (PARTITION BY cohort_id, run_id ORDER BY doc_id) - 1 AS attempt FROM docs""")
def prompt_attempts_q(spark, sf):
    asked = analysis_replies(spark, sf).select("doc_id", "cohort_id", "run_id", F.lit("analysis_prompt").alias("prompt_name"))
    return archive_prompts(asked, order_by="doc_id").select(
        "doc_id", "cohort_id", "run_id", F.col("attempt").cast("bigint").alias("attempt"))


@query("prompt_numbers_go_on", "docs", """SELECT doc_id, cohort_id, run_id, row_number() OVER (PARTITION BY cohort_id, run_id ORDER BY doc_id % 2, doc_id) - 1 AS attempt FROM docs""")
def prompt_numbers_q(spark, sf):
    """Two calls, the second with the marks of the first."""
    asked = analysis_replies(spark, sf).select("doc_id", "cohort_id", "run_id", F.lit("analysis_prompt").alias("prompt_name"))
    first = archive_prompts(asked.filter("doc_id % 2 = 0"), order_by="doc_id")
    second = archive_prompts(asked.filter("doc_id % 2 = 1"), order_by="doc_id", marks=high_water(first))
    return first.unionByName(second).select("doc_id", "cohort_id", "run_id", F.col("attempt").cast("bigint").alias("attempt"))


@query("kpi_name_list", "ads_events", f""", g AS ({GOAL_SQL}), names AS (SELECT ordinal, kpi FROM g WHERE value IS NOT NULL UNION
  SELECT ordinal, unnest(['spend','revenue','impressions','clicks','conversions','roas','cpa','cvr','ctr']) FROM ads_events)
SELECT ordinal, string_agg(kpi, ', ' ORDER BY kpi) AS kpis FROM names GROUP BY 1""")
def kpi_name_list_q(spark, sf):
    from .ads import _summaries

    return _summaries(spark, sf).select("ordinal", P.kpi_names(F.array("summary")).alias("kpis"))


# --- text checks ---------------------------------------------------------------------------------------

# words of the operators' lists and look-alikes, added to whole texts; the same text serves both engines
_ADVICE = "CASE doc_id % 5 WHEN 0 THEN ' We Should improve it.' WHEN 1 THEN ' optimized, considered' WHEN 2 THEN ' Consider/recommend: optimize' ELSE '' END"
_DOUBT = "CASE turn % 3 WHEN 0 THEN ' It might, or could, work.' WHEN 1 THEN ' almighty' ELSE '' END"
_TREND = "CASE doc_id % 4 WHEN 0 THEN ' Trends: clicks rising' WHEN 1 THEN ' a trendy, uprising thing' WHEN 2 THEN ' Declining spend' ELSE '' END"


def _hits(words) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return (f"CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x IN ({listed}))) AS BIGINT)")


@query("banned_words", "", f"SELECT * FROM (SELECT doc_id, {_hits(Q.BANNED_IN_ANALYSIS)} AS n_banned FROM (SELECT doc_id, text || {_ADVICE} AS text FROM documents)) WHERE n_banned > 0")
def banned_words_q(spark, sf):
    return Q.banned_words(table(spark, sf, "documents").selectExpr("doc_id", f"text || {_ADVICE} AS text")).select("doc_id", "n_banned")


@query("hedging", "", f"SELECT * FROM (SELECT conv_id, turn, {_hits(Q.HEDGING)} AS n_hedges FROM (SELECT conv_id, turn, text || {_DOUBT} AS text FROM conversations)) WHERE n_hedges > 0")
def hedging_q(spark, sf):
    turns = table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"text || {_DOUBT} AS text")
    return Q.hedging(turns).select("conv_id", "turn", "n_hedges")


@query("metrics_per_insight", "docs", """SELECT doc_id, CAST(CASE WHEN m = 5 THEN 0 ELSE 1 END AS BIGINT) AS n_metrics FROM docs WHERE m IN (1, 2, 3, 4, 5, 8, 9, 10, 7, 11) AND m IN (5, 9)""")
def metrics_per_insight_q(spark, sf):
    checked = R.check_analyses(analysis_replies(spark, sf))
    insights = checked.select("doc_id", F.explode("reply.analysis.budget_and_efficiency").alias("i")).select("doc_id", "i.*")
    return Q.thin_insights(insights).select("doc_id", "n_metrics")


@query("duplicate_cards", "docs", f"""{_CARDS} SELECT doc_id, lower(title) AS title_key, count(*) AS n_cards FROM cards
GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_cards_q(spark, sf):
    return Q.duplicate_cards(_cards(spark, sf), keys=("doc_id",))


@query("impact_without_metric", "docs", f"{_CARDS} SELECT doc_id, card_no FROM cards WHERE expected_impact = 'More visits'")
def impact_q(spark, sf):
    return Q.impact_without_metric(_cards(spark, sf)).select("doc_id", F.col("card_no").cast("bigint").alias("card_no"))


@query("prerequisite_missing", "docs", f"{_CARDS} SELECT doc_id, card_no FROM cards WHERE doc_id % 4 < 2 AND (n_actions = 0 OR doc_id % 2 = 1)")
def prerequisite_q(spark, sf):
    cards = _cards(spark, sf).withColumn("depends_on_missing", F.col("doc_id") % 4 < 2)
    return Q.missing_prerequisite(cards).select("doc_id", F.col("card_no").cast("bigint").alias("card_no"))


@query("sections_present", "docs", """SELECT doc_id, m = 0 AS parse_error, CASE m WHEN 2 THEN 'channel_notes' WHEN 4 THEN 'executive_summary' WHEN 7 THEN 'results_and_value'
  WHEN 8 THEN 'missing_info' WHEN 10 THEN 'cross_channel_patterns_and_risks'
  WHEN 0 THEN 'executive_summary,budget_and_efficiency,results_and_value,cross_channel_patterns_and_risks,channel_notes,missing_info'
  WHEN 6 THEN 'executive_summary,budget_and_efficiency,results_and_value,cross_channel_patterns_and_risks,channel_notes,missing_info'
  ELSE '' END AS gaps FROM docs""")
def sections_q(spark, sf):
    checked = R.check_analyses(analysis_replies(spark, sf))
    return checked.select("doc_id", "parse_error", F.array_join(Q.section_gaps(F.col("reply.analysis")), ",").alias("gaps"))


def _quoting_reports(spark, sf):
    """One report per order quoting a CPC, a CTR as a percentage, and the order's price."""
    k = F.col("o_orderkey")
    cents = (k % 200).cast("string")
    return table(spark, sf, "orders").select(
        k.alias("report_id"), F.concat(F.lit("campaign_"), (F.col("o_custkey") % 10).cast("string")).alias("cohort_id"),
        F.concat(F.lit("CPC fell to $0."), F.lpad(cents, 3, "0"), F.lit(" while CTR was "), (k % 60).cast("string"),
                 F.lit("%, at a budget of "), F.format_number("o_totalprice", 2), F.lit(".")).alias("text"))


def _event_values(spark, sf):
    rows, _ = H.by_index(ads_events(spark, sf))
    days = D.daily(rows).select("cohort_id", "cpc", "ctr", "cvr", "spend")
    return days.unpivot("cohort_id", ["cpc", "ctr", "cvr", "spend"], "metric", "value")


_VALUES = """, d AS (SELECT concat('campaign_', CAST("index" AS VARCHAR)) AS cohort_id, platform, date, sum(clicks) AS clicks, sum(impressions) AS impressions,
  sum(conversions) AS conversions, CAST(sum(CAST(round_even(spend*1e6,0) AS BIGINT)) AS DOUBLE)/1e6 AS spend FROM ads_events GROUP BY ALL),
vals AS (SELECT DISTINCT cohort_id, metric, value FROM (
  SELECT cohort_id, 'cpc' AS metric, round_even(spend/nullif(CAST(clicks AS DOUBLE),0)*100,0)/100 AS value FROM d
  UNION ALL SELECT cohort_id, 'ctr', round_even(CAST(clicks AS DOUBLE)/nullif(CAST(impressions AS DOUBLE),0)*100,0)/100 FROM d
  UNION ALL SELECT cohort_id, 'cvr', round_even(CAST(conversions AS DOUBLE)/nullif(CAST(clicks AS DOUBLE),0)*100,0)/100 FROM d
  UNION ALL SELECT cohort_id, 'spend', spend FROM d) WHERE value IS NOT NULL),
known AS (SELECT cohort_id, CAST(round_even(value*100,0) AS BIGINT) AS cents, 'value' AS k FROM vals UNION
  SELECT cohort_id, CAST(round_even(value*100*100,0) AS BIGINT), 'percent' FROM vals WHERE metric IN ('ctr', 'cvr') UNION
  SELECT cohort_id, CAST(round_even(value*1000*100,0) AS BIGINT), 'misread' FROM vals WHERE metric IN ('ctr', 'cvr')),
figures AS (SELECT o_orderkey AS report_id, concat('campaign_', CAST(o_custkey % 10 AS VARCHAR)) AS cohort_id, unnest([0, 1, 2]) AS figure_no,
  unnest([CAST(o_orderkey % 200 AS DOUBLE) / 1000, CAST(o_orderkey % 60 AS DOUBLE), o_totalprice]) AS quoted, unnest([false, true, false]) AS percent FROM orders),
keyed AS (SELECT *, CAST(round_even(quoted*100,0) AS BIGINT) AS cents FROM figures),
checked AS (SELECT f.*, (f.cohort_id, f.cents) IN (SELECT (cohort_id, cents) FROM known WHERE k = 'value') AS v,
  (f.cohort_id, f.cents) IN (SELECT (cohort_id, cents) FROM known WHERE k = 'percent') AS p,
  (f.cohort_id, f.cents) IN (SELECT (cohort_id, cents) FROM known WHERE k = 'misread') AS x FROM keyed f)
"""


@query("figures_checked", "ads_events", f"""{_VALUES} SELECT report_id, cohort_id, CAST(figure_no AS BIGINT) AS figure_no, quoted, percent,
  v OR (percent AND p) AS grounded, percent AND NOT (v OR p) AND x AS misread_rate FROM checked""")
def figures_q(spark, sf):
    return Q.check_figures(_quoting_reports(spark, sf), _event_values(spark, sf)).drop("figure")


@query("ungrounded_numbers", "ads_events", f"""{_VALUES} SELECT report_id, CAST(figure_no AS BIGINT) AS figure_no, quoted FROM checked
WHERE NOT (v OR (percent AND p))""")
def ungrounded_q(spark, sf):
    return Q.ungrounded_figures(_quoting_reports(spark, sf), _event_values(spark, sf)).select("report_id", "figure_no", "quoted")


@query("figures_in_text")
def figures_in_text_q(spark, sf):
    """Figures in whole documents; the look-around pattern has no counterpart in the checking engine."""
    found = numbers_in(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(found).cast("bigint").alias("n_figures"))


# what a report says of two KPIs that its cohort lacks, and which of them it gives a figure for
_SAID = (
    (" MER reached 3.2; the refund rate was 4%.", "mer,refund_rate"), (" MER in Q3 was flat.", ""), (" MER (excl. returns) reached 3.2.", "mer"),
    ("\nMER was flat\n4% of orders came back", ""), (" A 4% refund rate hurt, as MER in 2024 did.", "refund_rate"),
    (" Search (refund rate 2.5%, MER) kept its 12 campaigns.", "refund_rate"), (" MER vs. 3.2 last year.", "mer"),
    (" CTR 2%, 3.2 MER", "mer"), (" The refund rate, in week 12, was not known.", ""),
)


@query("stated_null_kpis", "ads_events", f"""SELECT * FROM (SELECT o_orderkey AS report_id, concat('campaign_', CAST(o_custkey % 10 AS VARCHAR)) AS cohort_id,
  CASE o_orderkey % {len(_SAID)} {' '.join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(_SAID))} END AS stated
FROM orders WHERE o_custkey % 10 % 5 = 2) WHERE stated <> ''""")
def stated_null_q(spark, sf):
    rows, _ = H.by_index(ads_events(spark, sf))
    gaps = D.missing_info(rows, goal="primary_goal")
    said = F.lit("")
    for i, (text, _) in enumerate(_SAID):
        said = F.when(F.col("report_id") % len(_SAID) == i, text).otherwise(said)
    reports = _quoting_reports(spark, sf).withColumn("text", F.concat("text", said))
    out = Q.stated_null_kpis(reports, gaps, ["mer", "refund_rate", "purchases"])
    return out.select("report_id", "cohort_id", F.array_join("stated_null_kpis", ",").alias("stated"))


@query("figures_bound", "", """SELECT o_orderkey AS report_id, unnest([0, 0, 0]) AS clause, unnest(['cpc', 'ctr', '-']) AS name,
  unnest([CAST(o_orderkey % 200 AS DOUBLE) / 1000, CAST(o_orderkey % 60 AS DOUBLE), o_totalprice]) AS value, unnest(['$', '%', '']) AS unit FROM orders""")
def figures_bound_q(spark, sf):
    reports = _quoting_reports(spark, sf)
    one = reports.select("report_id", F.explode(bound_figures(F.col("text"), Q.METRIC_WORDS)).alias("f"))
    return one.select("report_id", F.col("f.clause").alias("clause"), F.coalesce("f.name", F.lit("-")).alias("name"),
                      value_of(F.col("f.quote")).alias("value"), unit_of(F.col("f.quote")).alias("unit"))


_CENTS = "CAST(round_even({0} * 1e6, 0) AS BIGINT)"
_SETS = """, base AS (SELECT concat('campaign_', CAST("index" AS VARCHAR)) AS cohort_id, platform, date, clicks, impressions, spend FROM ads_events),
g AS (SELECT cohort_id, sum(clicks)::DOUBLE AS clicks, sum(impressions)::DOUBLE AS impressions, CAST(sum(CAST(round_even(spend*1e6,0) AS BIGINT)) AS DOUBLE)/1e6 AS spend
  FROM base GROUP BY GROUPING SETS ((cohort_id), (cohort_id, platform), (cohort_id, date), (cohort_id, platform, date))),
known AS (SELECT DISTINCT cohort_id, metric, v FROM (
  SELECT cohort_id, 'spend' AS metric, spend AS v FROM g UNION ALL SELECT cohort_id, 'cpc', round_even(spend/nullif(clicks,0)*100,0)/100 FROM g
  UNION ALL SELECT cohort_id, 'ctr', round_even(clicks/nullif(impressions,0)*100,0)/100 FROM g) WHERE v IS NOT NULL),
q AS (SELECT o_orderkey AS report_id, concat('campaign_', CAST(o_custkey % 10 AS VARCHAR)) AS cohort_id, unnest([0, 1, 2]) AS quote_no, unnest(['cpc', 'spend', 'ctr']) AS metric,
  unnest([(o_orderkey % 50) / 100.0, ((o_orderkey % 39 + 1) * 1000 - CASE WHEN (o_orderkey % 39 + 1) % 10 = 0 THEN 5000 ELSE 500 END)::DOUBLE, (o_orderkey % 60 - 0.005)]) AS low,
  unnest([(o_orderkey % 50 + 3) / 100.0, ((o_orderkey % 39 + 1) * 1000 + CASE WHEN (o_orderkey % 39 + 1) % 10 = 0 THEN 5000 ELSE 500 END)::DOUBLE, (o_orderkey % 60 + 0.005)]) AS high FROM orders)
"""


@query("quotes_grounded", "ads_events", f"""{_SETS} SELECT report_id, CAST(quote_no AS BIGINT) AS quote_no, metric AS name, EXISTS (
  SELECT 1 FROM known k WHERE k.cohort_id = q.cohort_id AND k.metric = q.metric AND (k.v BETWEEN low AND high OR k.metric = 'ctr' AND k.v BETWEEN low / 100 AND high / 100)) AS grounded FROM q""")
def quotes_grounded_q(spark, sf):
    """Ranges, approximate sums and percentages, held against rows' and totals' values of all grouping sets."""
    k = F.col("o_orderkey")
    hundredths = lambda c: F.format_string("%d.%02d", F.floor(c / 100), c % 100)
    reports = table(spark, sf, "orders").select(
        k.alias("report_id"), F.concat(F.lit("campaign_"), (F.col("o_custkey") % 10).cast("string")).alias("cohort_id"),
        F.concat(F.lit("CPC was between $"), hundredths(k % 50), F.lit(" and $"), hundredths(k % 50 + 3), F.lit(", spend came to about "),
                 F.format_number((k % 39 + 1) * 1000, 0), F.lit("; CTR in Q3 was "), (k % 60).cast("string"), F.lit("%.")).alias("text"))
    rows, _ = H.by_index(ads_events(spark, sf))
    values = Q.total_values(rows.select("cohort_id", "platform", "date", "clicks", "impressions", "spend"))
    return Q.check_quotes(reports, values).select("report_id", "quote_no", "name", "grounded")


_STEMS = ("list_distinct(list_transform(list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), "
          "lambda w: w <> '' AND NOT list_contains([" + ", ".join(f"'{w}'" for w in Q.EMPTY_WORDS) + "], w)), lambda w: w[1:5]))")


@query("repeated_causes", "", f"""WITH s AS (SELECT lang, doc_id, {_STEMS} AS stems FROM documents),
p AS (SELECT a.lang, a.doc_id, b.doc_id AS same_as, len(list_intersect(a.stems, b.stems)) AS n, len(a.stems) + len(b.stems) AS total
  FROM s a JOIN s b ON a.lang = b.lang AND b.doc_id < a.doc_id WHERE len(a.stems) > 0),
k AS (SELECT lang, doc_id, same_as, n / (total - n) AS likeness FROM p WHERE n / (total - n) >= 0.5)
SELECT lang, doc_id, same_as, likeness FROM (SELECT *, row_number() OVER (PARTITION BY lang, doc_id ORDER BY same_as) AS rk FROM k) WHERE rk = 1""")
def repeated_causes_q(spark, sf):
    """Whole documents as causes: those of a language that say what an earlier one says."""
    return Q.repeated_causes(table(spark, sf, "documents"), text="text", card="doc_id", keys=("lang",))


_DAY = "CASE WHEN source > 'src3' THEN 0 ELSE doc_id % 2 END"  # later sources have one date


@query("trend_without_series", "", f""", spans AS (SELECT source, min({_DAY}) AS lo, max({_DAY}) AS hi FROM documents GROUP BY 1),
single AS (SELECT source FROM spans WHERE lo = hi)
SELECT * FROM (SELECT doc_id, source AS cohort_id, {_hits(Q.TREND_WORDS)} AS n_trend_words FROM (SELECT doc_id, source, text || {_TREND} AS text FROM documents)) WHERE n_trend_words > 0 AND cohort_id IN (SELECT source FROM single)""")
def trend_q(spark, sf):
    docs = table(spark, sf, "documents")
    ads = docs.selectExpr("source AS cohort_id", f"{_DAY} AS date")
    out = Q.trend_without_series(docs.selectExpr("doc_id", "source AS cohort_id", f"text || {_TREND} AS text"), ads)
    return out.select("doc_id", "cohort_id", "n_trend_words")


# --- evaluator inputs, errors, user code ------------------------------------------------------------------

@query("evaluator_input_fallback", "", """SELECT doc_id AS cohort_id, CASE WHEN doc_id % 3 = 0 THEN 'own' ELSE 'saved' END AS origin,
  CASE WHEN doc_id % 3 = 0 THEN 'own' ELSE lang END AS industry, CASE WHEN doc_id % 3 = 0 THEN 'Traffic' ELSE 'Unknown' END AS goal, length(text) AS n_text
FROM documents WHERE (doc_id % 3 = 0 OR doc_id IN (SELECT doc_id FROM labels)) AND doc_id % 7 <> 0""")
def evaluator_input_q(spark, sf):
    docs = table(spark, sf, "documents")
    d = F.col("doc_id")
    own = d % 3 == 0
    analysis = F.when(d % 7 != 0, F.struct(F.col("text").alias("executive_summary")))
    raw = F.to_json(F.struct(
        F.when(own, F.struct(F.lit("own").alias("campaign_identity"))).alias("campaign_data"),
        F.when(own, F.struct(F.lit("Traffic").alias("primary_goal"))).alias("campaign_target"),
        F.when(own, F.struct(F.lit("own").alias("industry"))).alias("business_domain"),
        analysis.alias("analysis")))
    reports = docs.select(d.alias("cohort_id"), F.lit("run_1").alias("run_id"), raw.alias("raw"))
    saved = F.to_json(F.array(F.struct(F.struct(F.col("lang").alias("industry")).alias("campaign_identity"))))
    summaries = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id").select(
        d.alias("cohort_id"), F.lit("run_1").alias("run_id"), saved.alias("raw"))
    out = analysis_evaluator_inputs(reports, summaries)
    return out.select(
        "cohort_id", F.when(F.col("campaign_data").contains('"own"'), "own").otherwise("saved").alias("origin"),
        F.get_json_object("business_domain", "$.industry").alias("industry"),
        F.get_json_object("campaign_target", "$.primary_goal").alias("goal"),
        F.char_length(F.get_json_object("analysis_report", "$.analysis.executive_summary")).cast("bigint").alias("n_text"))


@query("recommendation_evaluator_input", "docs", """SELECT doc_id AS cohort_id, CAST(CASE m WHEN 0 THEN 0 WHEN 6 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 4 END AS BIGINT) AS n_cards
FROM docs""")
def recommendation_input_q(spark, sf):
    replies = recommendation_replies(spark, sf)
    files = replies.select(F.col("doc_id").alias("cohort_id"), "run_id",
                           F.concat(F.lit('{"campaign_data":[1],"recommendation_response":'), "raw", F.lit("}")).alias("raw"))
    out = recommendation_evaluator_inputs(files)
    return out.select("cohort_id", F.size(F.from_json("recommendations", "ARRAY<STRING>")).cast("bigint").alias("n_cards"))


@query("error_column", "docs", """SELECT doc_id, concat_ws('; ', CASE WHEN m = 0 THEN 'analysis: bad reply' END, CASE WHEN doc_id % 5 = 0 THEN 'evaluation: no score' END) AS errors FROM docs""")
def error_column_q(spark, sf):
    checked = R.check_analyses(analysis_replies(spark, sf))
    out = X.add_error(checked, F.col("parse_error"), "analysis: bad reply")
    out = X.guarded(out, F.when(F.col("doc_id") % 5 != 0, F.lit(1)), "score", "evaluation: no score")
    return out.select("doc_id", F.array_join("errors", "; ").alias("errors"))


_DONE = f"{_EVAL_BAD} OR clarity IS NULL OR verdict = 'maybe' OR doc_id % 19 = 0 OR total_score <> {_EVAL_SUM}"


@query("outcome_ledger", "docs eval_scores", f""", a AS (SELECT doc_id, m, CASE m WHEN 0 THEN 'not a JSON object' WHEN 1 THEN 'executive_summary is shorter than 10 characters'
  WHEN 2 THEN 'channel_notes is empty' WHEN 3 THEN 'channel_notes has an incomplete note' WHEN 4 THEN 'executive_summary is shorter than 10 characters'
  WHEN 5 THEN 'budget_and_efficiency has an incomplete item; results_and_value has an incomplete item' WHEN 6 THEN 'analysis is missing'
  WHEN 7 THEN 'results_and_value is missing' END AS wrong FROM docs),
e AS (SELECT doc_id, concat_ws('; ', CASE WHEN {_EVAL_BAD} THEN 'not a JSON object' ELSE concat_ws('; ',
    CASE WHEN clarity IS NULL THEN 'clarity score is not 1..5' END, CASE WHEN verdict = 'maybe' THEN 'verdict is missing or unknown' END,
    CASE WHEN doc_id % 19 = 0 THEN 'key_issues is not a list' END,
    CASE WHEN NOT coalesce(total_score = {_EVAL_SUM}, false) THEN 'total_score is not the sum of the scores' END) END) AS wrong FROM eval_scores)
SELECT a.doc_id, CASE WHEN a.wrong IS NOT NULL THEN 'none' WHEN e.wrong = '' THEN 'evaluation' ELSE 'analysis' END AS last_stage,
  a.wrong IS NULL AND e.wrong = '' AS complete, CASE WHEN a.wrong IS NOT NULL THEN concat('analysis: ', a.wrong, '|evaluation: not reached')
  WHEN e.wrong <> '' THEN concat('evaluation: ', e.wrong) ELSE '' END AS errors FROM a JOIN e ON a.doc_id = e.doc_id""")
def outcome_ledger_q(spark, sf):
    """Every document as a cohort: its analysis, and the evaluation of those whose analysis is valid."""
    cohorts = table(spark, sf, "documents").select("doc_id")
    analyses = R.check_analyses(analysis_replies(spark, sf)).select("doc_id", "valid", "violations")
    scored = evaluation_replies(spark, sf).join(analyses.filter("valid").select("doc_id"), "doc_id", "left_semi")
    evaluations = R.check_analysis_evaluations(scored).select("doc_id", "valid", "violations")
    out = L.outcome_ledger(cohorts, {"analysis": analyses, "evaluation": evaluations}, cohort="doc_id")
    return out.select("doc_id", "last_stage", "complete", F.array_join("errors", "|").alias("errors"))


@query("model_call", "", """SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'failed' ELSE CAST(length(text) AS VARCHAR) END AS reply FROM documents""")
def model_call_q(spark, sf):
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"), F.col("doc_id").alias("n")))
    asked = table(spark, sf, "documents").select("doc_id", message.alias("messages"))

    def model(messages):
        if messages[0]["n"] % 50 == 0:
            raise RuntimeError("no reply")
        return str(len(messages[0]["content"]))

    out = X.call_model(asked, model, stage="analysis", keys=("doc_id",))
    return out.select("doc_id", F.coalesce("raw", F.lit("failed")).alias("reply"))
