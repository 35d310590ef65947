import copy
import json

import pytest
from pyspark.sql import functions as F

from admeter.operators import compare as V, diagnostics as D, quality as Q, responses as R, scoring as Z
from admeter.sources import analysis_evaluator_inputs, recommendation_evaluator_inputs

CARD = {"title": "T", "whats_happening": "w", "what_you_should_do": ["a"], "why_this_matters": "y", "priority": "High",
        "expected_impact": "CPC", "owner_suggestion": "o"}
INSIGHT = {"insight": "i", "evidence": "CPC $1.26, ROAS 1.8", "business_impact": "b"}
ANALYSIS = {"analysis": {
    "executive_summary": "Mixed results overall", "budget_and_efficiency": [INSIGHT], "results_and_value": [INSIGHT],
    "cross_channel_patterns_and_risks": [{"pattern_or_risk": "p", "evidence": "e", "why_it_matters": "w"}],
    "channel_notes": [{"platform": "P", "what_we_see": ["a"], "what_it_likely_means": ["b"], "risks_or_watchouts": ["c"]}],
    "missing_info": ["LTV"]}}


def check(spark, fn, *payloads, **options):
    raws = [(i, p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(raws, "i int, raw string")
    return fn(df, **options).orderBy("i").collect()


def changed(base, path, value="__drop__"):
    out = copy.deepcopy(base)
    at = out
    for step in path[:-1]:
        at = at[step]
    if value == "__drop__":
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


def test_recommendation_replies(spark):
    good = {"recommendations": [CARD] * 4}
    cases = [
        (good, True), ({"recommendations": [{**CARD, "extra": 1}] * 4, "more": {}}, True),
        ({"recommendations": [CARD] * 3}, False), ({"recommendations": [CARD] * 5}, False), ({"recommendations": []}, False),
        (changed(good, ("recommendations", 2, "title")), False), (changed(good, ("recommendations", 0, "priority"), "Urgent"), False),
        (changed(good, ("recommendations", 3, "what_you_should_do"), []), False),
        (changed(good, ("recommendations", 1, "owner_suggestion"), None), False),
        (changed(good, ("recommendations", 1, "title"), 5), False),
        (changed(good, ("recommendations", 1, "what_you_should_do"), ["a", 2]), False),
        (changed(good, ("recommendations", 1, "what_you_should_do"), "a"), False),
        (changed(good, ("recommendations", 1, "what_you_should_do"), [None]), False),
        (changed(good, ("recommendations", 1, "note"), {"title": 5, "what_you_should_do": 1}), True),
        ({"other": 1}, False), ("not json", False), ("{\"recommendations\": [", False), (None, False), ([1, 2], False),
    ]
    out = check(spark, R.check_recommendations, *[c for c, _ in cases])
    assert [(i, r["valid"]) for i, r in enumerate(out)] == [(i, v) for i, (_, v) in enumerate(cases)]
    assert out[9]["violations"] == ["title is not text"]
    assert [r["parse_error"] for r in out[-4:-1]] == [True, True, True]
    assert out[12]["violations"] == ["what_you_should_do is not a list of text"]


def test_shared_dicts_are_copied():
    assert changed(ANALYSIS, ("analysis", "executive_summary"), "x") != ANALYSIS


def test_analysis_replies(spark):
    a = "analysis"
    cases = [
        (ANALYSIS, True), (changed(ANALYSIS, (a, "missing_info")), True),
        (changed(ANALYSIS, (a, "cross_channel_patterns_and_risks"), []), True),
        (changed(ANALYSIS, (a, "executive_summary"), "Too short"), False), (changed(ANALYSIS, (a, "executive_summary"), "Just long!"), True),
        (changed(ANALYSIS, (a, "executive_summary")), False), (changed(ANALYSIS, (a, "channel_notes"), []), False),
        (changed(ANALYSIS, (a, "channel_notes", 0, "what_we_see"), []), False),
        (changed(ANALYSIS, (a, "channel_notes", 0, "platform")), False),
        (changed(ANALYSIS, (a, "results_and_value")), False), (changed(ANALYSIS, (a, "budget_and_efficiency", 0, "evidence")), False),
        (changed(ANALYSIS, (a, "executive_summary"), 12345678901), False), (changed(ANALYSIS, (a, "missing_info"), [1]), False),
        (changed(ANALYSIS, (a, "missing_info"), None), False), (changed(ANALYSIS, (a, "missing_info"), []), True),
        (changed(ANALYSIS, (a, "missing_info"), [None]), False), (changed(ANALYSIS, (a, "channel_notes", 0, "what_we_see"), [None]), False),
        (changed(ANALYSIS, (a, "channel_notes", 0, "what_we_see"), ["a", None]), False),
        (changed(ANALYSIS, (a, "results_and_value", 0, "evidence"), {"a": 1}), False),
        (changed(ANALYSIS, (a, "channel_notes", 0, "note"), {"platform": 5}), True),
        ({"x": 1}, False), ("", False),
    ]
    out = check(spark, R.check_analyses, *[c for c, _ in cases])
    assert [(i, r["valid"]) for i, r in enumerate(out)] == [(i, v) for i, (_, v) in enumerate(cases)]


def evaluation(scores=4, **more):
    body = {f"{c}_score": scores for c in R.ANALYSIS_CRITERIA} | {f"{c}_reasoning": "r" for c in R.ANALYSIS_CRITERIA}
    return {"evaluation": {**body, "total_score": 5 * int(float(scores)), "verdict": "accept", "key_issues": [],
                           "improvement_suggestions": ["s"], **more}}


def test_evaluation_replies(spark):
    cases = [
        (evaluation(), True), (evaluation("3"), True), (evaluation(3.0), True), (evaluation(6), False), (evaluation(0), False),
        (evaluation(total_score=19), False), (evaluation(verdict="maybe"), False), (evaluation(clarity_score=3.5), False),
        (evaluation(key_issues="x"), False), (evaluation(clarity_reasoning=None), False), ({"evaluation": None}, False), ("x", False),
        (evaluation(key_issues=[1]), False), (evaluation(key_issues="[not a list"), False), (evaluation(key_issues=[{"a": 1}]), False),
        (evaluation(key_issues=[None]), False), (evaluation(key_issues=None), False), (evaluation(clarity_reasoning=5), False),
        (evaluation(clarity_reasoning={"a": 1}), False), (evaluation(verdict=["accept"]), False), (evaluation(note={"verdict": 1}), True)]
    out = check(spark, R.check_analysis_evaluations, *[c for c, _ in cases])
    assert [(i, r["valid"]) for i, r in enumerate(out)] == [(i, v) for i, (_, v) in enumerate(cases)]
    loose = check(spark, R.check_analysis_evaluations, evaluation(total_score=19), require_total_match=False)[0]
    assert loose["valid"] and not loose["total_ok"] and loose["improvement_suggestions"] == ["s"]
    assert check(spark, R.check_legacy_evaluations, evaluation(3), evaluation(4))[0]["valid"]
    assert not check(spark, R.check_legacy_evaluations, evaluation(4))[0]["valid"]
    assert not check(spark, R.check_legacy_evaluations, evaluation(3, key_issues=[1]))[0]["valid"]


def card_evaluation(score=3, skip=(), **more):
    names = ("structure", "feasibility", "Recommendation_Count", "Analysis_Grounding", "Action_Step_Completeness", "Priority_Alignment",
             "Tone_&_Audience_Compliance", "Expected_Impact_Quality", "instruction_adherence")
    body = {f"{n}_score": score for n in names if n not in skip} | {f"{n}_reasoning": "r" for n in names}
    return {"evaluation": {**body, "verdict": "any text", "key_issues": [], "improvement_suggestions": [], **more}}


def test_card_evaluations_and_scores(spark):
    tone = "Tone_&_Audience_Compliance"
    cases = [card_evaluation(), card_evaluation(skip=(tone,)), card_evaluation(4), card_evaluation(skip=("feasibility",)),
             card_evaluation(**{f"{tone}_reasoning": 5}), card_evaluation(key_issues=[1])]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, raw string")
    checked = R.check_recommendation_evaluations(df)
    assert [r["valid"] for r in checked.orderBy("i").collect()] == [True, True, False, False, False, False]
    scored = Z.score_recommendations(Z.recommendation_verdict(checked)).orderBy("i").collect()
    assert [r["scores"]["Overall"] for r in scored][:4] == [3.0, 2.75, 4.0, 2.625]
    assert [r["verdict_rule"] for r in scored][:2] == ["accept", "reject"]
    assert scored[1]["scores"]["Tone_Audience_Compliance"] == 1 and scored[3]["scores"]["Feasibility"] == 0


@pytest.mark.parametrize("points, total, overall, rule", [
    ((4, 4, 5, 5, 5), 23, 4.6, "accept"), ((4, 4, 5, 4, 4), 21, 4.2, "accept"), ((3, 4, 5, 5, 5), 22, 4.4, "revise"),
    ((2, 5, 5, 5, 5), 22, 4.4, "reject"), ((None, 5, 5, 5, 5), 20, 4.0, "reject"), ((3, 3, 3, 3, 3), 15, 3.0, "revise")])
def test_analysis_scores(spark, points, total, overall, rule):
    df = spark.createDataFrame([(*points, "accept")], ", ".join(f"{c} int" for c in R.ANALYSIS_CRITERIA) + ", verdict string")
    df = df.withColumn("scores", F.struct(*R.ANALYSIS_CRITERIA))
    row = Z.analysis_verdict(Z.score_analyses(df)).first()
    assert (row["scores"]["total"], row["scores"]["overall"], row["verdict_rule"]) == (total, overall, rule)
    assert row["verdict_matches"] == (rule == "accept")


def test_score_kinds(spark):
    a, r = dict.fromkeys(V.METRICS["analysis"], 1.0), dict.fromkeys(V.METRICS["recommendation"], 2.0)
    df = spark.createDataFrame([("c", "v1", {**a, "total": 5.0}), ("c", "v2", r), ("c", "v3", {"clarity": 1.0})],
                               "cohort_id string, version string, scores map<string,double>")
    assert [k["k"] for k in df.select(V.score_type(F.col("scores")).alias("k")).collect()] == ["analysis", "recommendation", None]
    assert V.flatten_scores(df, "analysis").columns == ["cohort_id", "version", *V.METRICS["analysis"]]
    assert V.flatten_scores(df, "recommendation").count() == 1
    unknown = V.unknown_scores(df).collect()
    assert [r["version"] for r in unknown] == ["v3"] and "overall" in unknown[0]["missing_for_analysis"]
    with pytest.raises(Exception, match="no known kind"):
        V.flatten_scores(df, "analysis", strict=True).collect()
    assert V.flatten_scores(df.filter("version <> 'v3'"), "analysis", strict=True).count() == 1
    with pytest.raises(ValueError):
        V.metrics_of("other")
    with pytest.raises(ValueError, match="lack columns"):
        V.version_summary(df, "analysis")


def test_version_summary_and_matrix(spark):
    names = V.METRICS["analysis"]
    df = spark.createDataFrame(
        [("c", v, *[x] * len(names)) for v, x in (("run_2", 4.0), ("run_2", 5.0), ("run_1", 3.0), ("run_3", None))] + [("d", "run_1", *[1.0] * len(names))],
        "cohort_id string, version string, " + ", ".join(f"{n} double" for n in names))
    summary = V.version_summary(df, "analysis")
    assert [(r["cohort_id"], r["version"], r["overall"]) for r in V.sort_versions(summary).collect()] == [
        ("c", "run_1", 3.0), ("c", "run_2", 4.5), ("c", "run_3", None), ("d", "run_1", 1.0)]
    last = V.version_summary(df, "analysis", last_n=2)
    assert sorted((r["cohort_id"], r["version"]) for r in last.collect()) == [("c", "run_2"), ("c", "run_3"), ("d", "run_1")]
    matrix = V.metric_version_matrix(summary, "analysis").filter("cohort_id = 'c' AND metric = 'clarity'").first()
    assert (matrix["run_1"], matrix["run_2"], matrix["run_3"]) == (3.0, 4.5, None)
    stacked = V.union_runs([df.select("version", "clarity"), df.select("version", "accuracy")])
    assert stacked.count() == 10 and stacked.filter("clarity IS NULL").count() >= 5


def test_reply_joins(spark, rows):
    replies = spark.createDataFrame(
        [("a", "r", "analysis", 0, "old"), ("a", "r", "analysis", 2, "new"), ("b", "r", "recommendation", 0, "x"), ("c", "r", "analysis", 0, None)],
        "cohort_id string, run_id string, stage string, attempt int, raw string")
    cohorts = spark.createDataFrame([("a", "r"), ("b", "r"), ("c", "r")], "cohort_id string, run_id string")
    assert rows(R.attach_responses(cohorts, replies, "analysis", "reply"), "cohort_id", "reply") == [("a", "new"), ("b", None), ("c", None)]
    assert rows(R.pending(cohorts, replies, "analysis"), "cohort_id") == [("b",), ("c",)]
    assert rows(R.ready(cohorts, replies, "analysis"), "cohort_id") == [("a",)]


def test_evaluator_inputs(spark):
    schema = "cohort_id string, run_id string, raw string"
    target, domain = {"primary_goal": "Traffic"}, {"industry": "x"}
    reports = spark.createDataFrame([(k, "r", json.dumps(v)) for k, v in {
        "own": {"input_data": {"d": 1}, "analysis_response": {"s": 1}, "campaign_target": target, "business_domain": domain},
        "second": {"input_data": {}, "campaign_data": {"d": 2}, "analysis_response": {"s": 2}, "campaign_target": target},
        "saved": {"analysis": {"s": 3}}, "nothing": {"analysis": {"s": 4}}, "no_report": {"input_data": {"d": 5}}}.items()], schema)
    summaries = spark.createDataFrame([("saved", "r", json.dumps({"campaign_identity": {"industry": "Retail"}, "n": 1}))], schema)
    got = {r["cohort_id"]: r for r in analysis_evaluator_inputs(reports, summaries).collect()}
    assert set(got) == {"own", "second", "saved"}
    assert got["second"]["campaign_data"] == '{"d":2}' and got["second"]["business_domain"] is None
    assert json.loads(got["saved"]["campaign_target"]) == {"primary_goal": "Unknown"}
    assert json.loads(got["saved"]["business_domain"])["industry"] == "Retail"
    assert json.loads(got["saved"]["analysis_report"]) == {"analysis": {"s": 3}}
    files = spark.createDataFrame([("a", "r", '{"campaign_data":{"d":1}}')], schema)
    row = recommendation_evaluator_inputs(files).first()
    assert row["recommendations"] == "[]" and row["campaign_data"] == '{"d":1}'


# --- diagnostics ----------------------------------------------------------------------

def daily_ads(spark, *days):
    names = "cohort_id string, platform string, date string, impressions double, clicks double, spend double, conversions double, conversion_value double, reach double"
    return spark.createDataFrame([tuple(v if isinstance(v, str) else float(v) for v in d) for d in days], names)


def test_platform_comparison_uses_ratios_of_sums(spark):
    df = daily_ads(spark, ("c", "A", "2024-01-01", 100, 10, 10, 1, 20, 50), ("c", "A", "2024-01-02", 900, 10, 30, 1, 20, 50),
                   ("c", "B", "2024-01-01", 100, 1, 10, 1, 30, 50))
    by_roas = {r["platform"]: r for r in D.platform_comparison(df).collect()}
    assert by_roas["A"]["ctr"] == 0.02 and by_roas["A"]["roas"] == 1.0 and by_roas["A"]["platform_rank"] == 2
    by_cost = D.platform_comparison(df.withColumn("goal", F.lit("Brand Awareness")))
    assert {r["platform"]: r["platform_rank"] for r in by_cost.collect()} == {"A": 1, "B": 2}


def test_trends(spark):
    df = daily_ads(spark, ("c", "A", "2024-01-01", 1000, 100, 100, 5, 0, 1000), ("c", "A", "2024-01-02", 1000, 90, 180, 5, 0, 200),
                   ("c", "A", "2024-01-03", 1000, 100, 220, 5, 0, 200), ("c", "B", "2024-01-02", 1000, 1, 999, 0, 0, 0))
    trend = {r["date"].day: r for r in D.kpi_trend(df, ["cpc"]).filter("platform = 'A'").collect()}
    assert (trend[1]["cpc_change"], trend[2]["cpc_change"], trend[3]["cpc_change"]) == (None, 1.0, 0.2)
    assert [r["date"].day for r in D.rising_cpc(df).collect()] == [2]
    state = {(r["platform"], r["date"].day): (r["saturated"], r["fatigued"]) for r in D.saturation(df).collect()}
    assert state == {("A", 1): (False, False), ("A", 2): (True, True), ("A", 3): (True, False), ("B", 2): (False, False)}
    drift = {(r["platform"], r["date"].day): r["direction"] for r in D.cpm_drift(df, tolerance=50).collect()}
    assert drift == {("A", 1): "unknown", ("A", 2): "up", ("A", 3): "flat", ("B", 2): "unknown"}


def test_totals_do_not_depend_on_row_order(spark):
    values = [0.1, 0.2, 0.3, 1e9, -1e9 + 0.7] * 50
    df = spark.createDataFrame([("c", "A", float(v)) for v in values], "cohort_id string, platform string, spend double")
    forward = D.totals(df, ["cohort_id"]).first()["spend"]
    assert forward == D.totals(df.repartition(7, "spend"), ["cohort_id"]).first()["spend"]
    assert forward == pytest.approx(65.0)


def test_flags(spark):
    df = daily_ads(spark, *[("c", p, "2024-01-01", 1000, c, s, v, r, 10) for p, c, s, v, r in
                            (("A", 10, 1, 5, 1), ("B", 100, 50, 1, 500), ("C", 50, 50, 10, 20), ("D", 60, 60, 12, 0))])
    assert [r["platform"] for r in D.weak_traffic(df).collect()] == ["A"]
    assert [r["platform"] for r in D.clicks_without_conversions(df).collect()] == ["B"]
    assert [r["platform"] for r in D.scale_opportunities(df).collect()] == ["A"]
    assert {r["platform"] for r in D.scale_opportunities(df, target_cpa=5.0).collect()} == {"A", "C", "D"}
    assert {r["platform"] for r in D.below_break_even(df).collect()} == {"C"}


def test_unit_economics(spark):
    df = spark.createDataFrame([("c", "A", 90.0, 40.0, 10.0, 5, 20, 100.0, 4), ("c", "B", 300.0, 40.0, 40.0, 1, 20, 900.0, 4)],
                               "cohort_id string, platform string, lifetime_value double, cac double, monthly_gross_profit_per_customer double, "
                               "refunds int, orders int, conversion_value double, conversions int")
    assert [r["platform"] for r in D.low_ltv_to_cac(df).collect()] == ["A"]
    assert D.low_ltv_to_cac(df.drop("cac")).count() == 0
    assert {r["platform"]: r["payback_rank"] for r in D.payback_rank(df).collect()} == {"A": 1, "B": 2}
    leak = {r["platform"]: (r["high_refunds"], r["low_order_value"]) for r in D.value_leakage(df, segment="platform").collect()}
    assert leak == {"A": (True, True)}


def test_missing_info(spark):
    df = spark.createDataFrame([("c", 10, 100, 5.0), ("c", 0, 100, 5.0)], "cohort_id string, clicks int, impressions int, spend double")
    df = df.withColumn("goal", F.lit("Traffic"))
    got = {r["kpi"]: (r["n_missing"], r["absent"]) for r in D.missing_info(df).collect()}
    assert got == {"cpc": (1, False), "landing_page_views": (2, True), "bounce_proxy_rate": (2, True), "session_quality_score": (2, True)}
    gap = D.landing_page_gap(df).collect()
    assert all(r["bounce_proxy_rate"] is None and r["landing_views_missing"] for r in gap)


# --- quality ----------------------------------------------------------------------------

def test_figures_in_text(spark):
    text = "Spend of $4,803.43 gave 159 conversions (CTR 3.5%, was -2). Q4 and B2B and v1.2.3 aside; 1,2345."
    from admeter.functions import numbers_in
    found = spark.createDataFrame([(text,)], "t string").select(numbers_in(F.col("t")).alias("n")).first()["n"]
    assert [(n["figure"], n["value"], n["percent"]) for n in found][:4] == [
        ("$4,803.43", 4803.43, False), ("159", 159.0, False), ("3.5%", 3.5, True), ("-2", -2.0, False)]
    assert not any(n["figure"] in ("4", "2") for n in found)


def test_grounding(spark):
    values = spark.createDataFrame([("c", "roas", 1.8), ("c", "ctr", 0.04), ("c", "cvr", 0.08), ("d", "roas", 9.0)], "cohort_id string, metric string, value double")
    reports = spark.createDataFrame([(1, "c", "ROAS 1.80, CTR 4%, CVR 80%, other 9"), (2, "e", "ROAS 1.8")], "id int, cohort_id string, text string")
    got = {(r["id"], r["figure"]): (r["grounded"], r["misread_rate"]) for r in Q.check_figures(reports, values).collect()}
    assert got == {(1, "1.80"): (True, False), (1, "4%"): (True, False), (1, "80%"): (False, True), (1, "9"): (False, False), (2, "1.8"): (False, False)}
    assert Q.ungrounded_figures(reports, values).count() == 3


def test_metric_values(spark):
    df = spark.createDataFrame([("c", ({"ctr": 0.1, "x": None},)), ("c", ({"ctr": 0.1},))], "cohort_id string, summary struct<performance_metrics:map<string,double>>")
    assert Q.metric_values(df).collect() == [("c", "ctr", 0.1)]


def test_words(spark):
    texts = ["You should consider it; SHOULD we?", "Shoulder improvements", "été-should.", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert {r["i"]: r["n_banned"] for r in Q.banned_words(df).collect()} == {0: 3, 2: 1}
    assert Q.hedging(df).count() == 0
    accents = spark.createDataFrame([("écould could",)], "text string")
    assert Q.hedging(accents).first()["n_hedges"] == 1


def test_cards_and_insights(spark):
    cards = spark.createDataFrame(
        [("c", "Fix  CPC!", ["First, obtain x"], True, "Lower CPC"), ("c", "fix cpc", ["Do"], True, "More sales"), ("d", "Fix CPC", [], True, None),
         ("d", "Other", ["Do"], False, "landing_page_views up")],
        "cohort_id string, title string, what_you_should_do array<string>, depends_on_missing boolean, expected_impact string")
    assert Q.duplicate_cards(cards).collect() == [("c", "fix cpc", 2)]
    assert sorted(r["title"] for r in Q.missing_prerequisite(cards).collect()) == ["Fix CPC", "fix cpc"]
    assert sorted(r["title"] for r in Q.impact_without_metric(cards).collect()) == ["Fix CPC", "fix cpc"]
    insights = spark.createDataFrame([("CPC $1, ROAS 2",), ("ctr, CTR",), ("refund_rate and aov",), (None,)], "evidence string")
    assert sorted(r["n_metrics"] for r in Q.thin_insights(insights).collect()) == [0, 1]


def test_sections(spark):
    df = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate((ANALYSIS, changed(ANALYSIS, ("analysis", "channel_notes"), []),
                                                                       changed(ANALYSIS, ("analysis", "missing_info"))))], "i int, raw string")
    gaps = R.check_analyses(df).select("i", Q.section_gaps(F.col("reply.analysis")).alias("g")).orderBy("i").collect()
    assert [r["g"] for r in gaps] == [[], ["channel_notes"], ["missing_info"]]


def test_null_kpis_and_trends(spark):
    reports = spark.createDataFrame([("c", "MER reached 3.2 with roas 2"), ("c", "mer unknown. CTR 2"), ("d", "mer 1, a rising trend")], "cohort_id string, text string")
    gaps = spark.createDataFrame([("c", "mer", True), ("c", "roas", False), ("d", "ctr", True)], "cohort_id string, kpi string, absent boolean")
    found = Q.stated_null_kpis(reports, gaps, ["mer", "roas", "ctr"]).collect()
    assert [(r["text"][:11], r["stated_null_kpis"]) for r in found] == [("MER reached", ["mer"])]
    ads = spark.createDataFrame([("d", "2024-01-01"), ("d", "2024-01-01"), ("c", "2024-01-01"), ("c", "2024-01-02")], "cohort_id string, date string")
    assert [(r["cohort_id"], r["n_trend_words"]) for r in Q.trend_without_series(reports, ads).collect()] == [("d", 2)]


def test_reported_against_derived(spark):
    df = spark.createDataFrame([(1, 10, 100, "0.1", 2.0), (2, 10, 100, "0.2", None), (3, 10, 0, "0.1", None)],
                               "id int, clicks int, impressions int, reported_ctr string, reported_cpc double")
    got = Q.reported_vs_derived(df).select("id", "kpi", "reported", "derived").collect()
    assert sorted(map(tuple, got)) == [(2, "ctr", 0.2, 0.1), (3, "ctr", 0.1, None)]
    with pytest.raises(ValueError):
        Q.reported_vs_derived(df.drop("reported_ctr"))


@pytest.mark.parametrize("text, stated", [
    ("MER over the whole third quarter of the year reached 3.2", ["mer"]), ("MER fell while the refund rate was 4%", ["refund_rate"]),
    ("MER fell. Then 3 came", []), ("MER was 2; refund_rate over all of the channels we know of: 0.1", ["mer", "refund_rate"]), ("merry 3", []), ("", [])])
def test_figures_are_bound_to_the_nearest_kpi(spark, text, stated):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(Q.kpis_stated(F.col("t"), ["mer", "refund_rate"]).alias("s")).first()["s"] == stated
