import json

import pytest
from pyspark.sql import functions as F

from admeter.operators import cohorts as H, prompts as P, stages as X, summary as S
from admeter.plans import compare_runs, run_campaigns
from admeter.sinks import archive_prompts

# One ad row with known KPIs, and its cohort.
AD = dict(ordinal=0, index=1, date="2024-01-21 00:00:00", platform="Google Ads", industry="Fintech", primary_goal="Traffic",
          impressions=59886, clicks=2113, spend=2662.38, conversions=159, conversion_value=4803.43)


@pytest.fixture
def ads(spark):
    return spark.createDataFrame([tuple(AD.values())], list(AD))


def test_cohorts_by_index(spark, rows):
    df = spark.createDataFrame([(0, 2), (1, 2), (2, 1), (3, None), (4, 1)], "ordinal int, index int")
    kept, rejects = H.assign(df)
    assert rows(kept, "ordinal", "cohort_id") == [(0, "campaign_2"), (1, "campaign_2"), (2, "campaign_1"), (4, "campaign_1")]
    assert rows(rejects, "ordinal") == [(3,)]
    order = H.cohort_order(kept).orderBy("first_ordinal").collect()
    assert [(r["cohort_id"], r["n_rows"]) for r in order] == [("campaign_2", 2), ("campaign_1", 2)]


@pytest.mark.parametrize("n, size, labels", [
    (47, 6, ["batch_1_6", "batch_7_12", "batch_43_47"]), (4, 6, ["batch_1_4"]), (12, 6, ["batch_1_6", "batch_7_12"]), (3, 1, ["batch_3_3"])])
def test_batches(spark, n, size, labels):
    df = spark.range(n).select((F.col("id") * 7 % n).alias("ordinal")).distinct()
    out, rejects = H.assign(df, batch_size=size)
    got = {r["cohort_id"]: r["count"] for r in out.groupBy("cohort_id").count().collect()}
    assert rejects is None and sum(got.values()) == df.count() and set(labels) <= set(got)
    with pytest.raises(ValueError):
        H.by_batch(df, 0)


@pytest.mark.parametrize("slice_rows", [None, 10, 60, 300])
def test_positions_do_not_depend_on_the_slices(spark, slice_rows):
    # one cohort holds a third of the rows
    df = spark.range(3000).select(
        F.xxhash64("id").alias("ordinal"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("cohort_id"))
    got = H.positions(df, by=["cohort_id"], total="n", slice_rows=slice_rows).collect()
    by_cohort = {}
    for r in sorted(got, key=lambda r: r["ordinal"]):
        by_cohort.setdefault(r["cohort_id"], []).append((r["position"], r["n"]))
    assert all(places == [(i, len(places)) for i in range(len(places))] for places in by_cohort.values())
    assert sum(map(len, by_cohort.values())) == 3000
    whole = H.positions(df, total="n", slice_rows=slice_rows).orderBy("ordinal").collect()
    assert [(r["position"], r["n"]) for r in whole] == [(i, 3000) for i in range(3000)]


def test_a_large_cohort_is_spread_over_slices(spark):
    df = spark.range(4000).select(F.col("id").alias("ordinal"), (F.col("id") % 1).alias("cohort_id"))
    sliced = H._sort_slices(df, "ordinal", 16)
    assert sliced.groupBy("cohort_id", "_slice").count().agg(F.max("count")).first()[0] <= 4000 / 16 * 1.2
    plan = H.row_positions(df, slice_rows=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan and "_slice" not in H.row_positions(df)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("slice_rows", [None, 1])
def test_positions_for_dates_scan_ordinals_and_null_keys(spark, rows, slice_rows):
    df = spark.createDataFrame([("2024-01-03", "a"), ("2024-01-01", "a"), ("2024-01-02", None), ("2024-01-05", None), ("2024-01-04", "b")], "d string, k string")
    df = df.select(F.to_timestamp("d").alias("ordinal"), "k")
    want = [(1, "a", 0, 2), (2, None, 0, 2), (3, "a", 1, 2), (4, "b", 0, 1), (5, None, 1, 2)]
    day = F.dayofmonth("ordinal").alias("day")
    assert rows(H.positions(df, by=["k"], total="n", slice_rows=slice_rows), day, "k", "position", "n") == want
    days = df.withColumn("ordinal", F.to_date("ordinal"))
    assert rows(H.positions(days, slice_rows=slice_rows), day, "position") == [(i + 1, i) for i in range(5)]
    scan = df.withColumn("ordinal", F.struct(F.lit("f").alias("file"), (day % 2).alias("block"), day.alias("pos")))
    got = rows(H.positions(scan, by=["k"], slice_rows=slice_rows), "ordinal.pos", "position")
    assert got == [(1, 0), (2, 0), (3, 1), (4, 0), (5, 1)]


@pytest.mark.parametrize("kind", ["string", "timestamp_ntz", "date", "decimal(20,3)", "double", "boolean", "binary", "bigint", "timestamp", "struct<a:int,b:string>"])
def test_positions_of_every_ordinal_type_are_the_same_in_slices(spark, kind):
    texts = ["10", "9", "8", "100", None, "k10", "k9", "\u00e9", "", "10", None]
    days = ["2024-03-10 02:30:00", "2024-03-10 01:59:59.5", None, "1969-12-31 23:59:59", "2024-03-10 02:30:00.25", "2024-11-03 01:10:00", None]
    numbers = [3.5, -1.0, None, float("nan"), float("inf"), 0.0, float("-inf"), 1e12, None]
    values = {"string": texts, "binary": texts, "timestamp_ntz": days, "date": days, "timestamp": days, "double": numbers,
              "boolean": ["true", None, "false", "true"]}.get(kind, ["3", "-20", None, "100", "7", None])
    df = spark.createDataFrame([(i, "ab"[i % 2], None if v is None else str(v)) for i, v in enumerate(values)], "id int, k string, v string")
    value = F.struct(F.col("v").cast("int").alias("a"), F.col("v").alias("b")) if kind.startswith("struct") else F.col("v").try_cast(kind)
    df = df.select("id", "k", value.alias("ordinal"))
    for by in ([], ["k"]):
        plain, sliced = [
            sorted((r["k"] if by else "", r["position"], r["total"], str(r["ordinal"]))
                   for r in H.positions(df, by=by, total="total", slice_rows=n).collect()) for n in (None, 1)]
        assert plain == sliced


def test_offsets_of_input_splits_are_not_broadcast(spark):
    df = spark.range(100).select(F.struct(F.lit("f").alias("file"), (F.col("id") % 7).alias("block"), F.col("id").alias("pos")).alias("ordinal"))
    plan = H.positions(df, slice_rows=5)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


def test_first_row_context(spark):
    df = spark.createDataFrame(
        [("c", 5, "late", None), ("c", 2, "Traffic", None), ("d", 1, None, "x")], "cohort_id string, ordinal int, primary_goal string, industry string")
    got = {r["cohort_id"]: r for r in H.first_row_context(df).collect()}
    assert got["c"]["campaign_target"]["primary_goal"] == "Traffic"
    assert got["d"]["campaign_target"]["primary_goal"] == "Unknown"
    assert got["d"]["business_domain"].asDict() == {"industry": "x", "offering": "Unknown", "audience": "Unknown", "funnel_stage": "Unknown"}


def _summary(ads, goal="Traffic"):
    rows, _ = H.by_index(ads.withColumn("goal", F.lit(goal)))
    return S.row_summaries(rows)


def test_row_summary(ads):
    s = _summary(ads).first()["summary"]
    assert s["campaign_identity"].asDict() == dict(
        platform="Google Ads", campaign_name="Unknown", date="2024-01-21 00:00:00", industry="Fintech", offering="Unknown",
        audience="Unknown", funnel_stage="Unknown", primary_goal="Traffic")
    assert s["performance_metrics"] == dict(
        spend=2662.38, revenue=4803.43, impressions=59886.0, clicks=2113.0, conversions=159.0, roas=1.8, cpa=16.74, cvr=0.08, ctr=0.04,
        cpc=1.26, cpm=40.0)


def test_base_metrics_keep_nulls_and_goal_kpis_do_not(spark, ads):
    empty = ads.withColumns({"clicks": F.lit(0), "spend": F.lit(None).cast("double")})
    m = _summary(empty).first()["summary"]["performance_metrics"]
    assert m["spend"] is None and m["cvr"] is None and m["roas"] is None and m["ctr"] == 0.0
    assert "cpc" not in m and "cpm" not in m
    sales = _summary(ads, "Increase Sales").first()["summary"]["performance_metrics"]
    assert sales["revenue"] == 4803.43 and sales["aov"] == 30.21 and "purchases" not in sales
    assert set(_summary(ads, "?").first()["summary"]["performance_metrics"]) == {
        "spend", "revenue", "impressions", "clicks", "conversions", "roas", "cpa", "cvr", "ctr"}


def test_existing_kpi_column_wins_in_base_metrics(ads):
    m = _summary(ads.withColumn("roas", F.lit(7.0))).first()["summary"]["performance_metrics"]
    assert m["roas"] == 7.0
    m = _summary(ads.withColumn("roas", F.lit(7.0)), "Increase Sales").first()["summary"]["performance_metrics"]
    assert m["roas"] == 1.8  # goal KPIs are always computed anew


def test_payload_parts_hold_the_whole_cohort(spark):
    df = spark.range(25).select(
        F.col("id").alias("ordinal"), F.when(F.col("id") < 20, "big").otherwise("small").alias("cohort_id"),
        F.col("id").cast("string").alias("campaign_name"), F.lit("Traffic").alias("goal"))
    parts = S.cohort_payloads(S.row_summaries(df), rows_per_part=8).orderBy("cohort_id", "part").collect()
    assert [(p["cohort_id"], p["part"], p["n_parts"], p["n_rows"], len(p["payload"])) for p in parts] == [
        ("big", 0, 3, 20, 8), ("big", 1, 3, 20, 8), ("big", 2, 3, 20, 4), ("small", 0, 1, 5, 5)]
    names = [s["campaign_identity"]["campaign_name"] for p in parts for s in p["payload"]]
    assert names == [str(i) for i in range(25)]


def _prompt_inputs(spark, ads):
    rows, _ = H.by_index(ads)
    context = H.first_row_context(rows)
    return S.cohort_payloads(S.row_summaries(H.with_goal(rows, context))), context


def test_analysis_prompt(spark, ads):
    payloads, context = _prompt_inputs(spark, ads)
    row = P.analysis_prompts(payloads, context, P.default_templates(spark)).first()
    system, user = row["messages"]
    assert system["role"] == "system" and P.DEFAULT_TEMPLATES["goal/traffic"] in system["content"]
    assert user["role"] == "user" and '"spend":2662.38' in user["content"] and "{{" not in user["content"]
    assert row["unresolved"] == [] and row["prompt_name"] == "analysis_prompt"


def test_placeholder_in_data_is_caught(spark, ads):
    payloads, context = _prompt_inputs(spark, ads.withColumn("platform", F.lit("{{CAMPAIGN_DATA}}")))
    strict = P.analysis_prompts(payloads, context, P.default_templates(spark)).first()
    assert strict["unresolved"] == ["{{CAMPAIGN_DATA}}"] and strict["messages"] is None
    loose = P.analysis_prompts(payloads, context, P.default_templates(spark), strict=False).first()
    assert loose["messages"] is not None


def test_recommendation_prompt_needs_an_analysis(spark, ads):
    payloads, context = _prompt_inputs(spark, ads)
    templates = P.default_templates(spark)
    none = spark.createDataFrame([("campaign_1", None)], "cohort_id string, analysis string")
    assert P.recommendation_prompts(payloads, context, none, templates).count() == 0
    some = spark.createDataFrame([("campaign_1", '{"k":"v"}')], "cohort_id string, analysis string")
    assert '{"k":"v"}' in P.recommendation_prompts(payloads, context, some, templates).first()["messages"][1]["content"]


def test_evaluation_prompts(spark, ads):
    payloads, context = _prompt_inputs(spark, ads)
    templates = P.default_templates(spark)
    inputs = payloads.join(context, "cohort_id").withColumn("analysis_report", F.lit('{"a":1}'))
    row = P.analysis_evaluation_prompts(inputs, templates).first()
    assert "Goal: Traffic" in row["messages"][1]["content"] and "KPIs: clicks, conversions, cpa" in row["messages"][1]["content"]
    bare = inputs.withColumn("campaign_target", F.lit(None).cast("string"))
    row = P.analysis_evaluation_prompts(bare, templates).first()
    assert row["messages"] is None and "no campaign_target" in row["violations"]
    text = inputs.select("cohort_id", F.to_json("payload").alias("campaign_data"), "campaign_target", "business_domain", "analysis_report")
    assert P.analysis_evaluation_prompts(text, templates).first()["violations"] == []
    cards = text.withColumns({"analysis_context": F.lit("{}"), "recommendations": F.lit("[1,2]")})
    assert "Cards:\n[1,2]" in P.recommendation_evaluation_prompts(cards, templates).first()["messages"][1]["content"]


def test_prompt_archive(spark):
    df = spark.createDataFrame([("c", "r", "p", i, [("system", "one"), (None, "two")]) for i in (2, 1)],
                               "cohort_id string, run_id string, prompt_name string, part int, messages array<struct<role:string,content:string>>")
    out = archive_prompts(df).withColumn("text", P.archive_text(F.col("messages"))).orderBy("part").collect()
    assert [r["attempt"] for r in out] == [0, 1]
    line = "=" * 20
    assert out[0]["text"] == f"{line} SYSTEM MESSAGE {line}\none\n\n{line} UNKNOWN MESSAGE {line}\ntwo\n\n{'=' * 57}\n"


def test_missing_template(spark):
    with pytest.raises(FileNotFoundError, match="analysis/user"):
        P.template_texts(P.default_templates(spark).filter("name <> 'analysis/user'"), ["analysis/system", "analysis/user"])


def test_model_errors_stay_in_their_row(spark):
    df = spark.range(4).select(F.col("id").cast("string").alias("cohort_id"), F.lit("r").alias("run_id"), F.array(
        F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages"))

    def model(messages):
        if messages[0]["content"] == "2":
            raise ValueError("no")
        return "ok " + messages[0]["content"]

    out = {r["cohort_id"]: (r["raw"], r["error"]) for r in X.call_model(df, model, stage="analysis", max_parallel=2).collect()}
    assert out["1"] == ("ok 1", None) and out["2"] == (None, "analysis: ValueError: no") and len(out) == 4


def test_error_columns(spark):
    df = X.guarded(spark.range(2), F.when(F.col("id") == 0, F.lit("x")), "v", "v is missing")
    df = X.add_error(df, F.lit(True), "always")
    assert [r["errors"] for r in df.orderBy("id").collect()] == [["always"], ["v is missing", "always"]]


def test_whole_flow(spark, tmp_path):
    lines = ["index,Day,Platform,Campaign Type,Impr,Clicks,Cost,Results,Revenue,primary_goal"]
    lines += [f"{i // 3 + 1},1/{i + 1}/2024,P{i % 2},Search,{100 * (i + 1)},{10 * (i + 1)},{5.5 * (i + 1)},{i},{9 * i},Traffic" for i in range(6)]
    lines += [lines[-1].replace(",5,", ",7,"), ",1/9/2024,P1,Search,1,1,1,1,1,Traffic"]
    (tmp_path / "ads.csv").write_text("\n".join(lines) + "\n")

    # models are local functions, so that workers need no test module
    def analyse(_):
        item = {"insight": "i", "evidence": "e", "business_impact": "b"}
        return json.dumps({"analysis": {
            "executive_summary": "Mixed results overall", "budget_and_efficiency": [item], "results_and_value": [item],
            "cross_channel_patterns_and_risks": [], "channel_notes": [
                {"platform": "P", "what_we_see": ["a"], "what_it_likely_means": ["b"], "risks_or_watchouts": ["c"]}]}})

    card = {"title": "T", "whats_happening": "w", "what_you_should_do": ["a"], "why_this_matters": "y", "priority": "High",
            "expected_impact": "CPC", "owner_suggestion": "o"}

    def recommend(messages):
        assert "executive_summary" in messages[1]["content"]
        if '"date":"2024-01-01' in messages[1]["content"]:
            raise RuntimeError("down")
        return json.dumps({"recommendations": [card] * 4})

    def score(_):
        body = {f"{c}_{k}": v for c in ("clarity", "accuracy", "hallucination", "structure", "kpi_alignment")
                for k, v in (("score", 4), ("reasoning", "r"))}
        return json.dumps({"evaluation": {**body, "total_score": 99, "verdict": "accept", "key_issues": [], "improvement_suggestions": []}})

    def score_cards(_):
        names = ("structure", "feasibility", "Recommendation_Count", "Analysis_Grounding", "Action_Step_Completeness", "Priority_Alignment",
                 "Tone_&_Audience_Compliance", "Expected_Impact_Quality", "instruction_adherence")
        body = {f"{c}_{k}": v for c in names for k, v in (("score", 3), ("reasoning", "r"))}
        return json.dumps({"evaluation": {**body, "verdict": "accept", "key_issues": [], "improvement_suggestions": []}})

    out = run_campaigns(spark, str(tmp_path / "ads.csv"), str(tmp_path / "out"), "run_20260101_000000",
                        analysis_model=analyse, recommendation_model=recommend, evaluation_models=(score, score_cards))
    assert out["rejects"].count() == 1
    assert {(r["cohort_id"], r["n_rows"]) for r in out["payloads"].collect()} == {("campaign_1", 3), ("campaign_2", 3)}
    assert out["summaries"].filter("conversions = 7").count() == 1  # the last copy of the repeated row
    assert [r["valid"] for r in out["analyses"].collect()] == [True, True]
    cards = {r["cohort_id"]: (r["valid"], r["error"]) for r in out["recommendations"].collect()}
    assert cards == {"campaign_1": (False, "recommendation: RuntimeError: down"), "campaign_2": (True, None)}
    scores = out["analysis_evaluations"].collect()
    assert {(r["scores"]["total"], r["scores"]["overall"], r["verdict_rule"], r["valid"]) for r in scores} == {(20, 4.0, "accept", True)}
    scored = out["recommendation_evaluations"].collect()
    assert [(r["cohort_id"], r["scores"]["Overall"], r["verdict_rule"]) for r in scored] == [("campaign_2", 3.0, "accept")]
    archived = spark.read.parquet(str(tmp_path / "out" / "prompts"))
    assert archived.groupBy("prompt_name").count().count() == 4  # both evaluations' prompts are archived too
    base = str(tmp_path / "out")
    for name, n in (("analyses", 2), ("recommendations", 2), ("analysis_evaluations", 2), ("recommendation_evaluations", 1)):
        assert spark.read.parquet(f"{base}/{name}").count() == n
    summary = compare_runs(spark, base, "analysis", last_n=2, output=f"{base}/summaries/analysis").collect()
    assert [(r["cohort_id"], r["version"], r["overall"]) for r in summary] == [
        (c, "run_20260101_000000", 4.0) for c in ("campaign_1", "campaign_2")]
    assert spark.read.option("header", True).csv(f"{base}/summaries/analysis").count() == 2
    assert [r["Overall"] for r in compare_runs(spark, base, "recommendation").collect()] == [3.0]


def test_flow_on_clean_input_run_twice_with_useless_replies(spark, tmp_path):
    # no row lacks its index, no reply is valid, and the same run is repeated
    text = "index,date,platform,campaign_type,impressions,clicks,spend\n" + "".join(f"{i % 2},2024-01-0{i},A,S,10,1,1\n" for i in range(1, 7))
    (tmp_path / "ads.csv").write_text(text)
    base = str(tmp_path / "out")
    sizes = []
    for _ in range(2):
        out = run_campaigns(spark, str(tmp_path / "ads.csv"), base, "run_1", analysis_model=lambda m: "{}", recommendation_model=lambda m: "{}",
                            evaluation_models=(lambda m: "{}", lambda m: "{}"))
        sizes.append({name: table.count() for name, table in out.items()})
    assert sizes[0] == sizes[1] == dict(
        rejects=0, context=2, summaries=6, payloads=2, analysis_prompts=2, analyses=2, recommendation_prompts=0, recommendations=0,
        analysis_evaluations=0, recommendation_evaluations=0)
    assert spark.read.parquet(f"{base}/prompts").count() == 2
    with pytest.raises(FileNotFoundError):
        compare_runs(spark, base, "analysis")


def test_flow_without_index_uses_batches(spark, tmp_path):
    text = "date,platform,campaign_type,impressions,clicks,spend\n" + "".join(f"2024-01-0{i},A,S,10,1,1\n" for i in range(1, 8))
    (tmp_path / "ads.csv").write_text(text)
    out = run_campaigns(spark, str(tmp_path / "ads.csv"), str(tmp_path / "out"), "run_1", row_limit=5, batch_size=3)
    assert {r["cohort_id"] for r in out["payloads"].collect()} == {"batch_1_3", "batch_4_5"}
    (tmp_path / "none.csv").write_text("date,platform,campaign_type,impressions,clicks,spend\n")
    with pytest.raises(ValueError):
        run_campaigns(spark, str(tmp_path / "none.csv"), str(tmp_path / "out2"), "run_1")


def test_requests(spark):
    from admeter.plans import analysis_requests, recommendation_requests, request_payloads

    data = {k: v for k, v in AD.items() if k not in ("ordinal", "index")} | {"purchases": 12, "landing_page_views": "100"}
    target = json.dumps({"primary_goal": "Increase Sales"})
    df = spark.createDataFrame(
        [("a", json.dumps(data), '{"industry":"x"}', target, None), ("b", json.dumps({**data, "revenue": 1.5}), None, target, '{"given":1}'),
         ("c", json.dumps({"clicks": 3}), None, None, None)],
        "request_id string, campaign_data string, business_domain string, campaign_target string, analysis_results string")
    metrics = {r["cohort_id"]: r["payload"][0]["performance_metrics"] for r in request_payloads(df).collect()}
    assert metrics["a"]["purchases"] == 12.0 and metrics["a"]["revenue"] == 4803.43 and metrics["a"]["roas"] == 1.8
    assert metrics["b"]["revenue"] == 1.5
    assert metrics["c"]["clicks"] == 3.0 and metrics["c"]["spend"] is None and "purchases" not in metrics["c"]
    templates = P.default_templates(spark)
    asked = {r["cohort_id"]: r["messages"] for r in analysis_requests(df, templates).collect()}
    assert set(asked) == {"a", "c"} and P.DEFAULT_TEMPLATES["goal/increase_sales"] in asked["a"][0]["content"]
    generated = spark.createDataFrame([("a", '{"made":1}'), ("b", '{"made":2}')], "cohort_id string, generated_analysis string")
    ready = {r["cohort_id"]: r["messages"][1]["content"] for r in recommendation_requests(df, generated, templates).collect()}
    assert set(ready) == {"a", "b"} and '{"made":1}' in ready["a"] and '{"given":1}' in ready["b"]


def test_large_limits_are_numbered_in_slices(spark, rows, monkeypatch):
    from admeter.operators import clean

    monkeypatch.setattr(clean, "TOP_K_ROWS", 5)
    df = spark.range(50).select((49 - F.col("id")).alias("ordinal"))
    assert rows(clean.first_rows(df, 20)) == sorted([(i,) for i in range(20)], key=lambda t: str(t[0]))
