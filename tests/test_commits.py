"""Runs that are replaced as a whole, appended once, and accounted for cohort by cohort."""

import json

import pytest
from pyspark.sql import functions as F

from admeter.operators import ledger
from admeter.plans import compare_runs, run_campaigns
from admeter.sinks import Attempt, append_prompts, append_scores, archive_prompts, high_water, read_committed
from admeter.streaming import append_score_stream

HEAD = "index,date,platform,campaign_type,impressions,clicks,spend\n"


def tables_of(spark, base, run=None):
    names = ("_audit/ingested", "_audit/processed", "_audit/rejects", "context", "enriched_rows", "enriched_summary", "analysis_messages",
             "prompts", "analyses", "ledger")
    out = {}
    for name in names:
        df = read_committed(spark, base, name, run)
        out[name] = None if df is None else sorted(str(r.asDict(True)) for r in df.collect())
    return out


def make_reply():
    """A local function, so that workers need no test module."""
    def reply(_):
        item = {"insight": "i", "evidence": "e", "business_impact": "b"}
        note = {"platform": "P", "what_we_see": ["a"], "what_it_likely_means": ["b"], "risks_or_watchouts": ["c"]}
        return json.dumps({"analysis": {"executive_summary": "Mixed results overall", "budget_and_efficiency": [item], "results_and_value": [item],
                                        "cross_channel_patterns_and_risks": [], "channel_notes": [note]}})

    return reply


reply = make_reply()


@pytest.fixture
def files(tmp_path):
    (tmp_path / "many.csv").write_text(HEAD + "".join(f"{i % 3},2024-01-0{i},A,S,10,1,1\n" for i in range(1, 7)) + ",2024-01-08,A,S,1,1,1\n,2024-01-09,A,S,1,1,1\n")
    (tmp_path / "one.csv").write_text(HEAD + "7,2024-01-01,A,S,10,1,1\n")
    return tmp_path


def test_a_repeated_run_is_replaced_as_a_whole(spark, files):
    base, fresh = str(files / "out"), str(files / "fresh")
    run_campaigns(spark, str(files / "many.csv"), base, "run_1", analysis_model=reply)
    run_campaigns(spark, str(files / "many.csv"), base, "run_0", analysis_model=reply)
    before = tables_of(spark, base, "run_0")
    assert len(before["_audit/rejects"]) == 2 and len(before["ledger"]) == 3
    run_campaigns(spark, str(files / "one.csv"), base, "run_1", analysis_model=reply)
    run_campaigns(spark, str(files / "one.csv"), fresh, "run_1", analysis_model=reply)
    again, wanted = tables_of(spark, base, "run_1"), tables_of(spark, fresh, "run_1")
    same = lambda rows: [r.replace(base, "").replace(fresh, "") for r in rows or []]
    assert {k: same(v) for k, v in again.items()} == {k: same(v) for k, v in wanted.items()}
    assert tables_of(spark, base, "run_0") == before  # other runs stay
    assert len(spark.read.parquet(f"{base}/analyses").select("run_id", "attempt").distinct().collect()) == 2  # replaced files are gone


def test_a_run_that_breaks_off_changes_nothing(spark, files, monkeypatch):
    base = str(files / "out")
    run_campaigns(spark, str(files / "one.csv"), base, "run_1", analysis_model=reply)
    before = tables_of(spark, base)
    from admeter.plans import campaigns

    def broken(*_, **__):
        raise RuntimeError("the driver died")

    monkeypatch.setattr(campaigns.responses, "check_analyses", broken)
    for source, run in (("many.csv", "run_1"), ("many.csv", "run_2")):
        with pytest.raises(RuntimeError):
            run_campaigns(spark, str(files / source), base, run, analysis_model=reply)
    assert tables_of(spark, base) == before and read_committed(spark, base, "context", "run_2") is None
    monkeypatch.undo()
    run_campaigns(spark, str(files / "many.csv"), base, "run_1", analysis_model=reply)
    assert len(tables_of(spark, base)["ledger"]) == 3


def test_tables_without_rows_and_unknown_tables(spark, tmp_path):
    base = str(tmp_path)
    attempt = Attempt(spark, base, "run_1")
    written = attempt.write(spark.createDataFrame([], "cohort_id string, v int"), "empty")
    assert written.columns == ["cohort_id", "v", "run_id"] and written.count() == 0
    assert read_committed(spark, base, "empty") is None
    attempt.commit()
    assert read_committed(spark, base, "empty").count() == 0 and read_committed(spark, base, "other") is None


def test_scores_are_appended_once(spark, tmp_path):
    first = spark.createDataFrame([("a", "run_1", 1.0), ("a", "run_1", 2.0), (None, "run_1", 3.0)], "cohort_id string, version string, clarity double")
    second = spark.createDataFrame([("a", "run_2", 4.0), ("a", "run_1", 1.0)], first.schema)
    for format in ("csv", "parquet"):
        path = str(tmp_path / format)
        for batch in (first, first, second, first, second):
            append_scores(batch, path, format, keys=("cohort_id", "version"))
        reader = spark.read.schema(first.schema).option("header", True).format(format)
        assert sorted(map(str, reader.load(path).collect())) == sorted(map(str, [*first.collect(), second.collect()[0]]))


def test_a_stream_that_starts_over_adds_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "cohort_id string, version string, clarity double"
    spark.createDataFrame([("a", "run_1", 1.0), ("b", "run_1", 2.0)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).json(str(tmp_path / "in"))
    for checkpoint in ("one", "one", "another"):
        append_score_stream(stream(), str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_prompt_numbers_go_on(spark, tmp_path):
    def asked(n, cohort="a", run="run_1"):
        return spark.createDataFrame([(cohort, run, "p", i, f"t{i}") for i in range(n)], "cohort_id string, run_id string, prompt_name string, part int, text string")

    path = str(tmp_path / "archive")
    for n in (3, 2, 4):
        append_prompts(asked(n), path)
    append_prompts(asked(2, "b").unionByName(asked(1)), path)
    numbers = lambda cohort: sorted(r["attempt"] for r in spark.read.parquet(path).filter(F.col("cohort_id") == cohort).collect())
    assert numbers("a") == list(range(10)) and numbers("b") == [0, 1]
    marks = high_water(archive_prompts(asked(3)), archive_prompts(asked(5)))
    assert [(r["cohort_id"], r["next"]) for r in marks.collect()] == [("a", 5)]
    assert sorted(r["attempt"] for r in archive_prompts(asked(2), marks=marks).collect()) == [5, 6]


def test_ledger_has_every_cohort_once(spark, monkeypatch):
    monkeypatch.setattr(ledger, "MESSAGES", 2)
    cohorts = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), ("d",)], "cohort_id string")
    schema = "cohort_id string, valid boolean, violations array<string>, error string"
    analyses = spark.createDataFrame(
        [("a", True, [], None), ("a", False, ["x"], None), ("a", False, ["x"], None), ("b", False, [], "analysis: down"), ("c", True, [], None), ("e", True, [], None)], schema)
    cards = spark.createDataFrame([("a", False, ["p", "q"], None), ("a", False, ["r"], None), ("a", False, ["s"], None), ("c", True, [], None)], schema).drop("error")
    got = {r["cohort_id"]: (r["last_stage"], r["complete"], r["errors"]) for r in ledger.outcome_ledger(cohorts, {"analysis": analyses, "cards": cards}).collect()}
    assert got == {
        "a": ("analysis", False, ["analysis: x (2 rows)", "cards: p; q", "cards: r", "cards: 1 more kinds"]),
        "b": ("none", False, ["analysis: analysis: down", "cards: not reached"]),
        "c": ("cards", True, []), "d": ("none", False, ["analysis: not reached", "cards: not reached"]),
        "e": ("analysis", False, ["cards: not reached"])}
    assert ledger.outcome_ledger(cohorts, {}).count() == 4


def test_ledger_of_a_run(spark, files):
    answer = reply

    def mostly(messages):
        if '"2024-01-01' in messages[1]["content"]:
            raise RuntimeError("down")
        return answer(messages)

    base = str(files / "out")
    run_campaigns(spark, str(files / "many.csv"), base, "run_1", analysis_model=mostly)
    got = {r["cohort_id"]: (r["last_stage"], r["complete"], r["errors"]) for r in read_committed(spark, base, "ledger").collect()}
    assert set(got) == {"campaign_0", "campaign_1", "campaign_2"}
    assert got["campaign_1"] == ("none", False, ["analysis: analysis: RuntimeError: down"]) and got["campaign_2"] == ("analysis", True, [])
    with pytest.raises(FileNotFoundError):
        compare_runs(spark, base, "analysis")


def test_a_cohort_of_many_parts_ends_in_one_analysis_and_four_cards(spark, tmp_path):
    lines = [f"1,2024-01-{i % 28 + 1:02d},P{i % 3},S{i},{10 + i},{i % 7},{i % 5}" for i in range(1001)] + ["2,2024-01-01,P0,S,10,1,1"]
    (tmp_path / "ads.csv").write_text("index,date,platform,campaign_type,impressions,clicks,spend\n" + "\n".join(lines) + "\n")

    def make(text):
        def analyse(messages):
            parts = messages[1]["content"].count("executive_summary")
            return text.replace("Mixed results overall", f"Made of {parts} analyses")

        return analyse

    card = {"title": "T", "whats_happening": "w", "what_you_should_do": ["a"], "why_this_matters": "y", "priority": "High", "expected_impact": "CPC", "owner_suggestion": "o"}
    cards = json.dumps({"recommendations": [card] * 4})
    base = str(tmp_path / "out")
    out = run_campaigns(spark, str(tmp_path / "ads.csv"), base, "run_1", rows_per_part=200, merge_fan_in=2, analysis_model=make(reply(None)),
                        recommendation_model=lambda m: cards, remove_duplicates=False)
    assert {(r["cohort_id"], r["part"]) for r in out["analyses"].collect()} == {("campaign_1", p) for p in range(6)} | {("campaign_2", 0)}
    merged = {r["cohort_id"]: json.loads(r["analysis"])["executive_summary"] for r in read_committed(spark, base, "merged_analyses").collect()}
    assert merged == {"campaign_1": "Made of 2 analyses", "campaign_2": "Made of 0 analyses"}
    made = out["recommendations"].collect()
    assert sorted((r["cohort_id"], r["part"], len(r["reply"]["recommendations"])) for r in made) == [("campaign_1", 0, 4), ("campaign_2", 0, 4)]
    subjects = {r["cohort_id"]: r["payload"] for r in read_committed(spark, base, "card_subjects").collect()}
    whole = {p["campaign_identity"]["platform"]: p["performance_metrics"] for p in subjects["campaign_1"]}
    assert set(whole) == {"P0", "P1", "P2"} and sum(m["impressions"] for m in whole.values()) == sum(10 + i for i in range(1001))
    levels = [read_committed(spark, base, f"analysis_level_{n}").count() for n in (1, 2, 3)]
    assert levels == [3, 2, 1] and read_committed(spark, base, "analysis_level_4") is None
