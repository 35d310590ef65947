import json

import pytest

from admeter.operators.compare import flatten_scores, version_summary
from admeter.operators.prompts import load_templates, template_texts
from admeter.plans import compare_runs
from admeter.schema import canonicalize
from admeter.sinks import append_scores, stamp_run, write_dated_json, write_results, write_run_table
from admeter.sources import evaluation_records, load, read, read_result_text
from admeter.streaming import append_score_stream, score_stream


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "ads.csv"
    path.write_text(" col1 ,col2,Cost\na,,1\nb,,2\n")
    return path


def test_csv_is_text_with_an_ordinal(spark, csv_file):
    df = load(spark, csv_file)
    assert df.columns == ["col1", "Cost", "ordinal"]
    assert [r["col1"] for r in df.orderBy("ordinal").collect()] == ["a", "b"]
    assert dict(df.dtypes)["Cost"] == "string"


def test_cleanup_can_be_switched_off(spark, csv_file):
    df = load(spark, csv_file, strip_column_whitespace=False, drop_all_null_columns=False, with_ordinal=False)
    assert df.columns == [" col1 ", "col2", "Cost"]


def test_reader_options(spark, tmp_path):
    path = tmp_path / "semi.csv"
    path.write_text("a;b\n1;2\n")
    assert load(spark, path, options={"sep": ";"}).drop("ordinal").columns == ["a", "b"]


def test_json_and_parquet(spark, tmp_path):
    (tmp_path / "ads.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]))
    assert load(spark, tmp_path / "ads.json").select("a", "b").collect() == [(1, "x"), (2, None)]
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert load(spark, tmp_path / "t.parquet").drop("ordinal").count() == 3
    assert read(spark, str(tmp_path / "t.parquet") + "/*", format="parquet").count() == 3


def test_dataframe_passes_through(spark):
    df = spark.range(2)
    assert read(spark, df) is df


def test_bad_sources(spark, tmp_path):
    with pytest.raises(ValueError, match="cannot read '.xlsx'"):
        load(spark, tmp_path / "a.xlsx")
    with pytest.raises(FileNotFoundError):
        load(spark, tmp_path / "missing.csv")


def test_paths_of_several_formats(spark):
    with pytest.raises(ValueError, match="several formats"):
        load(spark, ["a.csv", "b.parquet"])


def test_order_follows_files_and_rows(spark, tmp_path):
    for name, lines in (("b", range(5, 9)), ("a", range(5))):
        (tmp_path / f"{name}.csv").write_text("v\n" + "\n".join(map(str, lines)) + "\n")
    df = read(spark, [tmp_path / "b.csv", tmp_path / "a.csv"])
    assert [int(r["v"]) for r in df.orderBy("ordinal").collect()] == list(range(9))


def _evaluation(value, keys=("clarity", "accuracy", "hallucination", "structure", "kpi_alignment")):
    return {"scores": {**{k: value for k in keys}, "total": 5 * value, "overall": float(value)},
            "verdict": "accept", "key_issues": [], "improvement_suggestions": ["x"]}


@pytest.fixture
def run_tree(tmp_path):
    def put(cohort, run, payload, name="analysis_evaluation_results.json"):
        folder = tmp_path / cohort / run / "results"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(json.dumps(payload, indent=2))

    put("campaign_1", "run_20260101_000000", _evaluation(2))
    put("campaign_1", "run_20260102_000000", _evaluation(4))
    put("campaign_1", "run_20260103_000000", {"other": 1}, "enriched_summary.json")
    put("campaign_2", "run_20260101_000000", [_evaluation(3), _evaluation(5)])
    put("campaign_2", "run_20260102_000000", {"records": [_evaluation(1), _evaluation(2)]})
    put("_global", "run_20260102_000000", _evaluation(5))
    return tmp_path


def test_run_tree_summary(spark, run_tree):
    out = compare_runs(spark, str(run_tree), "analysis").collect()
    assert [(r["cohort_id"], r["version"][4:12], r["clarity"], r["overall"]) for r in out] == [
        ("campaign_1", "20260101", 2.0, 2.0), ("campaign_1", "20260102", 4.0, 4.0),
        ("campaign_2", "20260101", 4.0, 4.0), ("campaign_2", "20260102", 1.5, 1.5)]


def test_last_n_counts_unscored_runs(spark, run_tree):
    out = compare_runs(spark, str(run_tree), "analysis", last_n=1).collect()
    assert [(r["cohort_id"], r["clarity"]) for r in out] == [("campaign_2", 1.5)]
    with pytest.raises(ValueError, match="at least 1"):
        compare_runs(spark, str(run_tree), "analysis", last_n=0)


def test_results_are_listed_without_being_read(spark, run_tree):
    from admeter.sources.runs import list_results

    listed = list_results(spark, str(run_tree))
    read_text = read_result_text(spark, str(run_tree)).select(*listed.columns)
    assert sorted(listed.collect()) == sorted(read_text.collect()) and listed.count() == 5


def test_missing_run_tree(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_result_text(spark, str(tmp_path / "nothing"))


def test_cards_scored_one_by_one(spark):
    text = json.dumps([{"card_title": "A", "evaluation": {"scores": {"clarity": 3, "overall": 2.5}, "verdict": "accept"}}])
    df = spark.createDataFrame([("campaign_1", "run_1", text)], "cohort_id string, run_id string, raw string")
    assert evaluation_records(df).collect() == [("campaign_1", "run_1", "A", {"clarity": 3.0, "overall": 2.5}, "accept")]


def test_score_stream_appends_each_file_once(spark, run_tree, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def drain():
        scores = score_stream(spark, str(run_tree), "analysis_evaluation_results.json", "analysis")
        append_score_stream(scores, out, state).awaitTermination()
        return spark.read.parquet(out)

    assert drain().count() == 6
    folder = run_tree / "campaign_3" / "run_20260105_000000" / "results"
    folder.mkdir(parents=True)
    (folder / "analysis_evaluation_results.json").write_text(json.dumps(_evaluation(4)))
    table = drain()
    assert table.count() == 7
    batch = flatten_scores(evaluation_records(read_result_text(spark, str(run_tree), "analysis_evaluation_results.json")), "analysis")
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, batch.collect()))
    assert version_summary(table, "analysis").count() == 5


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("campaign_1", 1, [1, 2]), ("campaign_2", 2, [3])], "cohort_id string, v int, xs array<int>")
    stamped = stamp_run(df, "run_20260101_000000")
    for format in ("parquet", "json"):
        write_results(stamped, str(tmp_path), format, format=format)
        back = spark.read.format(format).load(str(tmp_path / format))
        assert sorted((r["cohort_id"], r["run_id"], r["v"], tuple(r["xs"])) for r in back.collect()) == [
            ("campaign_1", "run_20260101_000000", 1, (1, 2)), ("campaign_2", "run_20260101_000000", 2, (3,))]
    write_run_table(stamped, str(tmp_path / "csv"), format="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).filter("xs = '[1,2]'").count() == 1
    for _ in range(2):
        append_scores(df.select("cohort_id", "v"), str(tmp_path / "scores"))
    assert spark.read.option("header", True).csv(str(tmp_path / "scores")).count() == 4
    write_dated_json(df, str(tmp_path / "dated"), "2026-01-02")
    assert (tmp_path / "dated" / "run_date=2026-01-02").is_dir()
    with pytest.raises(ValueError):
        write_run_table(df, str(tmp_path / "x"), format="xlsx")


def test_templates_from_files(spark, tmp_path):
    (tmp_path / "analysis").mkdir()
    (tmp_path / "analysis" / "system.txt").write_text("two\nlines {{X}}")
    templates = load_templates(spark, str(tmp_path))
    assert template_texts(templates, ["analysis/system"]) == {"analysis/system": "two\nlines {{X}}"}
    with pytest.raises(FileNotFoundError, match="analysis/user"):
        template_texts(templates, ["analysis/user"])
    with pytest.raises(FileNotFoundError):
        load_templates(spark, str(tmp_path / "none"))


def test_canonicalize_keeps_the_ordinal(spark, csv_file):
    assert canonicalize(load(spark, csv_file)).columns == ["col1", "spend", "ordinal"]
