"""Reading saved results of earlier runs: ``<base>/<cohort>/<run>/results/*.json``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalar import UNKNOWN

# --- fixed values: layout of a run tree and file names in it -----------------
RESULT_GLOB = "campaign_*/run_*/results"
ANALYSIS_EVALUATION = "analysis_evaluation_results.json"
RECOMMENDATION_EVALUATION = "recommendation_evaluation_results.json"
ENRICHED_SUMMARY = "enriched_summary.json"
PATH_PARTS = r"/([^/]+)/(run_[^/]+)/results/([^/]+)$"
# ------------------------------------------------------------------------------


def _path_part(path: Column, group: int) -> Column:
    return F.regexp_extract(path, PATH_PARTS, group)


def read_result_text(spark: SparkSession, base_dir: str, file_name: str = "*.json") -> DataFrame:
    """One row per result file: ``cohort_id, run_id, file_name, raw``.

    One glob scan covers all campaigns and runs; the directory names become
    columns, so later steps group by them instead of looping over directories.
    """
    try:
        files = spark.read.text(f"{base_dir}/{RESULT_GLOB}/{file_name}", wholetext=True)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no saved results below {base_dir}") from error
        raise
    path = F.col("_metadata.file_path")
    return files.select(
        _path_part(path, 1).alias("cohort_id"),
        _path_part(path, 2).alias("run_id"),
        _path_part(path, 3).alias("file_name"),
        F.col("value").alias("raw"),
    )


def list_results(spark: SparkSession, base_dir: str) -> DataFrame:
    """``cohort_id, run_id, file_name`` of every result file; lists the files and opens none."""
    files = spark.read.format("binaryFile").load(f"{base_dir}/{RESULT_GLOB}/*.json").select("path")
    return files.select(*[_path_part(F.col("path"), i + 1).alias(n) for i, n in enumerate(("cohort_id", "run_id", "file_name"))])


SCORES = "MAP<STRING,STRING>"
RECORD = f"STRUCT<scores:{SCORES}, verdict:STRING, card_title:STRING, evaluation:STRUCT<scores:{SCORES}, verdict:STRING>>"


def evaluation_records(files: DataFrame) -> DataFrame:
    """One row per evaluation record: ``cohort_id, version, card_title, scores, verdict``.

    A file may hold one record, a list of records, or an object in which some
    field holds the list.  ``scores`` is a map of DOUBLE by score name.
    """
    raw = F.col("raw")
    is_list = F.ltrim(raw).startswith("[")
    as_list = F.from_json(raw, f"ARRAY<{RECORD}>")
    as_one = F.from_json(raw, RECORD)
    # An object whose field holds a list of objects: such a field's text starts "[{".
    fields = F.from_json(raw, "MAP<STRING,STRING>")
    nested = F.filter(F.map_values(fields), lambda v: v.rlike(r"^\s*\[\s*\{"))
    from_field = F.from_json(F.get(nested, F.lit(0)), f"ARRAY<{RECORD}>")
    records = (
        F.when(is_list, as_list)
        .when(as_one["scores"].isNotNull(), F.array(as_one))
        .otherwise(F.coalesce(from_field, F.array(as_one)))
    )
    one = files.select("cohort_id", F.col("run_id").alias("version"), F.explode(records).alias("r"))
    scores = F.coalesce(F.col("r.scores"), F.col("r.evaluation.scores"))
    return one.select(
        "cohort_id", "version", F.col("r.card_title").alias("card_title"),
        F.transform_values(scores, lambda _, v: v.try_cast("double")).alias("scores"),
        F.coalesce(F.col("r.verdict"), F.col("r.evaluation.verdict")).alias("verdict"),
    )


def _field(raw: Column, name: str) -> Column:
    """A field of a JSON object as text; null when absent, null or empty."""
    text = F.get_json_object(raw, f"$.{name}")
    return F.when(~text.isin("", "{}", "[]", "null", "0", "false"), text)


def analysis_evaluator_inputs(reports: DataFrame, summaries: DataFrame) -> DataFrame:
    """What an analysis evaluation needs, with the fallbacks for older files.

    ``reports`` and ``summaries`` have ``cohort_id, run_id, raw``, one row per
    key.  The campaign data comes from the report file or else from the saved
    row summaries of the same run; the analysis is a field of the file or the
    file itself; the goal falls back to "Unknown".  Rows still lacking either
    are dropped, as there is nothing to evaluate.
    """
    raw = F.col("raw")
    own = reports.select(
        "cohort_id", "run_id",
        F.coalesce(_field(raw, "input_data"), _field(raw, "campaign_data")).alias("own_data"),
        F.coalesce(
            _field(raw, "analysis_response"),
            F.when(F.get_json_object(raw, "$.analysis").isNotNull(), raw),
        ).alias("analysis_report"),
        _field(raw, "campaign_target").alias("campaign_target"),
        _field(raw, "business_domain").alias("business_domain"),
    )
    first = F.when(F.ltrim(raw).startswith("["), F.get_json_object(raw, "$[0]")).otherwise(raw)
    identity = "$.campaign_identity."
    domain = F.to_json(F.struct(*[
        F.coalesce(F.get_json_object(first, identity + k), F.lit(UNKNOWN)).alias(k)
        for k in ("industry", "offering", "audience", "funnel_stage")
    ]))
    saved = summaries.select("cohort_id", "run_id", raw.alias("saved_data"), domain.alias("saved_domain"))
    joined = own.join(saved, ["cohort_id", "run_id"], "left")
    from_saved = F.col("own_data").isNull()
    unknown_goal = F.to_json(F.struct(F.lit(UNKNOWN).alias("primary_goal")))
    return joined.select(
        "cohort_id", "run_id",
        F.coalesce("own_data", "saved_data").alias("campaign_data"),
        "analysis_report",
        F.coalesce("campaign_target", F.when(from_saved, unknown_goal)).alias("campaign_target"),
        F.coalesce("business_domain", F.when(from_saved, F.col("saved_domain"))).alias("business_domain"),
    ).filter(F.col("campaign_data").isNotNull() & F.col("analysis_report").isNotNull())


def recommendation_evaluator_inputs(files: DataFrame) -> DataFrame:
    """The five fields a recommendation evaluation needs, from saved JSON."""
    raw = F.col("raw")
    return files.select(
        "cohort_id", "run_id",
        F.get_json_object(raw, "$.business_domain").alias("business_domain"),
        F.get_json_object(raw, "$.campaign_target").alias("campaign_target"),
        F.coalesce(_field(raw, "input_data"), _field(raw, "campaign_data")).alias("campaign_data"),
        F.get_json_object(raw, "$.analysis_response").alias("analysis_context"),
        F.coalesce(
            F.get_json_object(raw, "$.recommendation_response.recommendations"), F.lit("[]")
        ).alias("recommendations"),
    )
