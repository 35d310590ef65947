"""The batch flow: files in, cleaned rows, cohorts, prompts, replies and scores out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import cohorts, ledger, prompts, responses, scoring, stages, summary
from ..operators.clean import clean, first_rows
from ..schema import canonicalize, validate_required
from ..sinks import Attempt, archive_prompts
from ..sources import load
from .merging import FAN_IN, merge_parts

Model = Callable[[list[dict]], str]

# stage of the ledger: its table of checked replies
STAGE_TABLES = {
    "analysis": "analyses", "recommendation": "recommendations", "analysis_evaluation": "analysis_evaluations",
    "recommendation_evaluation": "recommendation_evaluations",
}


def prepare(spark: SparkSession, source, *, format: str | None = None, options: dict | None = None,
            strict: bool = True, drop_all_null_columns: bool = True, **cleaning) -> DataFrame:
    """Load, canonicalise, validate and clean one ad table.

    Stops with an exception on a broken contract.  ``strict=False`` lets values
    that are not numbers become null instead.
    """
    ingested = ingest(spark, source, format=format, options=options, strict=strict,
                      drop_all_null_columns=drop_all_null_columns)
    return clean(ingested, **cleaning)


def ingest(spark: SparkSession, source, *, format: str | None = None, options: dict | None = None,
           strict: bool = True, drop_all_null_columns: bool = True) -> DataFrame:
    raw = load(spark, source, format=format, options=options, drop_all_null_columns=drop_all_null_columns)
    ordinal = "ordinal" if "ordinal" in raw.columns else None
    return validate_required(canonicalize(raw), ordinal, strict)


def run_campaigns(spark: SparkSession, source, base_dir: str, run_id: str, *, format: str | None = None,
                  options: dict | None = None, row_limit: int | None = None, batch_size: int = 6,
                  rows_per_part: int = 1000, templates: DataFrame | None = None,
                  analysis_model: Model | None = None, recommendation_model: Model | None = None,
                  evaluation_models: tuple[Model, Model] | None = None, max_parallel: int | None = None,
                  strict: bool = True, merge_fan_in: int = FAN_IN, **cleaning) -> dict[str, DataFrame]:
    """Run the whole flow into ``base_dir`` and return its tables.

    Each stage's table is written before the next stage reads it, so a lost
    executor never repeats a model call that was saved, and the cleaned rows are
    computed once.  Without models the flow stops at the analysis prompts; replies
    can then be joined from a table (``responses.attach_responses``).

    The tables count as the run's once all are written (``sinks.commits``): a run that is repeated under its id is replaced as a
    whole, and one that breaks off leaves the last committed tables as they were.  The analyses of a cohort of several
    parts are merged into one (``merging.merge_parts``), which its cards are made from, beside totals per platform.  The table ``ledger`` beside them has one row
    for every cohort.
    """
    templates = templates if templates is not None else prompts.default_templates(spark)
    attempt = Attempt(spark, base_dir, run_id)
    ingested = attempt.write(ingest(spark, source, format=format, options=options, strict=strict), "_audit/ingested", partition_by=())
    cleaned = attempt.write(clean(ingested.drop("run_id"), **cleaning), "_audit/processed", partition_by=()).drop("run_id")
    if cleaned.isEmpty():
        raise ValueError("no rows are left after cleaning")
    rows, rejects = cohorts.assign(first_rows(cleaned, row_limit), batch_size=batch_size)
    if rejects is not None:
        rejects = attempt.write(rejects, "_audit/rejects", partition_by=()).drop("run_id")

    context = cohorts.first_row_context(rows)
    summaries = summary.row_summaries(cohorts.row_positions(cohorts.with_goal(rows, context)))
    summaries = attempt.write(summaries, "enriched_rows", partition_by=()).drop("run_id")
    context = attempt.write(context, "context", partition_by=()).drop("run_id")
    payloads = attempt.write(summary.cohort_payloads(summaries, rows_per_part=rows_per_part), "enriched_summary", partition_by=()).drop("run_id")
    tables = {"rejects": rejects, "context": context, "summaries": summaries, "payloads": payloads}

    def ask(table: DataFrame, stage: str) -> DataFrame:
        """A stage's prompts, rendered once: the archive and the model both get what was saved."""
        asked = attempt.write(table, f"{stage}_messages")
        text = archive_prompts(asked.withColumn("text", prompts.archive_text(F.col("messages")))).withColumnRenamed("attempt", "prompt_no")
        # several stages archive prompts of one run
        attempt.write(text.select("cohort_id", "part", "prompt_name", "prompt_no", "unresolved", "text"), "prompts",
                      partition_by=("cohort_id", "prompt_name"), mode="append")
        return asked

    def replies(asked: DataFrame, model: Model, stage: str) -> DataFrame:
        return attempt.write(stages.call_model(asked, model, stage=stage, max_parallel=max_parallel), f"{stage}_replies")

    def done() -> dict[str, DataFrame]:
        checked = {stage: tables[name] for stage, name in STAGE_TABLES.items() if name in tables}
        attempt.write(ledger.outcome_ledger(context, checked), "ledger", partition_by=())
        attempt.commit()
        return tables

    asked = ask(prompts.analysis_prompts(payloads, context, templates), "analysis")
    tables["analysis_prompts"] = asked
    if analysis_model is None:
        return done()
    analyses = attempt.write(responses.check_analyses(replies(asked, analysis_model, "analysis")), "analyses")
    tables["analyses"] = analyses
    usable = analyses.filter("valid").select("cohort_id", "part", F.to_json("reply.analysis").alias("analysis"))
    subjects = payloads
    if recommendation_model is not None:
        if (payloads.agg(F.max("n_parts")).first()[0] or 0) > 1:
            def judge(table: DataFrame, stage: str) -> DataFrame:
                return attempt.write(responses.check_analyses(replies(ask(table, stage), analysis_model, stage)), f"{stage}_checked")

            several = payloads.filter("n_parts > 1").select("cohort_id").distinct()
            merged = merge_parts(usable.join(several, "cohort_id", "left_semi"), context, templates, judge=judge, keep=attempt.write, fan_in=merge_fan_in)
            usable = attempt.write(usable.join(several, "cohort_id", "left_anti").unionByName(merged), "merged_analyses").drop("run_id")
            whole = summary.overview_payloads(cohorts.with_goal(summaries.drop("goal"), context).join(several, "cohort_id", "left_semi"), most=rows_per_part)
            subjects = attempt.write(payloads.filter("n_parts = 1").select("cohort_id", "part", "payload").unionByName(whole), "card_subjects").drop("run_id")
        asked = ask(prompts.recommendation_prompts(subjects, context, usable, templates), "recommendation")
        tables["recommendation_prompts"] = asked
        tables["recommendations"] = attempt.write(
            responses.check_recommendations(replies(asked, recommendation_model, "recommendation")), "recommendations")
    if evaluation_models is not None:
        scored = evaluate_run(payloads, context, analyses, tables.get("recommendations"), templates,
                              evaluation_models, ask, replies, subjects=subjects, card_analyses=usable)
        tables |= {name: attempt.write(table, name) for name, table in scored.items()}
    return done()


def evaluate_run(payloads: DataFrame, context: DataFrame, analyses: DataFrame, cards: DataFrame | None,
                 templates: DataFrame, models: tuple[Model, Model], ask, replies, *, subjects: DataFrame | None = None,
                 card_analyses: DataFrame | None = None) -> dict[str, DataFrame]:
    """Score the valid analyses and cards of a run; a stage without a subject is left out.

    ``subjects`` and ``card_analyses`` are the payloads and analyses that the cards were made from, where these are not those of the parts.
    """
    subject = analyses.filter("valid").select("cohort_id", "part", F.to_json("reply.analysis").alias("analysis"))
    base = payloads.join(context, "cohort_id")
    inputs = base.join(subject.withColumnRenamed("analysis", "analysis_report"), ["cohort_id", "part"])
    asked = ask(prompts.analysis_evaluation_prompts(inputs, templates), "analysis_evaluation")
    checked = responses.check_analysis_evaluations(replies(asked, models[0], "analysis_evaluation"),
                                                   require_total_match=False)
    out = {"analysis_evaluations": scoring.analysis_verdict(scoring.score_analyses(checked))}
    if cards is not None:
        done = cards.filter("valid").select("cohort_id", "part", F.to_json("reply.recommendations").alias("recommendations"))
        base = (subjects if subjects is not None else payloads).join(context, "cohort_id")
        context_of = card_analyses if card_analyses is not None else subject
        inputs = (
            base.join(done, ["cohort_id", "part"])
            .join(context_of.withColumnRenamed("analysis", "analysis_context"), ["cohort_id", "part"])
            .withColumn("campaign_data", F.to_json("payload"))
        )
        asked = ask(prompts.recommendation_evaluation_prompts(inputs, templates), "recommendation_evaluation")
        checked = responses.check_recommendation_evaluations(replies(asked, models[1], "recommendation_evaluation"))
        ruled = scoring.recommendation_verdict(checked)
        out["recommendation_evaluations"] = scoring.score_recommendations(ruled)
    return out
