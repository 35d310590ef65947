"""The on-demand flow: a table of requests instead of a file of ad rows.

A ``requests`` table has ``request_id`` and JSON text ``campaign_data`` (one ad
row as an object), ``business_domain``, ``campaign_target`` and, optionally,
``analysis_results``.  Headers are taken as they are, without aliases,
type checks or de-duplication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import prompts, responses, summary
from ..operators.kpis import RATIOS, RAW_COLUMNS
from ..operators.summary import IDENTITY_FIELDS

FIELDS = tuple(dict.fromkeys(
    [*IDENTITY_FIELDS, "primary_goal", *[c for pair in RATIOS.values() for c in pair],
     *[c for names in RAW_COLUMNS.values() for c in names]]))


def request_payloads(requests: DataFrame) -> DataFrame:
    """Each request as its own cohort: ``cohort_id, part, payload`` and the request's context."""
    row = F.from_json("campaign_data", ", ".join(f"`{f}` STRING" for f in FIELDS))
    carried = [c for c in ("business_domain", "campaign_target", "analysis_results") if c in requests.columns]
    flat = (
        requests.select(F.col("request_id").cast("string").alias("cohort_id"), *carried, row.alias("r"))
        .select("cohort_id", *carried, "r.*")
        # a request has its own columns: revenue counts as given only where it is
        .withColumn("revenue", F.coalesce("revenue", "conversion_value"))
        .withColumn("goal", F.get_json_object("campaign_target", "$.primary_goal"))
    )
    done = summary.row_summaries(flat)
    return done.select("cohort_id", F.lit(0).cast("bigint").alias("part"), *carried, F.array("summary").alias("payload"))


def analysis_requests(requests: DataFrame, templates: DataFrame, *, strict: bool = True) -> DataFrame:
    """Analysis prompts for the requests that bring no analysis of their own."""
    payloads = request_payloads(requests)
    if "analysis_results" in payloads.columns:
        payloads = payloads.filter(F.col("analysis_results").isNull())
    return prompts.analysis_prompts(payloads, None, templates, strict=strict)


def recommendation_requests(requests: DataFrame, generated: DataFrame, templates: DataFrame, *,
                            strict: bool = True) -> DataFrame:
    """Recommendation prompts, with the analysis given in the request or else the generated one.

    ``generated`` has ``cohort_id`` and JSON text ``generated_analysis``, one row
    per request.  Requests with neither are left out until their analysis is there.
    """
    joined = request_payloads(requests).join(generated, "cohort_id", "left")
    if "analysis_results" not in joined.columns:
        joined = joined.withColumn("analysis_results", F.lit(None).cast("string"))
    chosen = responses.prefer_provided(joined, "analysis_results", "generated_analysis")
    return prompts.recommendation_prompts(chosen, None, None, templates, strict=strict)
