"""One analysis for a cohort that was analysed in parts: a tree of merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators import prompts
from ..operators.cohorts import positions

FAN_IN = 8


def merge_parts(analyses: DataFrame, context: DataFrame, templates: DataFrame, *, judge: Callable[[DataFrame, str], DataFrame],
                keep: Callable[[DataFrame, str], DataFrame], fan_in: int = FAN_IN) -> DataFrame:
    """``cohort_id, part, analysis`` with one row per cohort, from the analyses (JSON text) of its parts.

    Level by level, up to ``fan_in`` analyses that follow each other become one prompt, and its valid reply stands for them; one that is
    alone goes on as it is.  No prompt or row grows with a cohort, and a cohort of n parts needs log(n) levels.
    ``judge(prompts, stage)`` asks the model and returns checked replies, ``keep(table, name)`` writes a table and reads
    it back.  A cohort whose merges fail keeps the groups that did not.
    """
    if fan_in < 2:
        raise ValueError(f"fan_in must be at least 2, got: {fan_in}")
    current, level = analyses, 1
    while (current.groupBy("cohort_id").count().agg(F.max("count")).first()[0] or 0) > 1:
        placed = positions(current, ordinal="part", by=["cohort_id"], output="place")
        groups = keep(
            placed.groupBy("cohort_id", F.floor(F.col("place") / fan_in).cast("bigint").alias("part"))
            .agg(F.sort_array(F.collect_list(F.struct("place", "analysis"))).alias("held"))
            .select("cohort_id", "part", F.col("held.analysis").alias("analyses")), f"analysis_groups_{level}").drop("run_id")
        alone = groups.filter(F.size("analyses") == 1).select("cohort_id", "part", F.col("analyses")[0].alias("analysis"))
        asked = prompts.analysis_merge_prompts(groups.filter(F.size("analyses") > 1), context, templates)
        merged = judge(asked, f"analysis_merge_{level}").filter("valid").select("cohort_id", "part", F.to_json("reply.analysis").alias("analysis"))
        current = keep(alone.unionByName(merged), f"analysis_level_{level}").drop("run_id")
        level += 1
    return current.withColumn("part", F.lit(0).cast("bigint"))
