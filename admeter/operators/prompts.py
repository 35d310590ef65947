"""Prompt tables: one row per cohort part, rendered with string functions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalar import only_if

# --- fixed values: stages, the template names they use, and placeholders ---------
GOAL_TEMPLATES = {
    "Increase Sales": "goal/increase_sales",
    "Brand Awareness": "goal/brand_awareness",
    "Revenue Efficiency": "goal/revenue_efficiency",
    "Traffic": "goal/traffic",
}
STAGE_TEMPLATES = {
    "analysis": ("analysis/system", "analysis/user"),
    "analysis_merge": ("analysis_merge/system", "analysis_merge/user"),
    "recommendation": ("recommendation/system", "recommendation/user"),
    "analysis_evaluation": ("analysis_evaluation/system", "analysis_evaluation/user"),
    "recommendation_evaluation": ("recommendation_evaluation/system", "recommendation_evaluation/user"),
}
REQUIRED_PLACEHOLDERS = {
    "analysis": ("CAMPAIGN_DATA", "BUSINESS_DOMAIN", "CAMPAIGN_TARGET"),
    "analysis_merge": ("PARTS_JSON", "BUSINESS_DOMAIN", "CAMPAIGN_TARGET"),
    "recommendation": ("CAMPAIGN_TARGET", "BUSINESS_DOMAIN", "CAMPAIGN_DATA", "ANALYSIS_JSON"),
    "analysis_evaluation": ("CAMPAIGN_CONTEXT", "RAW_DATA", "ANALYSIS_REPORT"),
    "recommendation_evaluation": ("BUSINESS_CONTEXT", "RAW_DATA", "ANALYSIS_CONTEXT", "RECOMMENDATION"),
}
PLACEHOLDER = r"\{\{.*?\}\}"
# ---------------------------------------------------------------------------------

# Our own default wording; users bring theirs with ``load_templates``.
DEFAULT_TEMPLATES = {
    "analysis/system": (
        "You analyse paid-media results for readers outside marketing. Describe budget efficiency, "
        "outcomes, patterns and risks, and missing data. Use only the figures given, quote at least two "
        "metrics per finding, and give no advice. Rates are decimals.\n{{GOAL_INSTRUCTIONS}}"
    ),
    "analysis/user": (
        "Target:\n{{CAMPAIGN_TARGET}}\nBusiness:\n{{BUSINESS_DOMAIN}}\nRows:\n{{CAMPAIGN_DATA}}\n"
        "Reply with one JSON object that has the key analysis."
    ),
    "analysis_merge/system": (
        "You are given analyses of parts of one campaign's rows. Make one analysis of the whole of them, of the same form: keep what "
        "several parts show, tell where parts differ, drop repeats, and use only their figures.\n{{GOAL_INSTRUCTIONS}}"
    ),
    "analysis_merge/user": (
        "Target:\n{{CAMPAIGN_TARGET}}\nBusiness:\n{{BUSINESS_DOMAIN}}\nAnalyses of parts:\n{{PARTS_JSON}}\n"
        "Reply with one JSON object that has the key analysis."
    ),
    "recommendation/system": (
        "You turn a finished campaign analysis into exactly four action cards, each about another cause. "
        "Stay within the analysis, name a metric in every expected impact, and do not hedge.\n{{GOAL_INSTRUCTIONS}}"
    ),
    "recommendation/user": (
        "Target:\n{{CAMPAIGN_TARGET}}\nBusiness:\n{{BUSINESS_DOMAIN}}\nRows:\n{{CAMPAIGN_DATA}}\n"
        "Analysis:\n{{ANALYSIS_JSON}}\nReply with one JSON object that has the key recommendations."
    ),
    "analysis_evaluation/system": (
        "You audit a campaign analysis against its data. Score clarity, accuracy, hallucination, structure and "
        "KPI alignment from 1 to 5 and give a verdict."
    ),
    "analysis_evaluation/user": (
        "Goal: {{PRIMARY_GOAL}}\nKPIs: {{KPIS}}\nContext:\n{{CAMPAIGN_CONTEXT}}\nRows:\n{{RAW_DATA}}\n"
        "Report:\n{{ANALYSIS_REPORT}}"
    ),
    "recommendation_evaluation/system": (
        "You audit a set of action cards against the analysis behind them. Score each criterion from 1 to 3 "
        "and give a verdict."
    ),
    "recommendation_evaluation/user": (
        "Context:\n{{BUSINESS_CONTEXT}}\nRows:\n{{RAW_DATA}}\nAnalysis:\n{{ANALYSIS_CONTEXT}}\n"
        "Cards:\n{{RECOMMENDATION}}"
    ),
    "goal/increase_sales": "Goal: more sales. Look first at purchases, revenue, ROAS and CPA.",
    "goal/brand_awareness": "Goal: awareness. Look first at reach, impressions, CPM and frequency.",
    "goal/revenue_efficiency": "Goal: sound unit economics. Look first at MER, LTV to CAC and payback.",
    "goal/traffic": "Goal: visits. Look first at CTR, clicks and CPC.",
}


def default_templates(spark: SparkSession) -> DataFrame:
    """The default wording as a table ``name, text``."""
    rows = [F.struct(F.lit(name).alias("name"), F.lit(text).alias("text")) for name, text in DEFAULT_TEMPLATES.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def load_templates(spark: SparkSession, directory: str) -> DataFrame:
    """Templates from files ``<directory>/<name>.txt`` (or .md): ``name, text``."""
    try:
        files = (
            spark.read.option("recursiveFileLookup", True)
            .text(directory, wholetext=True)
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no templates below {directory}") from error
        raise
    parts = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)\.(?:txt|md)$", 1)
    return files.select(parts.alias("name"), F.col("value").alias("text")).filter(F.col("name") != "")


def template_texts(templates: DataFrame, names) -> dict[str, str]:
    """The text of named templates.  Runs a job over the template table only."""
    wanted = list(names)
    found = {r["name"]: r["text"] for r in templates.filter(F.col("name").isin(wanted)).collect()}
    missing = [n for n in wanted if n not in found]
    if missing:
        raise FileNotFoundError(f"templates lack {', '.join(missing)}")
    return found


def goal_instructions(goal: Column, texts: dict[str, str]) -> Column:
    """Instruction text of a goal; empty for any other goal."""
    out = F.lit("")
    for name, template in GOAL_TEMPLATES.items():
        out = F.when(goal == name, F.lit(texts[template])).otherwise(out)
    return out


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{{NAME}}`` by each value in turn; a null value becomes ``null``."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("null")))
    return out


def unresolved_placeholders(text: Column) -> Column:
    """Placeholders still present in a text, also those that came in with data."""
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), 0)


def _as_json(df: DataFrame, name: str) -> Column:
    """A column as JSON text; text is taken to be JSON already."""
    if df.schema[name].dataType.typeName() == "string":
        return F.col(name)
    return F.to_json(name)


def _render(df: DataFrame, stage: str, values: dict[str, Column], templates: DataFrame, *,
            goal: Column | None, strict: bool, any_placeholder: bool = False) -> DataFrame:
    system_name, user_name = STAGE_TEMPLATES[stage]
    names = [system_name, user_name, *(GOAL_TEMPLATES.values() if goal is not None else ())]
    texts = template_texts(templates, names)
    system = F.lit(texts[system_name])
    if goal is not None:
        system = F.replace(system, F.lit("{{GOAL_INSTRUCTIONS}}"), goal_instructions(goal, texts))
    out = df.withColumns({"_system": system, "_user": fill(F.lit(texts[user_name]), values)})
    if any_placeholder:
        left = unresolved_placeholders(F.col("_user"))
    else:
        tokens = ["{{" + n + "}}" for n in REQUIRED_PLACEHOLDERS[stage]]
        left = F.concat(*[only_if(F.col("_user").contains(t), F.lit(t)) for t in tokens])
    message = "ARRAY<STRUCT<role:STRING,content:STRING>>"
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.col("_system").alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("_user").alias("content")),
    ).cast(message)
    out = out.withColumns({"prompt_name": F.lit(f"{stage}_prompt"), "unresolved": left})
    if strict:
        # A prompt that is not complete is not sent; the row says why.
        messages = F.when(F.size("unresolved") == 0, messages)
    return out.withColumn("messages", messages).drop("_system", "_user")


def _goal(df: DataFrame) -> Column:
    """The goal in ``campaign_target``, which is a struct or JSON text."""
    if df.schema["campaign_target"].dataType.typeName() == "string":
        return F.get_json_object("campaign_target", "$.primary_goal")
    return F.col("campaign_target.primary_goal")


def analysis_prompts(payloads: DataFrame, context: DataFrame | None, templates: DataFrame, *,
                     cohort: str = "cohort_id", strict: bool = True) -> DataFrame:
    """Analysis prompt per cohort part, from payloads and cohort context.

    Without ``context`` the payload table has the context columns itself.
    """
    df = payloads if context is None else payloads.join(context, cohort)
    values = {
        "CAMPAIGN_DATA": _as_json(df, "payload"),
        "BUSINESS_DOMAIN": _as_json(df, "business_domain"),
        "CAMPAIGN_TARGET": _as_json(df, "campaign_target"),
    }
    return _render(df, "analysis", values, templates, goal=_goal(df), strict=strict)


def analysis_merge_prompts(groups: DataFrame, context: DataFrame, templates: DataFrame, *, cohort: str = "cohort_id",
                           strict: bool = True) -> DataFrame:
    """Prompt to make one analysis of several: ``groups`` has ``cohort_id, part`` and ``analyses``, an array of JSON texts."""
    df = groups.join(context, cohort)
    values = {
        "PARTS_JSON": F.concat(F.lit("["), F.array_join("analyses", ","), F.lit("]")),
        "BUSINESS_DOMAIN": _as_json(df, "business_domain"),
        "CAMPAIGN_TARGET": _as_json(df, "campaign_target"),
    }
    return _render(df, "analysis_merge", values, templates, goal=_goal(df), strict=strict)


def recommendation_prompts(payloads: DataFrame, context: DataFrame | None, analyses: DataFrame | None,
                           templates: DataFrame, *, cohort: str = "cohort_id", strict: bool = True) -> DataFrame:
    """Recommendation prompt per cohort part that has an analysis.

    ``analyses`` has a column ``analysis``; without it, or without ``context``,
    the payload table has those columns itself.
    """
    df = payloads if context is None else payloads.join(context, cohort)
    if analyses is not None:
        df = df.join(analyses, [k for k in (cohort, "part") if k in analyses.columns])
    df = df.filter(F.col("analysis").isNotNull())
    values = {
        "CAMPAIGN_TARGET": _as_json(df, "campaign_target"),
        "BUSINESS_DOMAIN": _as_json(df, "business_domain"),
        "CAMPAIGN_DATA": _as_json(df, "payload"),
        "ANALYSIS_JSON": _as_json(df, "analysis"),
    }
    return _render(df, "recommendation", values, templates, goal=_goal(df), strict=strict)


def kpi_names(payload: Column) -> Column:
    """Comma list of the metric names in a payload, each once, in name order."""
    names = F.flatten(F.transform(payload, lambda r: F.map_keys(r["performance_metrics"])))
    return F.array_join(F.array_sort(F.array_distinct(names)), ", ")


def _json_pair(first: str, a: Column, second: str, b: Column) -> Column:
    null = F.lit("null")
    return F.concat(F.lit('{"' + first + '":'), F.coalesce(a, null), F.lit(',"' + second + '":'),
                    F.coalesce(b, null), F.lit("}"))


def analysis_evaluation_prompts(inputs: DataFrame, templates: DataFrame, *, strict: bool = True) -> DataFrame:
    """Prompt to score an analysis.

    ``inputs`` has ``payload`` (or JSON text ``campaign_data``), ``analysis_report``,
    ``campaign_target`` and ``business_domain``.  ``violations`` lists missing inputs.
    """
    data = "payload" if "payload" in inputs.columns else "campaign_data"
    target, domain = _as_json(inputs, "campaign_target"), _as_json(inputs, "business_domain")
    goal = F.get_json_object(target, "$.primary_goal")
    if data == "payload":
        kpis = kpi_names(F.col("payload"))
    else:
        kpis = metric_names_in_json(F.col("campaign_data"))
    values = {
        "PRIMARY_GOAL": goal,
        "KPIS": kpis,
        "CAMPAIGN_CONTEXT": _json_pair("target", target, "business_domain", domain),
        "RAW_DATA": _as_json(inputs, data),
        "ANALYSIS_REPORT": _as_json(inputs, "analysis_report"),
    }
    out = _render(inputs, "analysis_evaluation", values, templates, goal=None, strict=strict, any_placeholder=True)
    violations = F.concat(
        only_if(target.isNull(), F.lit("no campaign_target")),
        only_if(_as_json(inputs, data).isNull(), F.lit("no campaign_data")),
        only_if(F.coalesce(goal, F.lit("")) == "", F.lit("no primary_goal")),
        only_if(F.coalesce(kpis, F.lit("")) == "", F.lit("no KPI names")),
    )
    out = out.withColumn("violations", violations)
    return out.withColumn("messages", F.when(F.size("violations") == 0, F.col("messages"))) if strict else out


def metric_names_in_json(data: Column) -> Column:
    """Metric names of campaign data that is JSON text, of one row or of a list of rows."""
    row = "STRUCT<performance_metrics:MAP<STRING,STRING>>"
    rows = F.when(F.ltrim(data).startswith("["), F.from_json(data, f"ARRAY<{row}>")).otherwise(
        F.array(F.from_json(data, row)))
    return kpi_names(F.filter(rows, lambda r: r["performance_metrics"].isNotNull()))


def recommendation_evaluation_prompts(inputs: DataFrame, templates: DataFrame, *, strict: bool = True) -> DataFrame:
    """Prompt to score action cards; columns as ``recommendation_evaluator_inputs`` gives them."""
    values = {
        "BUSINESS_CONTEXT": _json_pair("business_domain", _as_json(inputs, "business_domain"),
                                       "campaign_target", _as_json(inputs, "campaign_target")),
        "RAW_DATA": _as_json(inputs, "campaign_data"),
        "ANALYSIS_CONTEXT": _as_json(inputs, "analysis_context"),
        "RECOMMENDATION": _as_json(inputs, "recommendations"),
    }
    return _render(inputs, "recommendation_evaluation", values, templates, goal=None, strict=strict)


def archive_text(messages: Column) -> Column:
    """A message list as readable text: a banner with the role, then the content."""
    def block(m: Column) -> Column:
        banner = F.concat(F.lit("=" * 20 + " "), F.upper(F.coalesce(m["role"], F.lit("unknown"))),
                          F.lit(" MESSAGE " + "=" * 20 + "\n"))
        return F.concat(banner, F.coalesce(m["content"], F.lit("")), F.lit("\n\n"))

    return F.concat(F.array_join(F.transform(messages, block), ""), F.lit("=" * 57 + "\n"))
