"""Model replies as a table: parsing, validity, and joining them to cohorts.

A ``responses`` table has ``cohort_id, run_id, stage, attempt, raw``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import json_int, only_if

# --- fixed values: shapes of the replies --------------------------------------
CARD_TEXT_FIELDS = ("title", "whats_happening", "why_this_matters", "priority", "expected_impact", "owner_suggestion")
PRIORITIES = ("High", "Medium", "Low")
CARDS_PER_REPLY = 4
INSIGHT_FIELDS = ("insight", "evidence", "business_impact")
PATTERN_FIELDS = ("pattern_or_risk", "evidence", "why_it_matters")
NOTE_LISTS = ("what_we_see", "what_it_likely_means", "risks_or_watchouts")
MIN_SUMMARY_LENGTH = 10
VERDICTS = ("accept", "revise", "reject")
ANALYSIS_CRITERIA = ("clarity", "accuracy", "hallucination", "structure", "kpi_alignment")
LEGACY_CRITERIA = ("clarity", "accuracy", "structure")
# score name in a reply: spellings it may have in the JSON
RECOMMENDATION_CRITERIA = {
    "Structure": ("structure",),
    "Feasibility": ("feasibility",),
    "Recommendation_Count": ("Recommendation_Count",),
    "Analysis_Grounding": ("Analysis_Grounding", "analysis_grounding"),
    "Action_Step_Completeness": ("Action_Step_Completeness", "action_step_completeness"),
    "Priority_Alignment": ("Priority_Alignment", "priority_alignment"),
    "Tone_Audience_Compliance": ("Tone_&_Audience_Compliance", "tone_audience"),
    "Expected_Impact_Quality": ("Expected_Impact_Quality", "expected_impact"),
    "instruction_adherence": ("instruction_adherence",),
}
# ------------------------------------------------------------------------------

# Values are read as VARIANT, so that one parse gives both a value and its type in the JSON: a typed parse would read the number 5 as
# the text "5".  Only lists of objects and objects are typed; further fields of a reply may hold what they like.

def _fields_of(fields) -> str:
    return f"STRUCT<{', '.join(f'{f}:VARIANT' for f in fields)}>"


SECTIONS = {"budget_and_efficiency": INSIGHT_FIELDS, "results_and_value": INSIGHT_FIELDS, "cross_channel_patterns_and_risks": PATTERN_FIELDS}
RECOMMENDATION_SCHEMA = f"STRUCT<recommendations:ARRAY<{_fields_of([*CARD_TEXT_FIELDS, 'what_you_should_do'])}>, _corrupt:STRING>"
ANALYSIS_SCHEMA = (
    "STRUCT<analysis:STRUCT<executive_summary:VARIANT, "
    + "".join(f"{name}:ARRAY<{_fields_of(fields)}>, " for name, fields in SECTIONS.items())
    + f"channel_notes:ARRAY<{_fields_of(['platform', *NOTE_LISTS])}>, missing_info:VARIANT>, _corrupt:STRING>"
)
EVALUATION_SCHEMA = "STRUCT<evaluation:MAP<STRING,VARIANT>, _corrupt:STRING>"


def parse_json(raw: Column, schema: str) -> Column:
    """Typed reply; ``_corrupt`` holds the text when it does not fit."""
    return F.from_json(raw, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def _is_object(raw: Column) -> Column:
    return F.try_parse_json(raw).isNotNull() & F.ltrim(raw).startswith("{")


def _faults(raw: Column, parsed: Column) -> tuple[Column, Column]:
    """Whether a reply is not a JSON object at all, and whether it is one that holds another kind of value where an object or
    a list belongs.  Only replies that did not fit are parsed again."""
    corrupt = parsed["_corrupt"].isNotNull()
    object_ = F.when(corrupt, _is_object(raw)).otherwise(F.lit(True))
    return raw.isNull() | parsed.isNull() | ~object_, F.coalesce(corrupt & object_, F.lit(False))


def _violation(condition: Column, text: str) -> Column:
    return only_if(F.coalesce(condition, F.lit(True)), F.lit(text))


def _kind(value: Column) -> Column:
    """Type in the JSON; "VOID" for a JSON null, null where the field is absent."""
    return F.schema_of_variant(value)


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _texts(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<string>")


def _no_value(kind: Column) -> Column:
    return F.coalesce(kind == "VOID", F.lit(True))


def _not_text(kind: Column) -> Column:
    """Whether a field is given and not text."""
    return F.coalesce(~kind.isin("STRING", "VOID"), F.lit(False))


def _list_kind(value: Column) -> Column:
    """"none" for an absent or null list, "null" for a JSON null, "empty", "texts", or "other" for what is not a list of texts, all of them given."""
    kind, texts = _kind(value), _texts(value)
    given = F.coalesce(~F.exists(texts, lambda t: t.isNull()), F.lit(False))
    return (
        F.when(kind.isNull(), "none").when(kind == "VOID", "null").when(F.coalesce(F.size(texts) == 0, F.lit(False)), "empty")
        .when((kind == "ARRAY<STRING>") & given, "texts").otherwise("other"))


def _kinds(items: Column, texts, lists=()) -> Column:
    """Of each object of a list: the kinds of its fields."""
    return F.transform(items, lambda i: F.struct(*[_kind(i[f]).alias(f) for f in texts], *[_list_kind(i[f]).alias(f) for f in lists]))


def _typed(items: Column, texts, lists=()) -> Column:
    return F.transform(items, lambda i: F.struct(*[_text(i[f]).alias(f) for f in texts], *[_texts(i[f]).alias(f) for f in lists]))


def _any(items: Column, test) -> Column:
    return F.coalesce(F.exists(items, test), F.lit(False))


def _not_a_list(kind: Column) -> Column:
    return kind == "other"


def _judged(checked: DataFrame, bad_json: Column, violations: Column) -> DataFrame:
    """Add ``parse_error``, ``violations`` and ``valid``, and leave the helper columns out.

    The generator of one row is a border for the planner: a filter on the result, such as ``valid``, is not moved below it, where it
    would parse each reply again for every field it asks for.
    """
    made = checked.select("*", F.inline_outer(F.array(F.struct(bad_json.alias("parse_error"), violations.alias("violations")))))
    return made.drop(*[c for c in made.columns if c.startswith("_reply")]).withColumn("valid", F.size("violations") == 0)


def _finish(checked: DataFrame, bad_json: Column, checks: list[Column]) -> DataFrame:
    return _judged(checked, bad_json, F.array_distinct(F.concat(*checks)))


def check_recommendations(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``reply``, ``parse_error``, ``violations`` and ``valid`` for a recommendation reply."""
    parsed, cards = df.withColumn("_reply", parse_json(F.col(raw), RECOMMENDATION_SCHEMA)), F.col("_reply.recommendations")
    lists = ("what_you_should_do",)
    done = parsed.withColumns({
        "reply": F.when(F.col("_reply").isNotNull(), F.struct(_typed(cards, CARD_TEXT_FIELDS, lists).alias("recommendations"), F.col("_reply._corrupt").alias("_corrupt"))),
        "_reply_kinds": _kinds(cards, CARD_TEXT_FIELDS, lists),
        "_reply_priorities": F.transform(cards, lambda c: _text(c["priority"])),
    })
    bad_json, misfit = _faults(F.col(raw), F.col("_reply"))
    kinds = F.col("_reply_kinds")
    checks = [_violation(bad_json, "not a JSON object"), only_if(misfit, F.lit("a value is not an object or list")),
              _violation(~bad_json & kinds.isNull(), "recommendations is missing")]
    held = ~bad_json & kinds.isNotNull()
    checks.append(_violation(held & (F.size(kinds) != CARDS_PER_REPLY), f"not exactly {CARDS_PER_REPLY} cards"))
    for field in CARD_TEXT_FIELDS:
        checks.append(_violation(held & _any(kinds, _lacks(field)), f"{field} is missing"))
    other = _any(F.col("_reply_priorities"), lambda p: p.isNotNull() & ~p.isin(*PRIORITIES))
    checks.append(_violation(held & other, "priority is not High, Medium or Low"))
    checks.append(_violation(held & _any(kinds, lambda c: c["what_you_should_do"].isin("none", "null", "empty") | c["what_you_should_do"].isNull()), "what_you_should_do is empty"))
    checks += _type_checks(kinds, CARD_TEXT_FIELDS, lists)
    return _finish(done, bad_json, checks)


def _lacks(field: str):
    return lambda item: _no_value(item[field])


def _type_checks(kinds: Column, texts, lists=()) -> list[Column]:
    """Violations for fields that are not text, or not lists of text, in some object of a list."""
    def wrong(test, field: str):
        return lambda item: F.coalesce(test(item[field]), F.lit(False))

    return [
        *[only_if(_any(kinds, wrong(_not_text, f)), F.lit(f"{f} is not text")) for f in texts],
        *[only_if(_any(kinds, wrong(_not_a_list, f)), F.lit(f"{f} is not a list of text")) for f in lists],
    ]


def check_analyses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``reply``, ``parse_error``, ``violations`` and ``valid`` for an analysis reply."""
    parsed, body = df.withColumn("_reply", parse_json(F.col(raw), ANALYSIS_SCHEMA)), F.col("_reply.analysis")
    typed = F.struct(
        _text(body["executive_summary"]).alias("executive_summary"), *[_typed(body[s], fields).alias(s) for s, fields in SECTIONS.items()],
        _typed(body["channel_notes"], ("platform",), NOTE_LISTS).alias("channel_notes"), _texts(body["missing_info"]).alias("missing_info"))
    done = parsed.withColumns({
        "reply": F.when(F.col("_reply").isNotNull(), F.struct(F.when(body.isNotNull(), typed).alias("analysis"), F.col("_reply._corrupt").alias("_corrupt"))),
        "_reply_summary": _kind(body["executive_summary"]), "_reply_length": F.char_length(_text(body["executive_summary"])),
        "_reply_missing": _list_kind(body["missing_info"]), "_reply_notes": _kinds(body["channel_notes"], ("platform",), NOTE_LISTS),
        **{f"_reply_{s}": _kinds(body[s], fields) for s, fields in SECTIONS.items()},
    })
    bad_json, misfit = _faults(F.col(raw), F.col("_reply"))
    checks = [
        _violation(bad_json, "not a JSON object"),
        only_if(misfit, F.lit("a value is not an object or list")),
        _violation(~bad_json & body.isNull(), "analysis is missing"),
    ]
    held = ~bad_json & body.isNotNull()
    checks.append(_violation(
        held & F.coalesce(F.col("_reply_length") < MIN_SUMMARY_LENGTH, F.lit(True)), f"executive_summary is shorter than {MIN_SUMMARY_LENGTH} characters"))
    types = [only_if(_not_text(F.col("_reply_summary")), F.lit("executive_summary is not text"))]
    for section, fields in SECTIONS.items():
        items = F.col(f"_reply_{section}")
        checks.append(_violation(held & items.isNull(), f"{section} is missing"))
        checks.append(_violation(held & _any(items, _lacks_any(fields)), f"{section} has an incomplete item"))
        types += _type_checks(items, fields)
    notes = F.col("_reply_notes")
    checks.append(_violation(held & (notes.isNull() | (F.size(notes) == 0)), "channel_notes is empty"))
    unfilled = lambda n: reduce(lambda a, b: a | b, [F.coalesce(n[f].isin("none", "null", "empty"), F.lit(True)) for f in NOTE_LISTS])
    checks.append(_violation(held & _any(notes, lambda n: _no_value(n["platform"]) | unfilled(n)), "channel_notes has an incomplete note"))
    types += _type_checks(notes, ("platform",), NOTE_LISTS)
    # this list may be absent, but not null
    types.append(only_if(F.coalesce(F.col("_reply_missing").isin("null", "other"), F.lit(False)), F.lit("missing_info is not a list of text")))
    return _finish(done, bad_json, [*checks, *types])


def _lacks_any(fields):
    return lambda item: reduce(lambda a, b: a | b, [_no_value(item[f]) for f in fields])


def _lookup(fields: Column, names) -> Column:
    return F.coalesce(*[F.element_at(fields, n) for n in names])


def _check_evaluation(df: DataFrame, raw: str, criteria: dict[str, tuple[str, ...]], top: int, *,
                      fixed_verdicts: bool, defaults: dict[str, int], with_total: bool,
                      require_total_match: bool) -> DataFrame:
    parsed, fields = df.withColumn("_reply", parse_json(F.col(raw), EVALUATION_SCHEMA)), F.col("_reply.evaluation")
    names = {f"{kind}_{n}": [f"{s}_{kind}" for s in spellings] for n, spellings in criteria.items() for kind in ("score", "reasoning")}
    names |= {n: [n] for n in ("verdict", "key_issues", "improvement_suggestions", "hallucination_checklist", "total_score")}
    # each field is looked up once; a JSON null counts as absent where another spelling is given
    found = parsed.withColumn("_reply_fields", F.struct(*[_first_given(fields, spellings).alias(n) for n, spellings in names.items()]))
    of = lambda name: F.col("_reply_fields").getField(name)
    lists = ("key_issues", "improvement_suggestions")
    values = found.withColumns({
        "_reply_text": F.struct(*[_text(of(n)).alias(n) for n in names if n not in (*lists, "hallucination_checklist")]),
        "_reply_kinds": F.struct(*[_kind(of(n)).alias(n) for n in names if n not in lists], *[_list_kind(of(n)).alias(n) for n in lists]),
    })
    text = lambda name: F.col("_reply_text").getField(name)
    kind = lambda name: F.col("_reply_kinds").getField(name)
    bad_json, misfit = _faults(F.col(raw), F.col("_reply"))
    held = ~bad_json & fields.isNotNull()
    checks = [
        _violation(bad_json, "not a JSON object"),
        only_if(misfit, F.lit("a value is not an object or list")),
        _violation(~bad_json & fields.isNull(), "evaluation is missing"),
    ]
    scores = {}
    for name in criteria:
        score = json_int(text(f"score_{name}"))
        if name in defaults:
            score = F.when(_no_value(kind(f"score_{name}")), F.lit(defaults[name])).otherwise(score)
        scores[name] = score
        checks.append(_violation(held & (score.isNull() | ~score.between(1, top)), f"{name} score is not 1..{top}"))
        checks.append(_violation(held & _no_value(kind(f"reasoning_{name}")), f"{name} reasoning is missing"))
        checks.append(_violation(held & _not_text(kind(f"reasoning_{name}")), f"{name} reasoning is not text"))
    verdict = text("verdict")
    wrong = verdict.isNull() | ~verdict.isin(*VERDICTS) if fixed_verdicts else verdict.isNull()
    checks.append(_violation(held & (wrong | _not_text(kind("verdict"))), "verdict is missing or unknown"))
    for name in lists:
        checks.append(_violation(held & ~kind(name).isin("empty", "texts"), f"{name} is not a list"))
    out = {
        "scores": F.struct(*[c.alias(n) for n, c in scores.items()]),
        "reasoning": F.struct(*[text(f"reasoning_{n}").alias(n) for n in criteria]),
        "verdict": verdict, **{n: _texts(of(n)) for n in lists},
        "hallucination_checklist": F.try_variant_get(of("hallucination_checklist"), "$", "map<string,string>"),
    }
    if with_total:
        total = json_int(text("total_score"))
        right = F.coalesce(total == reduce(lambda a, b: a + b, scores.values()), F.lit(False))
        checks.append(_violation(held & total.isNull(), "total_score is missing"))
        if require_total_match:
            checks.append(_violation(held & total.isNotNull() & ~right, "total_score is not the sum of the scores"))
        out |= {"total_score": total, "total_ok": right}
    return _judged(values.withColumns(out), bad_json, F.concat(*checks))


def _first_given(fields: Column, spellings) -> Column:
    values = [F.element_at(fields, n) for n in spellings]
    return values[0] if len(values) == 1 else F.coalesce(*[F.when(~F.is_variant_null(v), v) for v in values])


def check_analysis_evaluations(df: DataFrame, raw: str = "raw", *, require_total_match: bool = True) -> DataFrame:
    """Five criteria, 1..5, with a total that must be their sum (can be switched off)."""
    return _check_evaluation(
        df, raw, {c: (c,) for c in ANALYSIS_CRITERIA}, 5, fixed_verdicts=True, defaults={},
        with_total=True, require_total_match=require_total_match)


def check_legacy_evaluations(df: DataFrame, raw: str = "raw") -> DataFrame:
    """The older form: three criteria, 1..3, no total."""
    return _check_evaluation(
        df, raw, {c: (c,) for c in LEGACY_CRITERIA}, 3, fixed_verdicts=True, defaults={},
        with_total=False, require_total_match=False)


def check_recommendation_evaluations(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Nine criteria, 1..3; a missing tone score counts as 1; any verdict text."""
    return _check_evaluation(
        df, raw, RECOMMENDATION_CRITERIA, 3, fixed_verdicts=False, defaults={"Tone_Audience_Compliance": 1},
        with_total=False, require_total_match=False)


# --- joining replies to cohorts -------------------------------------------------

REPLY_KEYS = ("cohort_id", "run_id", "stage")


def latest_responses(responses: DataFrame, keys=REPLY_KEYS, order_by=("attempt",)) -> DataFrame:
    """The last attempt per key; a group limit before the shuffle keeps hot keys small."""
    newest = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_by])
    return (
        responses.withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") == 1).drop("_rank")
    )


def attach_responses(cohorts: DataFrame, responses: DataFrame, stage: str, output: str,
                     keys=("cohort_id", "run_id")) -> DataFrame:
    """Left join the latest reply of a stage as column ``output``."""
    of_stage = responses.filter(F.col("stage") == stage)
    latest = latest_responses(of_stage, keys).select(*keys, F.col("raw").alias(output))
    return cohorts.join(latest, list(keys), "left")


def pending(cohorts: DataFrame, responses: DataFrame, stage: str, keys=("cohort_id",)) -> DataFrame:
    """Cohorts without a reply of a stage: those its prompts are still needed for."""
    have = responses.filter((F.col("stage") == stage) & F.col("raw").isNotNull()).select(*keys).distinct()
    return cohorts.join(have, list(keys), "left_anti")


def ready(cohorts: DataFrame, responses: DataFrame, stage: str, keys=("cohort_id",)) -> DataFrame:
    """Cohorts that have a reply of a stage, so that the next one can run."""
    have = responses.filter((F.col("stage") == stage) & F.col("raw").isNotNull()).select(*keys).distinct()
    return cohorts.join(have, list(keys), "left_semi")


def prefer_provided(df: DataFrame, provided: str, generated: str, output: str = "analysis") -> DataFrame:
    """Use a reply the caller supplied, else the generated one."""
    return df.withColumn(output, F.coalesce(F.col(provided), F.col(generated)))


def explode_cards(checked: DataFrame) -> DataFrame:
    """One row per action card, numbered from 0, next to the other columns.

    The outer form and a filter on its result, as a filter on the list itself would parse each reply once more.
    """
    rest = [c for c in checked.columns if c != "reply"]
    return checked.select(*rest, F.posexplode_outer("reply.recommendations").alias("card_no", "card")).filter(F.col("card_no").isNotNull())
