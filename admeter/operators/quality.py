"""Checks of reports and action cards against the data and the writing rules."""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import micros, number, only_if
from ..functions.text import AMOUNT, APPROXIMATE, bound_figures, count_words, join_regex_words, let, numbers_in, times_of, unit_of
from ..schema import REPORTED_KPIS
from .diagnostics import ADDITIVE
from .kpis import METRICS as REGISTRY, RATIOS, MetricRegistry, ratio_of

# --- fixed values: word lists --------------------------------------------------
BANNED_IN_ANALYSIS = ("should", "recommend", "optimize", "improve", "consider")
HEDGING = ("might", "could")
TREND_WORDS = ("trend", "trending", "trends", "rising", "falling", "increasing", "decreasing", "growing", "declining")
METRIC_WORDS = (
    "ctr", "cpc", "cpm", "cvr", "cpa", "roas", "aov", "mer", "frequency", "reach", "impressions", "clicks",
    "conversions", "spend", "revenue", "purchases", "sessions", "refund rate", "landing page views",
    "ltv to cac", "payback period", "bounce rate", "conversion rate",
)
PREREQUISITE = "First, obtain "
RATE_KPIS = ("ctr", "cvr", "refund_rate", "bounce_proxy_rate")
# -------------------------------------------------------------------------------


def reported_vs_derived(df: DataFrame, *, tolerance: float = 0.005, registry: MetricRegistry = REGISTRY) -> DataFrame:
    """One row per row and reported KPI that differs from the derived one by more than ``tolerance``.

    Reported KPIs are the columns ``reported_<kpi>``.  A reported value beside
    an underivable one counts as a difference.
    """
    differing = []
    for kpi in REPORTED_KPIS:
        name = f"reported_{kpi}"
        derived = registry.column(df, kpi)
        if name in df.columns and derived is not None:
            reported = number(df, name)
            differs = reported.isNotNull() & (derived.isNull() | (F.abs(reported - derived) > tolerance))
            differing.append(only_if(differs, F.struct(
                F.lit(kpi).alias("kpi"), reported.alias("reported"), derived.alias("derived"))))
    if not differing:
        raise ValueError("no reported_<kpi> column with a derivable KPI")
    rest = [c for c in df.columns if not c.startswith("reported_")]
    return df.select(*rest, F.explode(F.concat(*differing)).alias("_p")).select(*rest, "_p.*")


def metric_values(summaries: DataFrame, *, cohort: str = "cohort_id") -> DataFrame:
    """Metric values of row summaries: ``cohort_id, metric, value``, each once."""
    return (
        summaries.select(cohort, F.explode("summary.performance_metrics").alias("metric", "value"))
        .filter(F.col("value").isNotNull()).distinct()
    )


def _cents(value: Column) -> Column:
    return F.rint(value * 100.0).try_cast("bigint")


def check_figures(reports: DataFrame, values: DataFrame, *, text: str = "text", cohort: str = "cohort_id") -> DataFrame:
    """One row per figure quoted in a report, with ``grounded`` and ``misread_rate``.

    ``values`` holds ``cohort_id, metric, value``.  A figure is grounded when the
    cohort has the value, at two decimals, or, for a percentage, has a rate of a
    hundredth of it.  ``misread_rate`` marks a percentage ten times a known rate
    (0.035 quoted as 35 %).  Words that are spelled out, ranges and sums over
    rows are not recognised.  The metric side is reduced to distinct values
    first, so the join meets at most one row per figure.
    """
    rate = F.col("metric").isin(*RATE_KPIS)
    readings = F.concat(
        F.array(F.struct(F.lit("value").alias("kind"), _cents(F.col("value")).alias("cents"))),
        only_if(rate, F.struct(F.lit("percent").alias("kind"), _cents(F.col("value") * 100.0).alias("cents"))),
        only_if(rate, F.struct(F.lit("misread").alias("kind"), _cents(F.col("value") * 1000.0).alias("cents"))),
    )
    known = (
        values.filter(F.col("value").isNotNull())
        .select(cohort, F.explode(readings).alias("r"))
        .groupBy(cohort, F.col("r.cents").alias("cents"))
        .agg(*[F.max(F.col("r.kind") == k).alias(f"_{k}") for k in ("value", "percent", "misread")])
    )
    rest = [c for c in reports.columns if c != text]
    figures = (
        reports.select(*rest, F.posexplode(numbers_in(F.col(text))).alias("figure_no", "f"))
        .select(*rest, F.col("figure_no").cast("bigint"), "f.figure", F.col("f.value").alias("quoted"),
                F.col("f.percent").alias("percent"))
        .withColumn("cents", _cents(F.col("quoted")))
    )
    joined = figures.join(known, [cohort, "cents"], "left")

    def hit(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    grounded = hit("_value") | (F.col("percent") & hit("_percent"))
    return joined.withColumns({
        "grounded": grounded, "misread_rate": F.col("percent") & ~grounded & hit("_misread"),
    }).drop("cents", "_value", "_percent", "_misread")


def total_values(df: DataFrame, *, cohort: str = "cohort_id", dimensions=("platform", "date")) -> DataFrame:
    """``cohort, metric, value`` of the sums and ratios a report may quote: per cohort, per value of each dimension, and of all together.

    Rows are summed once, at the finest level; the grouping sets are sums of those few rows.
    """
    measures = [c for c in ADDITIVE if c in df.columns]
    finest = df.groupBy(cohort, *dimensions).agg(*[F.sum(micros(number(df, c))).alias(c) for c in measures])
    sets = [[F.col(cohort), *[F.col(d) for d in chosen]] for chosen in ((), *[(d,) for d in dimensions], tuple(dimensions))]
    summed = finest.groupingSets(sets, cohort, *dimensions).agg(*[(F.sum(c).cast("double") / F.lit(1e6)).alias(c) for c in measures])
    ratios = {k: ratio_of(k, F.col(n), F.col(d), "stepwise") for k, (n, d) in RATIOS.items() if n in measures and d in measures}
    names = [*measures, *ratios]
    return summed.withColumns(ratios).unpivot(cohort, names, "metric", "value").filter(F.col("value").isNotNull()).distinct()


# Values are looked up by buckets of a tenth of their size, so that a range meets a few buckets and not all values.
STEP = log(1.1)


def _bucket(value: Column) -> Column:
    """A whole number that never falls as the value rises."""
    size = F.floor(F.log(F.abs(value)) / STEP) + 8000
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("bigint")


def quotes_in(text: Column, names=METRIC_WORDS) -> Column:
    """Figures, ranges ("between 3 and 4") and approximate figures ("about 1,200") of a text, with what each is a figure of:
    ``ARRAY<STRUCT<clause, name, quote, unit, percent, low, high>>``.

    A figure stands for values that agree with it at two decimals; one in thousands or millions, or an approximate one,
    for values that round to it at its last digit that is not 0.
    """
    # step by step, so that each pattern is matched once a quote
    def read(f: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(f["quote"], F.lit(AMOUNT), 0), lambda t: let(unit_of(t), lambda u: F.struct(
            u.alias("unit"), F.regexp_extract(t, r"[\d,]+(?:\.(\d+))?", 0).alias("digits"),
            (F.regexp_replace(t, r"[$,%xXkKmMbBnN]", "").try_cast("double") * times_of(u)).alias("value"), times_of(u).alias("times"))))
        return F.struct(f["clause"].alias("clause"), f["name"].alias("name"), f["quote"].alias("quote"), numbers.alias("numbers"),
                        f["quote"].rlike(rf"^(?:{'|'.join(APPROXIMATE)})\s").alias("rough"))

    def rounded(f: Column) -> Column:
        first = f["numbers"][0]
        decimals = F.length(F.regexp_extract(first["digits"], r"\.(\d+)", 1))
        zeros = F.length(F.regexp_extract(F.regexp_replace(first["digits"], ",", ""), r"[1-9](0+)$", 1))
        last = let(decimals, lambda d: F.when(d > 0, F.pow(F.lit(10.0), -d)).otherwise(F.pow(F.lit(10.0), zeros))) * first["times"]
        return F.when(f["rough"] | (first["times"] > 1), last / 2).otherwise(0.005)

    def bounds(f: Column, half: Column) -> Column:
        first, second, single = f["numbers"][0], F.get(f["numbers"], F.lit(1)), F.size(f["numbers"]) == 1
        # "3–4m": what the end is counted in holds for the start too
        low = F.when(single | (first["unit"] != ""), first["value"]).otherwise(first["value"] * second["times"])
        high = F.coalesce(second["value"], first["value"])
        return F.struct(
            f["clause"].alias("clause"), f["name"].alias("name"), f["quote"].alias("quote"), first["unit"].alias("unit"), f["quote"].endswith("%").alias("percent"),
            F.when(single, first["value"] - half).otherwise(F.least(low, high)).alias("low"),
            F.when(single, first["value"] + half).otherwise(F.greatest(low, high)).alias("high"))

    return F.transform(F.transform(bound_figures(F.coalesce(text, F.lit("")), names), read), lambda f: let(rounded(f), lambda half: bounds(f, half)))


def check_quotes(reports: DataFrame, values: DataFrame, *, text: str = "text", cohort: str = "cohort_id", names=METRIC_WORDS) -> DataFrame:
    """One row per quote of a report (``quotes_in``), with ``grounded``: whether the cohort has a value that it stands for.

    ``values`` holds ``cohort_id, metric, value`` of rows and totals (``metric_values``, ``total_values``).  A quote with the name of a
    known metric is held against that metric only; a percentage also against a hundredth of itself for rates.  Different
    intervals are looked up once each, bucket by bucket.
    """
    from ..llm.common import saved

    rest = [c for c in reports.columns if c != text]
    # quotes are read three times below, texts once: the table goes to the shared folder
    quotes = saved(reports.select(*rest, F.posexplode(quotes_in(F.col(text), names)).alias("quote_no", "q")).select(*rest, F.col("quote_no").cast("bigint"), "q.*"), "quotes")
    known = values.filter(F.col("value").isNotNull()).select(F.col(cohort).alias("k_cohort"), F.col("metric").alias("k_metric"), F.col("value").alias("v")).distinct()
    metrics = known.select("k_metric").distinct()
    keys = [cohort, "name", "percent", "low", "high"]
    asked = quotes.select(*keys).distinct()
    # the metrics that a quote is held against: its own, or all where it has no known one
    own = asked.join(metrics, F.col("name") == F.col("k_metric"), "left").withColumnRenamed("k_metric", "own")
    readings = F.concat(F.array(F.struct(F.lit(1.0).alias("scale"), F.lit(False).alias("rate"))), only_if(F.col("percent"), F.struct(F.lit(100.0).alias("scale"), F.lit(True).alias("rate"))))
    scaled = own.withColumn("r", F.explode(readings)).select(*keys, "own", "r.rate", (F.col("low") / F.col("r.scale")).alias("l"), (F.col("high") / F.col("r.scale")).alias("h"))
    spans = scaled.withColumns({"first": _bucket(F.col("l")), "last": _bucket(F.col("h"))})
    each = spans.withColumn("bucket", F.explode(F.sequence("first", "last")))
    held = known.withColumn("bucket", _bucket(F.col("v")))
    # a bucket inside the span holds a value of it if it holds any, one at its end by its extremes; only where both ends share a bucket do single values count
    extremes = held.groupBy("k_cohort", "k_metric", "bucket").agg(F.min("v").alias("least"), F.max("v").alias("most"))
    fits = (F.col(cohort) == F.col("k_cohort")) & (F.col("own").isNull() | (F.col("own") == F.col("k_metric"))) & (~F.col("rate") | F.col("k_metric").isin(*RATE_KPIS))
    many = each.filter("first < last").join(extremes.withColumnRenamed("bucket", "k_bucket"), fits & (F.col("bucket") == F.col("k_bucket")) & (F.col("most") >= F.col("l")) & (F.col("least") <= F.col("h")), "left_semi")
    same = each.filter("first = last").join(held.withColumnRenamed("bucket", "k_bucket"), fits & (F.col("bucket") == F.col("k_bucket")) & F.col("v").between(F.col("l"), F.col("h")), "left_semi")
    found = many.select(*keys).unionByName(same.select(*keys)).distinct().select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_found"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return quotes.join(found, on, "left").withColumn("grounded", F.coalesce("_found", F.lit(False))).drop("_found", *[f"_{k}" for k in keys])


def ungrounded_figures(reports: DataFrame, values: DataFrame, **options) -> DataFrame:
    """Quoted figures that the cohort's data does not hold."""
    return check_figures(reports, values, **options).filter(~F.col("grounded"))


def section_gaps(analysis: Column) -> Column:
    """Names of required sections that a parsed analysis lacks or leaves empty."""
    lists = ("budget_and_efficiency", "results_and_value", "cross_channel_patterns_and_risks", "channel_notes")
    empty = [only_if(F.coalesce(F.size(analysis[s]), F.lit(0)) <= 0, F.lit(s)) for s in lists]
    summary = only_if(F.coalesce(F.trim(analysis["executive_summary"]), F.lit("")) == "", F.lit("executive_summary"))
    missing = only_if(analysis["missing_info"].isNull(), F.lit("missing_info"))
    return F.concat(summary, *empty, missing)


def word_counts(df: DataFrame, words, *, text: str = "text", output: str = "n_hits") -> DataFrame:
    """Add how often any of ``words`` occurs in the whole text."""
    return df.withColumn(output, count_words(F.col(text), words))


def banned_words(df: DataFrame, *, text: str = "text", words=BANNED_IN_ANALYSIS) -> DataFrame:
    """Texts of an analysis that give advice, with the number of hits."""
    return word_counts(df, words, text=text, output="n_banned").filter(F.col("n_banned") > 0)


def hedging(df: DataFrame, *, text: str = "text", words=HEDGING) -> DataFrame:
    """Texts of a recommendation that hedge, with the number of hits."""
    return word_counts(df, words, text=text, output="n_hedges").filter(F.col("n_hedges") > 0)


def metrics_named(text: Column, words=METRIC_WORDS) -> Column:
    """The distinct metrics a text names."""
    spaced = F.regexp_replace(F.lower(text), "_", " ")
    return F.array_distinct(F.regexp_extract_all(spaced, F.lit(join_regex_words(words)), 0))


def thin_insights(insights: DataFrame, *, text: str = "evidence", minimum: int = 2, words=METRIC_WORDS) -> DataFrame:
    """Insights whose evidence names fewer than ``minimum`` metrics."""
    named = F.size(metrics_named(F.col(text), words)).cast("bigint")
    return insights.withColumn("n_metrics", F.coalesce(named, F.lit(0))).filter(F.col("n_metrics") < minimum)


def impact_without_metric(cards: DataFrame, *, text: str = "expected_impact", words=METRIC_WORDS) -> DataFrame:
    """Cards whose expected impact names no metric."""
    spaced = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "_", " ")
    return cards.filter(~spaced.rlike(join_regex_words(words)))


def normalized_title(title: Column) -> Column:
    """A title as lower-case words, so that punctuation does not hide a repeat."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def duplicate_cards(cards: DataFrame, *, title: str = "title", keys=("cohort_id",)) -> DataFrame:
    """Titles that several cards of one cohort share."""
    return (
        cards.groupBy(*keys, normalized_title(F.col(title)).alias("title_key"))
        .agg(F.count("*").alias("n_cards")).filter(F.col("n_cards") > 1)
    )


# Letters that tell a word's stem, and words that say nothing about a cause (fixed values).
STEM_LETTERS = 5
EMPTY_WORDS = ("a", "an", "and", "are", "as", "at", "be", "because", "by", "due", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or",
               "that", "the", "their", "this", "to", "was", "were", "while", "with")


def cause_words(text: Column) -> Column:
    """The different stems of a text's words, without words that say nothing about a cause."""
    words = F.split(normalized_title(F.coalesce(text, F.lit(""))), " ")
    said = F.array_except(words, F.array(*[F.lit(w) for w in ("", *EMPTY_WORDS)]))
    return F.sort_array(F.array_distinct(F.transform(said, lambda w: F.substring(w, 1, STEM_LETTERS))))


def repeated_causes(cards: DataFrame, *, text: str = "whats_happening", card: str = "card_no", keys=("cohort_id",), least: float = 0.5) -> DataFrame:
    """Cards of one group whose root cause another card with a smaller number names too: ``keys, card, same_as, likeness``.

    Two causes are the same if their sets of word stems have a Jaccard similarity of ``least`` or more, however they are worded; ``same_as`` is the
    smallest such card.  Equal sets (by a 128-bit hash) become one first, so many copies in a group stay one row.  The others are compared by
    bit maps (``causes.nearest``).  Intermediate tables go to the shared folder.
    """
    from ..llm.common import Scratch, saved
    from .causes import nearest

    keys = list(keys)
    said = cards.select(*keys, F.col(card).alias("card"), F.array_join(cause_words(F.col(text)), " ").alias("stems"))
    said = said.filter((F.col("stems") != "") & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, "card"]]))
    sets = saved(said.select(*keys, "card", F.unhex(F.md5("stems")).alias("hash"), "stems"), "causes-sets")
    with Scratch(cards.sparkSession) as scratch:
        one = saved(sets.groupBy(*keys, "hash").agg(F.min("card").alias("first"), F.min("stems").alias("stems")), "causes-one")
        near = nearest(one, keys, least)
        named = scratch.kept(one.drop("stems").join(near, [*keys, "hash"], "left"), "causes-named")
    # what is like the first of equal cards has a smaller number than that
    same = F.coalesce("of", F.when(F.col("card") > F.col("first"), F.struct(F.col("first").alias("other"), F.lit(1.0).alias("likeness"))))
    return sets.drop("stems").join(named, [*keys, "hash"]).withColumn("_same", same).filter(F.col("_same").isNotNull()).select(
        *keys, F.col("card").alias(card), F.col("_same.other").alias("same_as"), F.col("_same.likeness").alias("likeness"))


def missing_prerequisite(cards: DataFrame, *, actions: str = "what_you_should_do",
                         depends_on_missing: str = "depends_on_missing") -> DataFrame:
    """Cards that depend on missing data but do not first say how to obtain it."""
    first = F.get(F.col(actions), F.lit(0))
    return cards.filter(F.col(depends_on_missing) & ~F.coalesce(first.startswith(PREREQUISITE), F.lit(False)))


def kpis_stated(text: Column, kpis) -> Column:
    """KPIs that a text gives a figure for (``functions.bound_figures``), in the order of ``kpis``."""
    bound = bound_figures(F.coalesce(text, F.lit("")), [*METRIC_WORDS, *kpis])
    return F.array_intersect(F.array(*[F.lit(k) for k in kpis]), F.transform(bound, lambda f: f["name"]))


def stated_null_kpis(reports: DataFrame, gaps: DataFrame, kpis, *, text: str = "text", cohort: str = "cohort_id") -> DataFrame:
    """Reports that give a figure for a KPI no row of the cohort has.

    ``gaps`` is ``missing_info``; its absent KPIs are at most one per KPI name
    and cohort.
    """
    absent = gaps.filter("absent").groupBy(cohort).agg(F.array_sort(F.collect_set("kpi")).alias("_absent"))
    stated = F.array_intersect(kpis_stated(F.col(text), kpis), F.col("_absent"))
    return (
        reports.join(absent, cohort).withColumn("stated_null_kpis", F.array_sort(stated))
        .filter(F.size("stated_null_kpis") > 0).drop("_absent")
    )


def trend_without_series(reports: DataFrame, ads: DataFrame, *, text: str = "text", date: str = "date",
                         cohort: str = "cohort_id", words=TREND_WORDS) -> DataFrame:
    """Reports that claim a trend for a cohort with a single date."""
    spans = ads.groupBy(cohort).agg(F.min(date).alias("_from"), F.max(date).alias("_to"))
    single = spans.filter(F.col("_from") == F.col("_to")).select(cohort)
    claims = word_counts(reports, words, text=text, output="n_trend_words").filter(F.col("n_trend_words") > 0)
    return claims.join(single, cohort, "left_semi")
