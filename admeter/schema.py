"""The column contract of an ad-performance table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .errors import SchemaValidationError
from .functions.scalar import number, only_if

# --- fixed values: the contract -------------------------------------------
REQUIRED_COLUMNS = ("date", "platform", "campaign_type", "impressions", "clicks", "spend")
CONTEXT_COLUMNS = ("campaign_name", "audience", "industry", "offering", "funnel_stage", "country")
NUMERIC_COLUMNS = ("impressions", "clicks", "spend", "conversions", "conversion_value", "reach", "frequency")
ZERO_FILLED_COLUMNS = ("impressions", "clicks", "spend", "conversions", "conversion_value")
IDENTITY_KEYS = ("date", "platform", "account_id", "campaign_id", "adset_id", "ad_id")
HEADER_ALIASES = {
    "date": ("day", "report_date"),
    "campaign_name": ("campaign", "campaignname", "campaign title"),
    "campaign_type": ("campaign type",),
    "platform": ("platform",),
    "impressions": ("impr.", "impr"),
    "clicks": ("click", "clicks"),
    "spend": ("cost", "amount spent", "amount spent (usd)"),
    "conversions": ("results", "purchases"),
    "conversion_value": ("conv value", "conversion value", "revenue"),
}
# KPIs that exports also report themselves, under upper-case headers.
REPORTED_KPIS = ("ctr", "cpc", "cpm", "cpa", "cvr", "roas", "aov")
# ---------------------------------------------------------------------------

_CANONICAL = {alias: name for name, aliases in HEADER_ALIASES.items() for alias in aliases}


def canonical_name(header: str) -> str:
    """The contract's name for a header; unknown headers are only stripped."""
    stripped = str(header).strip()
    return _CANONICAL.get(stripped.lower(), stripped)


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[str(name).strip() for name in df.columns])


def _select_positions(df: DataFrame, wanted: list[tuple[int, str]]) -> DataFrame:
    """Columns by position under new names; by name they could be ambiguous."""
    placed = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return placed.select(*[F.col(f"_{i}").alias(name) for i, name in wanted])


def canonicalize(df: DataFrame) -> DataFrame:
    """Bring headers to the contract's names.

    When two headers map to one name the last column stays.  Column names are
    case-insensitive in Spark, so a reported ``CTR`` becomes ``reported_ctr``
    and any other case variant of a kept name gets the suffix ``_as_given``.
    """
    last: dict[str, int] = {}
    for i, header in enumerate(df.columns):
        last[canonical_name(header)] = i
    kept = sorted(last.items(), key=lambda item: item[1])
    exact = {name for name, _ in kept}
    wanted, used = [], set()
    for name, i in kept:
        out = name
        if name != name.lower():
            if name.lower() in REPORTED_KPIS:
                out = f"reported_{name.lower()}"
            elif name.lower() in exact or name.lower() in used:
                out = f"{name}_as_given"
        used.add(out.lower())
        wanted.append((i, out))
    return _select_positions(df, wanted)


def missing_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> list[str]:
    return [name for name in required if name not in df.columns]


def numeric_report(df: DataFrame, ordinal: str | None = None, columns=NUMERIC_COLUMNS,
                   n_examples: int = 3) -> DataFrame:
    """Per numeric column: how many values are not numbers, and the first few.

    Output ``column, n_invalid, examples`` with one row per offending column.
    Distinct values are counted by a shuffled aggregate, never gathered in one
    buffer; the examples are a bounded top-k.
    """
    text = [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]
    if not text:
        return df.sparkSession.createDataFrame([], "column string, n_invalid bigint, examples array<string>")
    order = F.col(ordinal) if ordinal else F.lit(0)
    bad = F.concat(*[
        only_if(F.col(c).isNotNull() & number(df, c).isNull(),
                F.struct(F.lit(c).alias("column"), F.col(c).alias("value")))
        for c in text
    ])
    by_value = (
        df.select(order.alias("_ord"), F.explode(bad).alias("_bad"))
        .groupBy("_bad.column", "_bad.value")
        .agg(F.count("*").alias("n"), F.min("_ord").alias("first"))
    )
    counts = by_value.groupBy("column").agg(F.sum("n").alias("n_invalid"))
    rank = F.row_number().over(W.partitionBy("column").orderBy("first", "value"))
    examples = (
        by_value.withColumn("_rank", rank).filter(F.col("_rank") <= n_examples)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "value"))).alias("_top"))
        .select("column", F.col("_top.value").alias("examples"))
    )
    return counts.join(examples, "column")


def validate_numeric(df: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Raise when a numeric column holds text that is not a number.  Runs a job."""
    found = numeric_report(df, ordinal).orderBy("column").collect()  # one row per column
    if found:
        parts = [f"{r['column']} ({r['n_invalid']} values such as {r['examples']})" for r in found]
        raise SchemaValidationError("values that are not numbers: " + "; ".join(parts))
    return df


def validate_required(df: DataFrame, ordinal: str | None = None, strict: bool = True) -> DataFrame:
    """Raise when contract columns are missing or, if strict, hold non-numbers."""
    missing = missing_columns(df)
    if missing:
        raise SchemaValidationError(f"the ad table lacks required columns: {missing}")
    return validate_numeric(df, ordinal) if strict else df


def drop_null_columns(df: DataFrame, probe_rows: int = 1000) -> DataFrame:
    """Drop the columns in which every value is null (or NaN).  Runs a job.

    The output schema depends on the data.  A probe of a few rows clears most
    columns; only the remaining suspects are read in full, so the second pass
    is a scan of those columns alone.  The result is exact.
    """
    kinds = [f.dataType for f in df.schema.fields]
    probe = df.limit(probe_rows).collect()  # a fixed number of rows, read from the first splits only
    keep = {i for i in range(len(kinds)) if any(row[i] is not None and row[i] == row[i] for row in probe)}
    suspects = [i for i in range(len(kinds)) if i not in keep]
    if suspects:
        def filled(i: int):
            value = F.col(f"`{df.columns[i]}`")
            if isinstance(kinds[i], (T.DoubleType, T.FloatType)):
                value = F.when(~F.isnan(value), value)
            return F.count(value).alias(f"c{i}")

        counts = df.agg(*[filled(i) for i in suspects]).first()
        keep |= {i for place, i in enumerate(suspects) if counts[place] > 0}
    return df.select(*[F.col(f"`{name}`") for i, name in enumerate(df.columns) if i in keep])


def is_empty(df: DataFrame) -> bool:
    """True when there is no row.  Runs a job that stops at the first row."""
    return df.isEmpty()
