import pytest
from pyspark.sql import functions as F

from admeter.errors import SchemaValidationError
from admeter.schema import (
    canonical_name, canonicalize, drop_null_columns, is_empty, missing_columns, numeric_report, strip_headers,
    validate_numeric, validate_required,
)


def test_headers_meet_the_contract(spark):
    df = spark.createDataFrame([("1/2/2024", 1, 2, 3)], ["Day", "Cost", "Impr.", "Unknown"])
    assert canonicalize(df).columns == ["date", "spend", "impressions", "Unknown"]


@pytest.mark.parametrize("header, name", [
    (" Amount Spent (USD) ", "spend"), ("REVENUE", "conversion_value"), ("Purchases", "conversions"),
    ("Campaign Title", "campaign_name"), ("report_date", "date"), ("Platform", "platform"), ("CLICKS", "clicks"),
    # only the listed aliases are case-insensitive
    ("Spend", "Spend"), ("Date", "Date"), (" ROAS ", "ROAS"),
])
def test_alias_lookup(header, name):
    assert canonical_name(header) == name


def test_last_of_two_columns_with_one_meaning_stays(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Cost", "clicks", "spend"])
    out = canonicalize(df)
    assert out.columns == ["clicks", "spend"]
    assert out.first()["spend"] == 3
    swapped = spark.createDataFrame([(3, 2, 1)], ["spend", "clicks", "Cost"])
    assert canonicalize(swapped).first()["spend"] == 1


def test_reported_kpis_do_not_hide_derived_ones(spark):
    df = spark.createDataFrame([(0.5, 1, 2)], ["CTR", "clicks", "Spend"])
    assert canonicalize(df).columns == ["reported_ctr", "clicks", "Spend"]
    both = spark.createDataFrame([(1, 2)], ["Spend", "Cost"])
    assert canonicalize(both).columns == ["Spend_as_given", "spend"]


def test_strip_headers(spark):
    assert strip_headers(spark.createDataFrame([(1, 2)], [" a ", "b "])).columns == ["a", "b"]


def test_required_columns(spark):
    df = spark.createDataFrame([("2024-01-01", "x")], ["date", "platform"])
    assert missing_columns(df) == ["campaign_type", "impressions", "clicks", "spend"]
    with pytest.raises(SchemaValidationError, match="campaign_type"):
        validate_required(df)


def test_numeric_report_counts_and_keeps_first_examples(spark):
    values = [(i, v, "5") for i, v in enumerate(["1", "x", None, "y", "x", "z", "w", "1,000", "$5", " 7 ", "1e3", "1.5d"])]
    df = spark.createDataFrame(values, "ordinal int, spend string, clicks string")
    report = numeric_report(df, "ordinal").collect()
    assert [(r["column"], r["n_invalid"], r["examples"]) for r in report] == [("spend", 8, ["x", "y", "z"])]
    with pytest.raises(SchemaValidationError, match="spend .8 values such as"):
        validate_numeric(df, "ordinal")


def test_numeric_report_is_empty_for_typed_columns(spark):
    df = spark.createDataFrame([(1.0, None)], "spend double, clicks int")
    assert numeric_report(df).count() == 0
    assert validate_numeric(df) is df


def test_drop_null_columns_reads_past_the_probe(spark):
    df = spark.range(50).select(
        F.col("id"), F.when(F.col("id") == 49, 1).alias("late"), F.lit(None).cast("string").alias("never"),
        F.lit(float("nan")).alias("nan_only"))
    assert drop_null_columns(df, probe_rows=5).columns == ["id", "late"]


def test_is_empty(spark):
    assert is_empty(spark.range(0)) and not is_empty(spark.range(1))
