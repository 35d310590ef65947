import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from admeter.functions import half_even, rounded, truncated_long
from admeter.operators import clean as C, kpis as K


def test_types_and_zero_fill(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "100", 10.5, None), ("invalid-date", "invalid", None, None), ("1/21/2024", " 1e3 ", float("nan"), 2.0)],
        "date string, impressions string, spend double, reach double")
    out = C.enforce_types(df).collect()
    day = dt.datetime(2024, 1, 1)
    assert [tuple(r) for r in out] == [(day, 100.0, 10.5, None), (None, 0.0, 0.0, None), (dt.datetime(2024, 1, 21), 1000.0, 0.0, 2.0)]
    raw = C.enforce_types(df, parse_dates=False, fill_missing_metrics_with_zero=False).collect()
    assert raw[1]["date"] == "invalid-date" and raw[1]["impressions"] is None and raw[2]["spend"] is None


@pytest.mark.parametrize("text, value", [
    (" 12 ", 12.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("-3", -3.0), ("1,000", None), ("$5", None), ("1.5d", None),
    ("1f", None), ("nan", None), ("", None), ("inf", float("inf")), ("0x1A", None), ("1_000", None)])
def test_numbers_in_text(spark, text, value):
    df = spark.createDataFrame([(text,)], "clicks string")
    assert C.enforce_types(df, fill_missing_metrics_with_zero=False).first()["clicks"] == value


def test_last_row_of_a_key_stays(spark, rows):
    df = spark.createDataFrame(
        [(0, "2024-01-01", "FB", 10), (1, "2024-01-01", "FB", 20), (2, "2024-01-02", "FB", 30), (3, None, "FB", 40), (4, None, "FB", 50)],
        "ordinal int, date string, platform string, spend int")
    assert rows(C.dedup_keep_last(df), "spend") == [(20,), (30,), (50,)]
    assert C.dedup_keep_last(df, extra_keys=("spend",)).count() == 5
    assert rows(C.clean(df, remove_duplicates=False), "ordinal") == [(i,) for i in range(5)]


def test_full_rows_when_there_is_no_key(spark, rows):
    df = spark.createDataFrame([(0, "a", 1), (1, "a", 1), (2, "a", None), (3, "a", None)], "ordinal int, x string, y int")
    assert rows(C.dedup_keep_last(df), "ordinal") == [(1,), (3,)]


def test_a_hot_key_is_reduced_before_the_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("ordinal"), (F.col("id") % 2).alias("date"), (F.col("id") % 1).alias("platform"))
    plan = C.dedup_keep_last(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[1]


def test_row_limit(spark, rows):
    df = spark.range(10).select((9 - F.col("id")).alias("ordinal"))
    assert rows(C.first_rows(df, 3)) == [(0,), (1,), (2,)]
    assert C.first_rows(df, None) is df


def test_rounding_is_half_even_in_binary(spark):
    values = [0.125, 0.045, 1.005, 0.375, -0.125, 2.675]
    out = spark.createDataFrame([(v,) for v in values], "x double").select(half_even(F.col("x"))).collect()
    assert [r[0] for r in out] == [0.12, 0.04, 1.0, 0.38, -0.12, 2.68]


def test_tidy_numbers(spark):
    df = spark.createDataFrame([("2.345",), ("inf",), ("x",), (None,), ("-2.9",), ("NaN",), ("1e300",)], "x string")
    out = df.select(rounded(F.col("x")), truncated_long(F.col("x"))).collect()
    assert [tuple(r) for r in out] == [(2.35, 2), (None, None), (None, None), (None, None), (-2.9, -2), (None, None), (1e300, None)]


WIDE = dict(spend=50.0, clicks=100, impressions=1000, conversions=10, revenue=400.0, conversion_value=500.0, reach=250,
            landing_page_views=80, sessions=160, purchases=8, total_revenue=900.0, total_marketing_spend=300.0, lifetime_value=90.0,
            cac=30.0, monthly_gross_profit_per_customer=10.0, refunds=1, orders=20)


@pytest.fixture
def wide(spark):
    return spark.createDataFrame([tuple(WIDE.values())], list(WIDE))


def test_all_kpis(wide):
    row = K.compute_metrics(wide).first().asDict()
    expected = dict(ctr=0.1, cpc=0.5, cpm=50.0, cvr=0.1, cpa=5.0, roas=10.0, aov=50.0, frequency=4.0, mer=3.0, ltv_to_cac=3.0,
                    cac_payback_period=3.0, refund_rate=0.05, purchase_conversion_rate=10.0, session_quality_score=0.5)
    assert {k: row[k] for k in expected} == expected
    assert row["bounce_proxy_rate"] == pytest.approx(0.2)
    assert row["revenue"] == 400.0 and row["frequency_raw"] == 4.0  # the getter sees the KPI added before it


def test_zero_division_missing_inputs_and_unknown_names(spark):
    df = spark.createDataFrame([(10, 2), (0, 5), (5, 0)], "clicks int, impressions int")
    out = K.compute_metrics(df, ["ctr", "cpc", "nonsense"])
    assert out.columns == ["clicks", "impressions", "ctr"]
    assert [r["ctr"] for r in out.collect()] == [5.0, 0.0, None]


def test_existing_columns_stay_unless_overwritten(spark):
    df = spark.createDataFrame([(1, 10, 9.0)], "clicks int, impressions int, ctr double")
    assert K.compute_metrics(df, ["ctr"]).first()["ctr"] == 9.0
    assert K.compute_metrics(df, ["ctr"], overwrite=True).first()["ctr"] == 0.1


def test_scaled_kpis_round_before_scaling(spark):
    df = spark.createDataFrame([(2662.38, 59886)], "spend double, impressions int")
    assert K.compute_metrics(df, ["cpm"]).first()["cpm"] == 40.0
    assert K.compute_metrics(df, ["cpm"], registry=K.MetricRegistry("exact")).first()["cpm"] == 44.46
    with pytest.raises(ValueError):
        K.ratio_of("cpm", F.col("spend"), F.col("impressions"), rounding="other")


def test_goal_kpis(wide, spark):
    def kpis(goal):
        return wide.select(K.goal_kpi_map(wide, F.lit(goal))).first()[0]

    traffic, sales = kpis("Traffic"), kpis("Increase Sales")
    for goal in (*K.GOAL_KPIS, "Something else", None):
        flat = K.with_goal_kpis(wide.withColumn("goal", F.lit(goal).cast("string"))).first()["goal_kpis"]
        assert flat == kpis(goal)
    assert {"clicks", "ctr", "bounce_proxy_rate"} <= set(traffic) and "roas" not in traffic
    assert {"roas", "purchases"} <= set(sales) and "bounce_proxy_rate" not in sales
    assert sales["revenue"] == 400.0
    assert kpis("Something else") == {} == kpis(None)
    assert K.goal_kpi_names("Brand Awareness") == ("cpm", "reach", "impressions", "frequency")
    assert K.goal_kpi_names("?") == ()
    assert K.goal_kpi_table(spark).count() == 4


def test_goal_kpis_ignore_existing_columns_and_drop_nulls(spark):
    df = spark.createDataFrame([(100, 50, 99.0)], "impressions int, reach int, frequency double")
    assert df.select(K.goal_kpi_map(df, F.lit("Brand Awareness"))).first()[0] == {"impressions": 100.0, "reach": 50.0, "frequency": 2.0}


def test_user_metric(spark, wide):
    import pandas as pd

    registry = K.MetricRegistry()
    registry.register("profit", lambda df: F.col("conversion_value") - F.col("spend"))
    registry.register("half_profit", lambda df: F.col("profit") / 2 if "profit" in df.columns else None)

    @F.pandas_udf("double")
    def doubled(x: pd.Series) -> pd.Series:
        return x * 2

    registry.register("doubled", lambda df: doubled("spend"))
    row = K.compute_metrics(wide, ["profit", "half_profit", "doubled"], registry=registry).first()
    assert (row["profit"], row["half_profit"], row["doubled"]) == (450.0, 225.0, 100.0)
    assert "profit" not in K.METRICS.names


def test_ratios_match_brute_force(spark):
    import numpy as np

    rng = random.Random(7)
    data = [(rng.randrange(0, 400) / 100, rng.randrange(0, 60)) for _ in range(2000)]
    df = spark.createDataFrame(data, "spend double, clicks int")
    mine = [r["cpc"] for r in K.compute_metrics(df, ["cpc"]).collect()]
    theirs = [None if d == 0 else float(np.round(n / d, 2)) for n, d in data]
    assert mine == theirs
