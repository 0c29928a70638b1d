import pytest
from conftest import day, rows
from pyspark.sql import functions as F

import clientele as cl
from clientele.functions import fixed_values as fv
from clientele.functions.rules import churned, one_decimal, recommended_action, risk_tier, segment


def evaluate(spark, data, schema, column):
    return [r[-1] for r in spark.createDataFrame(data, schema).select("*", F.expr(column).alias("out")).collect()]


def test_segments(spark):
    cases = {
        (3, 3, 3): "Champions",
        (2, 3, 3): "Loyal Customers",
        (3, 2, 4): "Promising / New",
        (4, 1, 1): "Promising / New",
        (2, 3, 2): "At-Risk VIPs",
        (2, 2, 4): "Hibernating / Lost",
        (1, 1, 1): "Hibernating / Lost",
        (3, 3, 2): "Needs Attention",
    }
    got = evaluate(spark, list(cases), "r int, f int, m int", segment("r", "f", "m"))
    assert got == list(cases.values())


def test_churn_label(spark):
    cases = {(90, 3): 0, (91, 3): 1, (60, 2): 0, (61, 2): 1, (61, 3): 0, (90, 2): 1, (999, 0): 1, (0, 0): 0}
    assert evaluate(spark, list(cases), "d int, n int", churned("d", "n")) == list(cases.values())


def test_tier_applies_to_the_rounded_percentage(spark):
    cases = {
        34.9: (34.9, "Low Risk"),
        35.0: (35.0, "Moderate Risk"),
        69.9: (69.9, "Moderate Risk"),
        70.0: (70.0, "High Churn Risk"),
        34.95: (35.0, "Moderate Risk"),
        69.95: (70.0, "High Churn Risk"),
        0.25: (0.2, "Low Risk"),
        0.35: (0.4, "Low Risk"),
        2.25: (2.2, "Low Risk"),
    }
    data = [(x,) for x in cases]
    assert evaluate(spark, data, "x double", one_decimal("x")) == [c[0] for c in cases.values()]
    assert evaluate(spark, data, "x double", risk_tier(one_decimal("x"))) == [c[1] for c in cases.values()]


def test_actions(spark):
    cases = {
        (fv.HIGH_RISK, fv.CHAMPIONS): fv.WIN_BACK,
        (fv.LOW_RISK, fv.AT_RISK): fv.VIP_OUTREACH,
        (fv.MODERATE_RISK, fv.CHAMPIONS): fv.LOYALTY_CLUB,
        (fv.MODERATE_RISK, fv.HIBERNATING): fv.RE_ENGAGE,
        (fv.LOW_RISK, fv.PROMISING): fv.STANDARD,
    }
    got = evaluate(spark, list(cases), "t string, s string", recommended_action("t", "s"))
    assert got == list(cases.values())


SUMMARY = (
    "customer_id string, join_date date, total_orders bigint, total_spent double, avg_order_value double, "
    "last_order_date date, returned_orders bigint"
)


def summary(spark, *last_dates, join="2024-01-01"):
    data = [
        (f"c{i}", day(join) if join else None, 1, 5.0, 5.0, day(d) if d else None, 0)
        for i, d in enumerate(last_dates)
    ]
    return spark.createDataFrame(data, SUMMARY)


def test_snapshot_is_the_day_after_the_last_order(spark):
    df = summary(spark, "2024-06-01", "2024-07-09", None)
    assert cl.snapshot_date(df).first()[0] == day("2024-07-10")
    assert rows(cl.rfm(df), "customer_id", "recency_days") == [("c0", 39), ("c1", 1), ("c2", 999)]


def test_snapshot_fallback(spark):
    df = summary(spark, None, None)
    assert cl.snapshot_date(df).first()[0] == day("2026-07-25")
    assert {r["recency_days"] for r in cl.rfm(df).collect()} == {999}


def test_explicit_snapshot_clamps(spark):
    df = summary(spark, "2024-06-01", None)
    got = cl.rfm_features(df, "2023-12-01").select("recency_days", "tenure_days").collect()
    assert [tuple(r) for r in got] == [(0, 1), (999, 1)]
    assert cl.rfm_features(df, day("2024-06-11"), never_ordered_days=7).collect()[1]["recency_days"] == 7


def test_missing_values(spark):
    df = spark.createDataFrame([("c", None, None, None, None, None, None)], SUMMARY)
    row = cl.rfm_features(df, "2024-01-01").first().asDict()
    assert (row["frequency"], row["monetary"], row["avg_order_value"], row["returned_orders"]) == (0, 0.0, 0.0, 0)
    assert row["tenure_days"] == 30


def test_text_dates(spark):
    df = summary(spark, "2024-06-01", "2024-07-09").withColumns(
        {c: F.col(c).cast("string") for c in ("join_date", "last_order_date")}
    )
    assert [r["recency_days"] for r in cl.rfm(df).orderBy("customer_id").collect()] == [39, 1]


def test_rfm_of_no_customers(spark):
    assert cl.rfm(summary(spark)).collect() == []


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 4), (2.0, 4), (3.0, 4)], "a double, b int")
    got = cl.scale_features(df, ["a", "b"])
    scaled = [r["a_scaled"] for r in got.collect()]
    assert scaled == pytest.approx([-1.5**0.5, 0.0, 1.5**0.5])
    assert {r["b_scaled"] for r in got.collect()} == {0.0}
