import pytest

import clientele as cl


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(
        [
            ("Champions", 10.0, 5.0, "Low Risk"),
            ("Champions", 20.5, 10.25, "High Churn Risk"),
            ("Loyal Customers", 5.0, 0.0, "Low Risk"),
        ],
        "rfm_segment string, total_spent double, avg_order_value double, churn_risk_level string",
    )


def test_kpis(scored):
    row = cl.kpis(scored).first()
    assert row["total_revenue"] == 35.5
    assert row["customers"] == 3
    assert row["avg_order_value"] == pytest.approx(15.25 / 3)
    assert row["high_risk_customers"] == 1
    assert row["high_risk_pct"] == pytest.approx(100 / 3)


def test_kpis_of_nobody(scored):
    assert tuple(cl.kpis(scored.where("false")).first()) == (0.0, 0, 0.0, 0, 0.0)
    assert tuple(cl.kpis(scored.where("false"), risk=False).first()) == (0.0, 0, 0.0)


def test_kpi_display(spark):
    df = spark.createDataFrame(
        [(1234567.5, 12345, 99.954, 7, 12.34)],
        "total_revenue double, customers bigint, avg_order_value double, "
        "high_risk_customers bigint, high_risk_pct double",
    )
    assert tuple(cl.kpis_display(df).first()) == ("$1,234,567.50", "12,345", "$99.95", "7", "12.3%")


def test_segments(scored):
    assert [tuple(r) for r in cl.segment_counts(scored).collect()] == [("Champions", 2), ("Loyal Customers", 1)]
    assert [tuple(r) for r in cl.segment_spend(scored).collect()] == [("Loyal Customers", 5.0), ("Champions", 15.25)]


def test_heatmap_of_observed_scores(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (1, 4, 2.0), (3, 2, 3.0)], "R_score int, F_score int, v double")
    matrix = cl.heatmap(df, "R_score", "F_score", "v")
    assert matrix.columns == ["R_score", "2", "4"]
    assert [tuple(r) for r in matrix.collect()] == [(1, 1.0, 2.0), (3, 3.0, 0.0)]
    shown = cl.label_axes(matrix)
    assert shown.columns == ["R_score", "F2", "F4"]
    assert [r[0] for r in shown.collect()] == ["R1 (Inactive)", "R3"]
    full = cl.label_axes(cl.heatmap(df, "R_score", "F_score", "v", values=[1, 2, 3, 4]))
    assert [tuple(r) for r in full.collect()] == [("R1 (Inactive)", 0.0, 1.0, 0.0, 2.0), ("R3", 0.0, 3.0, 0.0, 0.0)]
