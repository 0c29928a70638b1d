"""The filter cube against the filters themselves."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

import clientele as cl

TIERS = ["Low Risk", "Moderate Risk", "High Churn Risk"]
SETTINGS = [
    ((), "All", 0.0), (("a",), "All", 0.0), (("a", "c"), "High Churn Risk", 100.0), ((), "Low Risk", 250.0), ((), "All", 51.25),
    (("b", "nowhere"), "All", 149.99), (("nowhere",), "All", 0.0), ((), "All", 10_000.0), ((), "Moderate Risk", 300.0),
]


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(2)
    data = [
        (f"k{i}", rng.choice("abc"), rng.choice(TIERS), rng.choice(["Champions", "Needs Attention"]), rng.randrange(1, 5),
         rng.randrange(1, 5), rng.choice([0.0, 50.0, 99.99, 100.0, rng.randrange(60_000) / 100]), rng.randrange(9_999) / 100,
         rng.randrange(1_001) / 10)
        for i in range(400)
    ]
    data.append(("none", "a", TIERS[0], "Champions", 1, 1, None, 1.0, 1.0))
    columns = "customer_id string, preferred_category string, churn_risk_level string, rfm_segment string, R_score int, F_score int, total_spent double, avg_order_value double, churn_risk_pct double"
    return cl.stage(spark.createDataFrame(data, columns))


@pytest.fixture(scope="module")
def cube(scored):
    return cl.FilteredCube(cl.stage(cl.filter_cube(scored)), scored)


@pytest.mark.parametrize("setting", SETTINGS)
def test_answers_equal_a_rescan(scored, cube, setting):
    chosen = cl.filter_customers(scored, *setting)
    rounded = [F.round(c, 8).alias(c) for c in ("total_revenue", "avg_order_value", "high_risk_pct")]
    counts = ["customers", "high_risk_customers"]
    assert rows(cube.kpis(*setting), *rounded, *counts) == rows(cl.kpis(chosen), *rounded, *counts)
    counted = cube.segments(*setting).select("rfm_segment", "count")
    assert counted.collect() == cl.segment_counts(chosen).collect()
    spend = [F.col("rfm_segment"), F.round("avg_total_spent", 8).alias("s")]
    assert rows(cube.segments(*setting), *spend) == rows(cl.segment_spend(chosen), *spend)
    cells = [F.col("R_score"), *[F.round(f"F{f}", 8).alias(f"F{f}") for f in (1, 2, 3, 4)]]
    expected = cl.label_axes(cl.heatmap(chosen, "R_score", "F_score", "churn_risk_pct", values=[1, 2, 3, 4]))
    assert rows(cube.heatmap(*setting), *cells) == rows(expected, *cells)


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_customers_are_read_only_between_two_steps(scored, cube):
    alone = cl.FilteredCube(cube.cube)
    assert alone.kpis(min_spent=100.0).first()["customers"] > 0
    with pytest.raises(ValueError):
        alone.kpis(min_spent=101.0)
    text = cube.kpis(min_spent=101.0)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(total_spent,101.0)" in text and "LessThan(total_spent,150.0)" in text


def test_an_empty_shop(scored):
    empty = cl.FilteredCube(cl.filter_cube(scored.limit(0)))
    assert tuple(empty.kpis().first()) == tuple(cl.kpis(scored.limit(0)).first())
    assert empty.segments().count() == empty.heatmap().count() == 0
