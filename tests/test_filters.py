import pytest
from conftest import rows
from pyspark.sql import functions as F

import clientele as cl


@pytest.fixture(scope="module")
def summary(shop):
    return cl.customer_summary(*shop).withColumn(
        "churn_risk_level", F.when(F.col("customer_id") == "c1", "Low Risk").otherwise("High Churn Risk")
    )


def ids(df):
    return [r[0] for r in rows(df, "customer_id")]


def test_categories(summary):
    assert ids(cl.filter_customers(summary, ["Electronics"])) == ["c1", "c2"]
    assert len(ids(cl.filter_customers(summary, []))) == 5


def test_tier(summary):
    assert ids(cl.filter_customers(summary, tier="Low Risk")) == ["c1"]
    assert len(ids(cl.filter_customers(summary, tier="All"))) == 5


def test_spend_bound_is_kept(summary):
    assert ids(cl.filter_customers(summary, min_spent=0.3)) == ["c1", "c4"]
    assert ids(cl.filter_customers(summary, ["Home & Kitchen"], "High Churn Risk", 0.3)) == ["c4"]


def test_date_range(shop):
    orders = shop[1]
    assert [r[0] for r in rows(cl.filter_orders(orders, "2024-06-15", "2024-06-30"), "order_id")] == ["o2", "o4", "o5"]
    assert cl.filter_orders(orders, "2024-06-15").count() == 7
    assert cl.filter_orders(orders, None, "2024-06-15").count() == 7


@pytest.mark.parametrize(
    ("term", "literal", "found"),
    [
        ("a.b@", False, ["c2", "c3"]),
        ("A.B@", False, ["c2", "c3"]),
        ("a.b@", True, ["c3"]),
        ("LEE", False, ["c1"]),
        ("lee|^bob", False, ["c1", "c2"]),
        ("C4", False, ["c4"]),
        ("(", True, []),
        ("", False, ["c1", "c2", "c3", "c4", "c5"]),
    ],
)
def test_search(summary, term, literal, found):
    assert ids(cl.search_customers(summary, term, literal)) == found


def test_search_skips_nulls_and_folds_accents(spark):
    df = spark.createDataFrame(
        [("c1", None, None), ("c2", "Émilie", None), ("c3", None, "x@y")],
        "customer_id string, name string, email string",
    )
    assert ids(cl.search_customers(df, "émi")) == ["c2"]
    assert ids(cl.search_customers(df, "X@")) == ["c3"]
    assert ids(cl.search_customers(df, "ÉMI", literal=True)) == ["c2"]


def test_bad_pattern(summary):
    with pytest.raises(ValueError, match="search pattern"):
        cl.search_customers(summary, "(")


def test_options(shop, summary):
    (row,) = cl.filter_options(shop[1], summary).collect()
    assert (str(row[0]), str(row[1]), row[2]) == ("2024-05-31", "2024-07-05", 30.3)
    assert [r[0] for r in cl.category_options(shop[0]).collect()] == [
        "Electronics",
        "Home & Kitchen",
        "Sports & Outdoors",
    ]
