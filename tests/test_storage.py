import datetime

import pytest

from conftest import CUSTOMERS, ORDERS, day, rows
from pyspark.errors import AnalysisException

import clientele as cl
from clientele.sources import schema


def test_checks_on_a_clean_shop(shop):
    customers, orders = shop
    assert rows(cl.duplicate_keys(customers, "customer_id")) == []
    assert rows(cl.orphan_keys(orders, customers, "customer_id")) == []
    assert {r["nulls"] for r in cl.null_counts(customers, customers.columns).collect()} == {0}


def test_one_violation_of_each_kind(shop, spark):
    customers, orders = shop
    twin = spark.createDataFrame([("c1", "Ann", None, "Electronics", day("2024-01-01"), "France")], CUSTOMERS)
    orphan = spark.createDataFrame([("o9", "c9", day("2024-06-01"), 1.0, 1, "x", "Pending")], ORDERS)
    assert rows(cl.duplicate_keys(customers.union(twin), "customer_id")) == [("c1", 2)]
    assert rows(cl.orphan_keys(orders.union(orphan), customers, "customer_id")) == [("c9", 1)]
    nulls = cl.null_counts(customers.union(twin), ["name", "email"])
    assert rows(nulls) == [("email", 1), ("name", 0)]
    allowed = ["Completed", "Returned", "Cancelled"]
    assert rows(cl.unexpected_values(orders.union(orphan), "status", allowed)) == [("Pending", 1)]


def test_load_skips_then_rebuilds(shop, spark, tmp_path):
    customers, orders = shop
    path = str(tmp_path / "shop")
    cl.load_tables(customers, orders, path)
    cl.load_tables(customers.limit(1), orders.limit(1), path)
    got_customers, got_orders = cl.read_tables(spark, path)
    assert rows(got_customers, *customers.columns) == rows(customers)
    assert rows(got_orders, *orders.columns) == rows(orders)
    cl.load_tables(customers.limit(1), orders.limit(2), path, force=True)
    assert [t.count() for t in cl.read_tables(spark, path)] == [1, 2]


def test_loaded_tables_give_the_same_results_and_prune_months(shop, spark, tmp_path):
    path = str(tmp_path / "shop")
    cl.load_tables(*shop, path)
    customers, orders = cl.read_tables(spark, path)
    assert rows(cl.customer_summary(customers, orders)) == rows(cl.customer_summary(*shop))
    assert rows(cl.monthly_sales(orders)) == rows(cl.monthly_sales(shop[1]))
    trend = cl.monthly_trend(orders, "2024-06-15", "2024-06-30")
    assert rows(trend) == rows(cl.monthly_trend(shop[1], "2024-06-15", "2024-06-30"))
    plan = trend._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(order_month" in plan


def test_text_columns_are_cast_on_load(shop, spark, tmp_path):
    customers, orders = shop
    path = str(tmp_path / "shop")
    as_text = orders.selectExpr(*[f"cast({c} as string) as {c}" for c in orders.columns])
    cl.load_tables(customers, as_text, path)
    stored = cl.read_tables(spark, path)[1]
    assert rows(stored, *orders.columns) == rows(orders)
    assert [f.dataType for f in stored.schema][:7] == [f.dataType for f in schema.ORDERS]


REPORT = (
    "customer_id string, name string, email string, preferred_category string, country string, total_orders bigint, "
    "total_spent double, recency_days int, rfm_segment string, churn_risk_pct double, churn_risk_level string"
)


def report(spark):
    data = [
        (
            "c1", 'Ann "A", Lee', "a@b", "Electronics", "India", 1234, 12345678.9, 1001, "Champions", 70.0,
            "High Churn Risk",
        ),
        ("c2", "Bob", "b@b", "Electronics", "India", 0, 0.0, 3, "Champions", 0.1, "Low Risk"),
    ]
    return cl.risk_report(spark.createDataFrame(data, REPORT))


def test_report_display(spark):
    shown = cl.report_display(report(spark)).collect()[0].asDict()
    assert shown["Total Spent ($)"] == "$12,345,678.90"
    assert shown["Churn Risk %"] == "70.0%"
    assert (shown["Total Orders"], shown["Recency (Days)"]) == ("1,234", "1,001")
    assert shown["Recommended Action"] == "🚨 Urgent: 25% Off Win-back Promo"


def test_report_csv(spark, tmp_path):
    folder = cl.export_report(report(spark), str(tmp_path), datetime.date(2026, 7, 25))
    assert folder.endswith("churn_risk_report_20260725")
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / folder).glob("*.csv")))
    assert '"Ann ""A"", Lee"' in text
    assert ",12345678.9,1001,Champions,70.0,High Churn Risk,🚨 Urgent" in text
    assert ",0,0.0,3,Champions,0.1,Low Risk,💎 Invite" in text
    headed = cl.with_headings(report(spark))
    back = spark.read.schema(headed.schema).option("header", True).option("escape", '"').csv(folder)
    assert rows(back) == rows(headed)


def test_a_load_cut_short_is_not_a_load(shop, spark, tmp_path):
    customers, orders = shop
    path = tmp_path / "shop"
    # What an interrupted write leaves: data files, but no manifest or one that was not completed.
    orders.limit(2).write.parquet(str(path / "orders-1"))
    customers.write.parquet(str(path / "customers-1"))
    spark.createDataFrame([("1",)], "version string").write.parquet(str(path / "load=1"))
    (path / "load=1" / "_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):
        cl.read_tables(spark, str(path))
    cl.load_tables(customers, orders, str(path))
    assert rows(cl.read_tables(spark, str(path))[1], *orders.columns) == rows(orders)


def test_a_forced_load_leaves_readers_their_files(shop, spark, tmp_path):
    customers, orders = shop
    path = str(tmp_path / "shop")
    cl.load_tables(customers, orders, path)
    before = cl.read_tables(spark, path)[1]
    cl.load_tables(customers, orders.limit(1), path, force=True)
    assert before.count() == orders.count()
    assert cl.read_tables(spark, path)[1].count() == 1


def test_an_export_is_never_replaced(spark, tmp_path):
    day_, folder = datetime.date(2026, 7, 25), str(tmp_path)
    first = cl.export_report(report(spark), folder, day_)
    with pytest.raises(AnalysisException):
        cl.export_report(report(spark).limit(0), folder, day_)
    second = cl.export_report(report(spark).limit(0), folder, day_, run="evening")
    assert spark.read.option("header", True).csv(first).count() == 2
    assert second.endswith("churn_risk_report_20260725_evening")
