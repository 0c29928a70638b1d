import datetime
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text):
    return datetime.date.fromisoformat(text)


CUSTOMERS = "customer_id string, name string, email string, category string, join_date date, country string"
ORDERS = (
    "order_id string, customer_id string, order_date date, amount double, item_count bigint, "
    "category string, status string"
)


@pytest.fixture(scope="session")
def shop(spark):
    """(customers, orders) with every kind of purchase history."""
    customers = [
        ("c1", "Ann Lee", "ann.b@example.com", "Electronics", day("2024-01-01"), "France"),
        ("c2", "Bob Ray", "axb@example.com", "Electronics", day("2024-02-01"), "India"),
        ("c3", "Cleo", "A.B@example.com", "Home & Kitchen", day("2024-03-01"), "India"),
        ("c4", "Dan", "dan@example.com", "Home & Kitchen", day("2024-04-01"), "Canada"),
        ("c5", "Eve", "eve@example.com", "Sports & Outdoors", day("2024-05-01"), "Canada"),
    ]
    orders = [
        ("o1", "c1", day("2024-06-01"), 10.10, 1, "Electronics", "Completed"),
        ("o2", "c1", day("2024-06-30"), 20.20, 2, "Electronics", "Completed"),
        ("o3", "c1", day("2024-07-01"), 99.99, 3, "Electronics", "Cancelled"),
        ("o4", "c2", day("2024-06-15"), 30.30, 4, "Home & Kitchen", "Returned"),
        ("o5", "c3", day("2024-06-16"), 40.40, 5, "Home & Kitchen", "Cancelled"),
        ("o6", "c4", day("2024-07-05"), 0.30, 6, "Electronics", "Completed"),
        ("o7", "c4", day("2024-05-31"), 0.10, 1, "Electronics", "Cancelled"),
    ]
    return spark.createDataFrame(customers, CUSTOMERS), spark.createDataFrame(orders, ORDERS)


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
