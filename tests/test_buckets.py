"""Bucketed tables: same results, no moved rows, customers set apart."""

import pytest
from conftest import rows

import clientele as cl
from clientele.sources import star

DATA = "/root/testdata/sf0.001"


def details(customers, orders):
    return cl.order_details(customers, orders, ordered=False, split_hot=False)


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


@pytest.mark.parametrize("rows_per_task", [2_000_000, 12])
def test_same_results(spark, tmp_path, rows_per_task):
    customers, orders = star.customers(spark, DATA), star.orders(spark, DATA)
    cl.load_bucketed(customers, orders, str(tmp_path), 4, rows_per_task)
    stored = cl.Buckets(spark, str(tmp_path))
    assert (stored.hot_orders() is None) == (rows_per_task > 12)
    if stored.hot_orders() is not None:
        assert stored.orders().count() + stored.hot_orders().count() == orders.count()
    assert rows(stored.by_customer(cl.customer_summary)) == rows(cl.customer_summary(customers, orders))
    assert rows(stored.by_customer(details)) == rows(details(customers, orders))


def test_joins_move_no_rows(spark, tmp_path, no_broadcast):
    cl.load_bucketed(star.customers(spark, DATA), star.orders(spark, DATA), str(tmp_path), 4)
    stored = cl.Buckets(spark, str(tmp_path))
    for df in (stored.by_customer(cl.customer_summary), stored.by_customer(details)):
        text = plan(df)
        assert "SortMergeJoin" in text and "Bucketed: true" in text and "Exchange" not in text


def test_text_keys_and_a_second_load(shop, spark, tmp_path):
    customers, orders = shop
    assert cl.load_bucketed(customers, orders, str(tmp_path), 3) == 1
    assert cl.load_bucketed(customers, orders.limit(0), str(tmp_path), 3) == 2
    assert cl.Buckets(spark, str(tmp_path)).orders().count() == 0
    first = cl.Buckets(spark, str(tmp_path), load=1)
    assert rows(first.by_customer(cl.customer_summary)) == rows(cl.customer_summary(customers, orders))


def test_refusals(shop, spark, tmp_path):
    customers, orders = shop
    with pytest.raises(FileNotFoundError):
        cl.Buckets(spark, str(tmp_path))
    with pytest.raises(TypeError):
        cl.load_bucketed(customers, orders.withColumn("customer_id", orders["item_count"]), str(tmp_path), 3)
