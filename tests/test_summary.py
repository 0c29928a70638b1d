from conftest import ORDERS, day, rows

import clientele as cl


def test_summary_of_every_kind_of_customer(shop):
    found = {r["customer_id"]: r.asDict() for r in cl.customer_summary(*shop).collect()}
    assert len(found) == 5
    c1 = found["c1"]
    assert (c1["total_orders"], c1["total_spent"], c1["avg_order_value"]) == (2, 30.3, 15.15)
    assert (c1["first_order_date"], c1["last_order_date"]) == (day("2024-06-01"), day("2024-06-30"))
    assert c1["preferred_category"] == "Electronics"
    nothing = (0, 0.0, 0.0, None, None)
    for who, returned in (("c2", 1), ("c3", 0), ("c5", 0)):
        c = found[who]
        assert (
            c["total_orders"], c["total_spent"], c["avg_order_value"], c["last_order_date"], c["first_order_date"],
        ) == nothing
        assert c["returned_orders"] == returned
    assert found["c4"]["avg_order_value"] == 0.3


def test_sums_are_exact_to_the_cent(spark):
    amounts = [0.1, 0.2, 0.3, 1e12 + 0.01, -0.05, 123456.78] * 7
    orders = spark.createDataFrame(
        [(f"o{i}", "c", day("2024-06-01"), a, 1, "x", "Completed") for i, a in enumerate(amounts)], ORDERS
    )
    (row,) = cl.monthly_sales(orders).collect()
    cents = sum(round(a * 100) for a in amounts)
    assert row["monthly_revenue"] == cents / 100
    assert row["avg_order_amount"] == cents / 100 / len(amounts)


def test_monthly_sales(shop):
    assert rows(cl.monthly_sales(shop[1])) == [
        ("2024-06", 30.3, 2, 1, 15.15),
        ("2024-07", 0.3, 1, 1, 0.3),
    ]


def test_monthly_trend_uses_both_ends_of_the_range(shop):
    assert rows(cl.monthly_trend(shop[1], "2024-06-30", "2024-07-05")) == [
        ("2024-06", 20.2, 1, 1),
        ("2024-07", 0.3, 1, 1),
    ]
    assert rows(cl.monthly_trend(shop[1], "2030-01-01", "2030-01-02")) == []
    assert len(rows(cl.monthly_trend(shop[1]))) == 2


def test_order_details_newest_first(shop):
    details = cl.order_details(*shop)
    assert [r["order_id"] for r in details.collect()] == ["o6", "o3", "o2", "o5", "o4", "o1", "o7"]
    first = details.first().asDict()
    assert first["customer_name"] == "Dan"
    assert (first["customer_category"], first["product_category"]) == ("Home & Kitchen", "Electronics")
    assert rows(cl.order_details(*shop, ordered=False)) == rows(details)


def test_orders_without_customer_are_not_detailed(shop, spark):
    customers, orders = shop
    orphan = spark.createDataFrame([("o9", "nobody", day("2024-06-01"), 1.0, 1, "x", "Completed")], ORDERS)
    assert cl.order_details(customers, orders.union(orphan)).count() == 7
    assert cl.customer_summary(customers, orders.union(orphan)).count() == 5
