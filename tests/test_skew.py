"""A shop where one customer holds a third of all orders, against pandas."""

import datetime

import numpy as np
import pandas as pd
import pytest
from conftest import CUSTOMERS, ORDERS, day, rows

import clientele as cl
from clientele.operators import joins, summary

N = 6000
HOT = "c007"


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(5)
    who = np.where(np.arange(N) % 3 == 0, 7, rng.integers(0, 200, N))
    orders = pd.DataFrame(
        {
            "order_id": [f"o{i:05d}" for i in range(N)],
            "customer_id": [f"c{c:03d}" for c in who],
            "order_date": [day("2024-01-01") + datetime.timedelta(int(d)) for d in rng.integers(0, 300, N)],
            "amount": np.round(rng.random(N) * 500, 2),
            "item_count": rng.integers(1, 7, N),
            "category": "x",
            "status": rng.choice(["Completed", "Returned", "Cancelled"], N, p=[0.7, 0.2, 0.1]),
        }
    )
    customers = pd.DataFrame({"customer_id": [f"c{c:03d}" for c in range(210)], "name": "n", "email": "e"})
    customers = customers.assign(category="x", join_date=day("2023-06-01"), country="y")
    return customers, orders


@pytest.fixture(scope="module")
def frames(spark, tables):
    customers, orders = tables
    return spark.createDataFrame(customers, CUSTOMERS), spark.createDataFrame(orders, ORDERS).repartition(6)


def test_summary(tables, frames):
    customers, orders = tables
    done = orders[orders.status == "Completed"].groupby("customer_id")
    cents = (done.amount.sum() * 100).round()
    want = customers.set_index("customer_id")[[]].assign(
        total_orders=done.size(), cents=cents, last=done.order_date.max(), first=done.order_date.min(),
        returned=orders[orders.status == "Returned"].groupby("customer_id").size(),
    )
    got = cl.customer_summary(*frames).toPandas().set_index("customer_id").sort_index()
    assert list(got.index) == list(want.index)
    assert (got.total_orders == want.total_orders.fillna(0)).all()
    assert ((got.total_spent * 100).round() == want.cents.fillna(0)).all()
    assert (got.returned_orders == want.returned.fillna(0)).all()
    bought = want["last"].notna()
    assert (got.last_order_date[bought] == want["last"][bought]).all() and got.last_order_date[~bought].isna().all()
    assert (got.first_order_date[bought] == want["first"][bought]).all()
    assert want.total_orders[HOT] > N / 5


def test_monthly(tables, frames):
    orders = tables[1]
    done = orders[orders.status == "Completed"]
    month = done.groupby(done.order_date.map(lambda d: f"{d:%Y-%m}"))
    want = [
        (m, int(round(g.amount.sum() * 100)), len(g), g.customer_id.nunique()) for m, g in sorted(month)
    ]
    got = [
        (r["year_month"], round(r["monthly_revenue"] * 100), r["total_orders"], r["active_customers"])
        for r in cl.monthly_sales(frames[1]).collect()
    ]
    assert got == want


def test_order_details_splits_the_hot_customer(tables, frames, monkeypatch):
    found = []

    def small_tasks(df, key):
        found.append(joins.hot_keys(df, key, rows_per_task=300, shown=300))
        return found[-1]

    monkeypatch.setattr(summary, "hot_keys", small_tasks)
    details = cl.order_details(*frames)
    assert [r["customer_id"] for r in found[0].collect()] == [HOT]
    orders = tables[1].sort_values(["order_date", "order_id"], ascending=[False, True])
    assert [r["order_id"] for r in details.collect()] == list(orders.order_id)
    assert rows(details, "order_id", "customer_id") == sorted(zip(orders.order_id, orders.customer_id))


def test_orphan_check_counts_a_hot_orphan(frames):
    customers, orders = frames
    found = cl.orphan_keys(orders, customers.where(f"customer_id <> '{HOT}'"), "customer_id")
    assert rows(found) == [(HOT, orders.where(f"customer_id = '{HOT}'").count())]
