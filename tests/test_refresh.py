"""Refreshed state against a full recompute, bitmaps against distinct counts."""

import datetime
import random

import pytest
from conftest import CUSTOMERS, ORDERS, day, rows

import clientele as cl
from clientele.plans import refresh

FIRST = day("2024-01-01")


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(1)
    customers = [(f"c{i}", f"N{i}", "e", "x", FIRST, "y") for i in range(40)]
    orders = [
        (f"o{i}", f"c{rng.randrange(50)}", FIRST + datetime.timedelta(days=rng.randrange(150)), rng.randrange(10**6) / 100, 1, "x",
         rng.choice(["Completed", "Completed", "Returned", "Cancelled"]))
        for i in range(600)
    ]
    orders.append(("o600", "c1", day("2024-03-09"), None, 1, "x", "Completed"))
    customers, orders = spark.createDataFrame(customers, CUSTOMERS), spark.createDataFrame(orders, ORDERS)
    numbers = cl.customer_numbers(orders)
    return customers, orders.join(numbers, "customer_id").select(*orders.columns, "customer_no")


def batches(orders):
    edges = ["2024-01-01", "2024-02-10", "2024-03-09", "2024-12-31"]
    return [orders.where(f"order_date >= '{a}' AND order_date < '{b}'") for a, b in zip(edges, edges[1:])]


def test_state_and_deltas_equal_a_recompute(many, spark, tmp_path):
    customers, orders = many
    state = cl.ShopState(spark, str(tmp_path / "state"), "customer_no")
    with pytest.raises(FileNotFoundError):
        state.summary(customers)
    assert not state.compact()
    for i, batch in enumerate(batches(orders)):
        assert state.refresh(f"b{i}", batch)
        assert not state.refresh(f"b{i}", batch)
    expected = rows(cl.customer_summary(customers, orders))
    monthly = cl.monthly_sales(orders).collect()
    assert len(state.entry()["parts"]) == 3
    for _ in range(2):
        assert rows(state.summary(customers)) == expected
        assert state.monthly_sales().collect() == monthly
        state.compact()
    assert len(state.entry()["parts"]) == 1 and state.entry()["batches"] == ["b0", "b1", "b2"]
    # Earlier versions can still be read.
    before = orders.where("order_date < '2024-03-09'")
    assert rows(state.summary(customers, version=2)) == rows(cl.customer_summary(customers, before))


@pytest.mark.parametrize(
    "start, end",
    [("2024-01-15", "2024-04-03"), ("2024-02-01", "2024-02-29"), ("2024-02-02", "2024-02-02"), ("2024-01-31", "2024-02-01"),
     ("2023-01-01", "2025-01-01"), ("2024-03-05", "2024-03-01"), ("2024-02-01", "2024-04-30")],
)
def test_any_range_is_exact(many, spark, start, end, tmp_path_factory):
    _, orders = many
    path = str(tmp_path_factory.getbasetemp() / "ranges")
    state = cl.ShopState(spark, path, "customer_no")
    for i, batch in enumerate(batches(orders)):
        state.refresh(f"b{i}", batch)
    trend = state.monthly_trend(start, end)
    assert trend.collect() == cl.monthly_trend(orders, start, end).collect()
    done = cl.filter_orders(orders, start, end).where("status = 'Completed'")
    assert state.active_customers(start, end).first()[0] == done.select("customer_id").distinct().count()
    plan = trend._jdf.queryExecution().toString()
    assert "order_id" not in plan and "LogicalRDD" not in plan


def test_whole_months_read_month_bitmaps_only(many, spark):
    bitmaps = cl.buyer_bitmaps(many[1], "customer_no")
    from clientele.operators.activity import _within

    kinds = {(r["grain"], r["start"].month) for r in _within(bitmaps, "2024-01-20", "2024-03-31").collect()}
    assert kinds == {("day", 1), ("month", 2), ("month", 3)}


def test_numbers_that_lie_far_apart(spark):
    ids = [1, 32_768, 32_769, 10**12, 0, -5]
    orders = spark.createDataFrame([(i, i, day("2024-01-01"), 1.0, "Completed") for i in ids * 2], "order_id long, customer_id long, order_date date, amount double, status string")
    assert cl.active_customers(cl.buyer_bitmaps(orders)).first()[0] == len(ids)


def test_known_customers_keep_their_numbers(spark):
    def frame(names):
        return spark.createDataFrame([(n,) for n in names], "customer_id string")

    first = cl.stage(cl.customer_numbers(frame("cab")))
    assert rows(first) == [("a", 1), ("b", 2), ("c", 3)]
    second = cl.customer_numbers(frame(["a", "aa", "z", None, "z"]), known=first)
    assert rows(second) == [("a", 1), ("aa", 4), ("b", 2), ("c", 3), ("z", 5)]


def test_two_writers_keep_both_batches(many, spark, tmp_path, monkeypatch):
    customers, orders = many
    path = str(tmp_path / "state")
    mine, other = cl.ShopState(spark, path, "customer_no"), cl.ShopState(spark, path, "customer_no")
    first, second, third = batches(orders)
    publish, waiting = refresh.commits.publish, [("second", second), ("third", third)]

    def late(*args):
        # Once for each batch, the other writer commits first.
        if len(waiting) == 2 - len(mine.entry()["batches"]) // 2 and waiting:
            batch = waiting.pop(0)
            other.refresh(*batch)
        return publish(*args)

    monkeypatch.setattr(refresh.commits, "publish", late)
    assert mine.refresh("first", first)
    # The same batch sent by both is added once.
    assert not mine.refresh("third", third)
    assert sorted(mine.entry()["batches"]) == ["first", "second", "third"]
    assert rows(mine.summary(customers)) == rows(cl.customer_summary(customers, orders))


def test_keys_of_another_type_are_refused(many, spark, tmp_path):
    state = cl.ShopState(spark, str(tmp_path / "state"), "customer_no")
    state.refresh("a", many[1])
    with pytest.raises(TypeError):
        state.refresh("b", many[1].withColumn("customer_id", many[1]["customer_no"]))
