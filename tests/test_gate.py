"""The gate: one row of each fault, and loads that keep refused rows apart."""

import json

import pytest
from conftest import CUSTOMERS, ORDERS, rows

import clientele as cl

TEXT_CUSTOMERS = ", ".join(f"{c.split()[0]} string" for c in CUSTOMERS.split(", "))
TEXT_ORDERS = ", ".join(f"{c.split()[0]} string" for c in ORDERS.split(", "))


@pytest.fixture(scope="module")
def dirty(spark):
    good = ("Ann", "a@x", "Electronics", "2024-01-01", "France")
    customers = [
        ("c1", *good), ("c2", *good), ("c3", *good), ("c3", *good), (None, *good),
        ("c4", None, "a@x", "Electronics", "2024-01-01", None), ("c5", "Eve", "e@x", "Toys", "someday", "India"),
    ]
    fine = ("2024-06-01", "10.5", "1", "Electronics", "Completed")
    orders = [
        ("o1", "c1", *fine), ("o2", "c2", *fine), ("o2", "c2", *fine), ("o3", "c9", *fine), ("o4", "c3", *fine),
        ("o5", None, *fine), (None, "c1", *fine), ("o6", "c1", "2024-13-01", "ten", "1.5x", "Electronics", "Lost"),
        ("o7", "c4", *fine), ("o8", "c2", "2024-06-01", None, "1", "Electronics", "Returned"),
    ]
    return spark.createDataFrame(customers, TEXT_CUSTOMERS), spark.createDataFrame(orders, TEXT_ORDERS)


def refused(df):
    return sorted(((r["table_name"], r["row_key"] or "", tuple(r["reasons"])) for r in df.collect()), key=repr)


def test_every_fault_is_named(dirty):
    customers, orders, quarantine = cl.admit(*dirty, categories=["Electronics"])
    assert [r["customer_id"] for r in customers.orderBy("customer_id").collect()] == ["c1", "c2"]
    assert [r["order_id"] for r in orders.collect()] == ["o1"]
    assert refused(quarantine) == sorted(
        [
            ("customers", "", ("null customer_id",)),
            ("customers", "c3", ("repeated key",)),
            ("customers", "c3", ("repeated key",)),
            ("customers", "c4", ("null country", "null name")),
            ("customers", "c5", ("not a date: join_date", "outside of domain: category")),
            ("orders", "", ("null order_id",)),
            ("orders", "o2", ("repeated key",)),
            ("orders", "o2", ("repeated key",)),
            ("orders", "o3", ("no such customer",)),
            ("orders", "o4", ("no such customer",)),
            ("orders", "o5", ("null customer_id",)),
            ("orders", "o6", ("not a bigint: item_count", "not a date: order_date", "not a double: amount", "outside of domain: status")),
            ("orders", "o7", ("no such customer",)),
            ("orders", "o8", ("null amount",)),
        ],
        key=repr,
    )
    row = quarantine.where("row_key = 'o6'").first()["row"]
    assert json.loads(row) == dict(zip([c.split()[0] for c in ORDERS.split(", ")], ("o6", "c1", "2024-13-01", "ten", "1.5x", "Electronics", "Lost")))


def test_a_gated_load_keeps_both_parts_in_one_commit(dirty, spark, tmp_path):
    path = str(tmp_path / "shop")
    assert cl.load_tables(*dirty, path, gate=True) == 1
    customers, orders = cl.read_tables(spark, path)
    quarantine = cl.read_quarantine(spark, path)
    assert customers.count() + orders.count() + quarantine.count() == 17
    assert rows(cl.duplicate_keys(orders, "order_id")) == rows(cl.orphan_keys(orders, customers, "customer_id")) == []
    assert {f.name: f.dataType.simpleString() for f in orders.schema}["amount"] == "double"


def test_a_clean_shop_passes_whole(shop, spark):
    customers, orders, quarantine = cl.admit(*shop)
    assert rows(customers, *shop[0].columns) == rows(shop[0])
    assert rows(orders, *shop[1].columns) == rows(shop[1])
    assert quarantine.count() == 0


def test_nothing_to_admit(shop):
    customers, orders, quarantine = cl.admit(shop[0].limit(0), shop[1])
    assert (customers.count(), orders.count(), quarantine.count()) == (0, 0, shop[1].count())


def test_rows_are_judged_once_and_only_rows_in_doubt_are_joined(shop, spark, tmp_path):
    shop[1].write.parquet(str(tmp_path / "orders"))
    orders = spark.read.parquet(str(tmp_path / "orders"))
    twice = orders.unionByName(orders.limit(1))
    _, good, quarantine = cl.admit(shop[0], twice)
    assert good.count() == orders.count() - 1 and quarantine.count() == 2
    # What is admitted and what is refused read the judged rows, not the orders again.
    assert not set(orders.inputFiles()) & (set(good.inputFiles()) | set(quarantine.inputFiles()))


def test_many_faults_are_all_found(spark):
    fine = ("Ann", "a@x", "Electronics", "2024-01-01", "France")
    customers = spark.createDataFrame([(f"c{i % 700}", *fine) for i in range(1000)], TEXT_CUSTOMERS)
    rest = ("2024-06-01", "10.5", "1", "Electronics", "Completed")
    orders = spark.createDataFrame([(f"o{i % 2500}", f"c{i % 900}", *rest) for i in range(3000)], TEXT_ORDERS)
    good, admitted, quarantine = cl.admit(customers, orders)
    assert {r["customer_id"] for r in good.collect()} == {f"c{i}" for i in range(300, 700)}
    wanted = sorted(f"o{i}" for i in range(500, 2500) if 300 <= i % 900 < 700)
    assert sorted(r["order_id"] for r in admitted.collect()) == wanted
    seen = sorted((r["row_key"], tuple(r["reasons"])) for r in quarantine.where("table_name = 'orders'").collect())
    reasons = [(i % 2500 < 500, not 300 <= i % 900 < 700) for i in range(3000)]
    words = [(f"o{i % 2500}", ("no such customer",) * gone + ("repeated key",) * again) for i, (again, gone) in enumerate(reasons) if again or gone]
    assert seen == sorted(words)
