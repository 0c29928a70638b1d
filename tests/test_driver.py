"""Every driver query against its SQL twin, whole tables, and the shape of key plans."""

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as driver
import clientele as cl
from clientele.sources import star

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
DUCK_TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "DATE": "date", "BOOLEAN": "boolean"}
SQL = driver._shop_sql()
NAMES = [query.__name__ for query in driver.QUERIES]


def duck(sf):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{sf}/{table}.parquet'")
    return connection


def by_name(columns, data):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(row[i] for i in order) for row in data), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, name, sf):
    df = driver.queries()[name](spark, f"{DATA}/{sf}")
    result = duck(sf).execute(SQL[name])
    columns = [c[0] for c in result.description]
    types = {c[0]: DUCK_TYPES[str(c[1])] for c in result.description}
    assert {f.name: f.dataType.simpleString() for f in df.schema} == types
    assert by_name(df.columns, [tuple(r) for r in df.collect()]) == by_name(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(NAMES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert driver.queries()[name](spark, f"{DATA}/sf0.001").count() > 0


def test_flagship(spark):
    assert driver.entry(spark).count() == 150


def test_report_csv_reads_back_as_the_report(spark):
    sf = f"{DATA}/sf0.001"
    report = sorted(map(tuple, driver.risk_report(spark, sf).collect()))
    assert sorted(map(tuple, driver.report_csv(spark, sf).collect())) == report


def test_kpis_agree_with_the_report(spark):
    sf = f"{DATA}/sf0.001"
    scored = driver._churn(spark, sf).customers
    tiers = [r["churn_risk_level"] for r in cl.risk_report(scored).collect()]
    row = cl.kpis(scored).first()
    assert row["customers"] == len(tiers)
    assert row["high_risk_customers"] == tiers.count("High Churn Risk")


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_lineitem_is_read_only_for_item_count(spark):
    sf = f"{DATA}/sf0.001"
    assert "l_orderkey" not in plan(driver.customer_summary(spark, sf))
    assert "l_orderkey" not in plan(driver.monthly_sales(spark, sf))
    assert "l_orderkey" in plan(driver.order_details(spark, sf))


def test_nation_is_read_only_for_the_country(spark):
    sf = f"{DATA}/sf0.001"
    assert "n_nationkey" not in plan(driver.category_options(spark, sf))
    assert "n_nationkey" not in plan(driver.check_pk(spark, sf))
    assert "n_nationkey" not in plan(driver.kpis(spark, sf))
    assert "n_nationkey" in plan(driver.customer_summary(spark, sf))


def test_filters_reach_the_scan(spark):
    text = plan(driver.monthly_sales_in_range(spark, f"{DATA}/sf0.001"))
    assert "GreaterThanOrEqual(o_orderdate" in text
    assert "EqualTo(o_orderstatus,F)" in text


def test_row_level_plans_have_no_single_partition_step(spark):
    sf = f"{DATA}/sf0.001"
    for name in ("customer_summary", "order_details", "rfm_segments", "rfm_scores", "rfm_ranks", "scaled_features"):
        text = plan(driver.queries()[name](spark, sf))
        assert "SinglePartition" not in text, name
        assert "Python" not in text, name


def test_scores_are_a_projection_of_the_staged_summary(spark):
    staged = cl.stage(driver._summary(spark, f"{DATA}/sf0.001"))
    text = plan(cl.rfm(staged, staged=True))
    assert "Exchange" not in text and "Join" not in text


def test_long_keys_are_not_cut(spark):
    from clientele.functions.ids import with_public_ids

    df = spark.createDataFrame([(7,), (12_345_678_901,)], "customer_id bigint")
    assert [r[0] for r in with_public_ids(df).collect()] == ["CUST_000000007", "CUST_12345678901"]


def test_star_views_conform(spark):
    from clientele.sources import schema

    sf = f"{DATA}/sf0.001"
    assert set(star.customers(spark, sf).columns) == {f.name for f in schema.CUSTOMERS}
    assert [f.name for f in star.orders(spark, sf).schema] == [f.name for f in schema.ORDERS]
