"""The model tables as views over a star schema of parquet files.

Keys stay numeric (``functions.ids`` gives them their text form after the joins),
which keeps shuffles narrow and null checks pushed down to the scan.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv

FIRST_ORDER_DAY = "1995-01-01"
STATUS_CODES = {fv.COMPLETED: "F", fv.RETURNED: "P", fv.CANCELLED: "O"}


# Declared, so that opening a table reads no file footers.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers(customer_id, name, email, category, join_date, country)."""
    # One row per nation, so that plans without the country drop the join. How to
    # join is left to the planner, which broadcasts by size.
    nation = table(spark, sf_dir, "nation").groupBy("n_nationkey").agg(F.expr("max(n_name) AS n_name"))
    joined = table(spark, sf_dir, "customer").join(nation, F.expr("c_nationkey = n_nationkey"), "left")
    return joined.selectExpr(
        "c_custkey AS customer_id",
        "c_name AS name",
        "concat(lower(replace(c_name, '#', '.')), '@example.com') AS email",
        "c_mktsegment AS category",
        f"date_sub(date '{FIRST_ORDER_DAY}', cast(c_custkey % 365 as int)) AS join_date",
        "n_name AS country",
    )


def orders(
    spark: SparkSession,
    sf_dir: str,
    statuses: Sequence[str] = fv.STATUSES,
    dates: tuple[str, str] | None = None,
) -> DataFrame:
    """orders(order_id, customer_id, order_date, amount, item_count, category, status).

    item_count comes from a left join to one row per order, which Catalyst drops
    from every plan that does not read the column. ``statuses`` other than all of
    them reach the scan as a filter on the stored codes, which a filter on the
    status made from them would not. ``dates`` (first and last day) keeps the orders of
    those days, and lineitem is cut to their keys before it is summed.
    """
    lines = table(spark, sf_dir, "lineitem")
    stored = table(spark, sf_dir, "orders")
    if set(statuses) != set(fv.STATUSES):
        codes = ", ".join(f"'{STATUS_CODES[s]}'" for s in statuses)
        stored = stored.where(f"o_orderstatus IN ({codes})")
    if dates:
        first, last = (F.lit(day).cast("date") for day in dates)
        stored = stored.where((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < F.date_add(last, 1)))
        lines = lines.join(stored, F.expr("l_orderkey = o_orderkey"), "left_semi")
    items = lines.groupBy("l_orderkey").agg(F.expr("sum(l_quantity) AS quantity"))
    words = " ".join(f"WHEN '{code}' THEN '{word}'" for word, code in STATUS_CODES.items())
    return stored.join(items, F.expr("o_orderkey = l_orderkey"), "left").selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS customer_id",
        "cast(o_orderdate as date) AS order_date",
        "o_totalprice AS amount",
        "coalesce(cast(quantity as bigint), 0L) AS item_count",
        "o_orderpriority AS category",
        f"CASE o_orderstatus {words} END AS status",
    )
