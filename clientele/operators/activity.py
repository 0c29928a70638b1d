"""Buyers of any range of days as bitmaps, and sales by day, both of which add up over parts.

A distinct count can't be taken from counts of parts, but a union of bitmaps can: one bit a
customer number, 32,768 numbers to a bitmap of 4 KB. Bitmaps are kept per day and per month,
so that a range reads whole months and, at its two ends, days.
"""

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.money import from_units, unit_sums
from .ranking import global_ranks
from .summary import YEAR_MONTH

DAY, MONTH = "day", "month"


def daily_sales(orders: DataFrame) -> DataFrame:
    """day, orders, amounts and the two sums of the amounts, of completed orders."""
    high, low = unit_sums("amount")
    return (
        orders.where(f"status = '{fv.COMPLETED}'")
        .groupBy(F.expr("cast(order_date as date) AS day"))
        .agg(
            F.count("order_id").alias("orders"),
            F.count("amount").alias("amounts"),
            F.expr(f"{high} AS high"),
            F.expr(f"{low} AS low"),
        )
    )


def buyer_bitmaps(orders: DataFrame, number: str = "customer_id") -> DataFrame:
    """grain, start, bucket, buyers: the customers with completed orders of each day and month.

    ``number`` is an integer that tells customers apart, best without gaps (``customer_numbers``).
    Each row gives its bit once a day; months are made of the days' bitmaps.
    """
    days = (
        orders.where(f"status = '{fv.COMPLETED}' AND {number} IS NOT NULL")
        .selectExpr("cast(order_date as date) AS start", f"cast({number} as bigint) AS number")
        .groupBy("start", F.expr("bitmap_bucket_number(number) AS bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(number)) AS buyers"))
    )
    return days.selectExpr(f"'{DAY}' AS grain", "start", "bucket", "buyers").unionByName(monthly_bitmaps(days))


def monthly_bitmaps(days: DataFrame) -> DataFrame:
    months = days.groupBy(F.expr("trunc(start, 'month') AS start"), "bucket").agg(F.expr("bitmap_or_agg(buyers) AS buyers"))
    return months.selectExpr(f"'{MONTH}' AS grain", "start", "bucket", "buyers")


def merged_bitmaps(parts: DataFrame) -> DataFrame:
    return parts.groupBy("grain", "start", "bucket").agg(F.expr("bitmap_or_agg(buyers) AS buyers"))


def merged_sales(parts: DataFrame) -> DataFrame:
    return parts.groupBy("day").agg(*[F.expr(f"sum({c}) AS {c}") for c in ("orders", "amounts", "high", "low")])


def _within(bitmaps: DataFrame, start, end) -> DataFrame:
    """The fewest bitmaps that make up the days from ``start`` to ``end``; all months without both."""
    if start is None or end is None:
        return bitmaps.where(F.col("grain") == MONTH)
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    at = F.col("start")
    whole = (F.trunc(at, "month") >= first) & (F.last_day(at) <= last)
    # Stated for the scan: bitmaps that begin elsewhere are not read.
    near = at.between(F.trunc(first, "month"), last)
    return bitmaps.where(near & F.when(F.col("grain") == MONTH, whole).otherwise(~whole & at.between(first, last)))


def trend_of_bitmaps(
    sales: DataFrame,
    bitmaps: DataFrame,
    start: datetime.date | str | None = None,
    end: datetime.date | str | None = None,
) -> DataFrame:
    """The monthly chart of a range, as ``monthly_trend`` gives it, without reading an order."""
    if start is not None and end is not None:
        sales = sales.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    by_month = sales.groupBy(F.expr("trunc(day, 'month') AS month")).agg(
        F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("orders").alias("orders")
    )
    buyers = _within(bitmaps, start, end).groupBy(F.expr("trunc(start, 'month') AS month"), "bucket")
    buyers = buyers.agg(F.expr("bitmap_count(bitmap_or_agg(buyers)) AS n")).groupBy("month").agg(F.sum("n").alias("n"))
    return (
        by_month.join(buyers, "month", "left")
        .selectExpr(YEAR_MONTH, f"coalesce({from_units('high', 'low')}, 0D) AS revenue", "orders", "coalesce(n, 0L) AS unique_customers")
        .orderBy("year_month")
    )


def active_customers(
    bitmaps: DataFrame, start: datetime.date | str | None = None, end: datetime.date | str | None = None
) -> DataFrame:
    """One row: the customers with a completed order in the whole range."""
    merged = _within(bitmaps, start, end).groupBy("bucket").agg(F.expr("bitmap_count(bitmap_or_agg(buyers)) AS n"))
    return merged.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("active_customers"))


def customer_numbers(customers: DataFrame, key: str = "customer_id", known: DataFrame | None = None) -> DataFrame:
    """(key, customer_no): numbers from 1 without gaps in the order of the keys.

    Customers that ``known`` numbers keep theirs and new ones follow after the largest.
    """
    keys = customers.select(key).where(f"{key} IS NOT NULL").distinct()
    if known is None:
        return global_ranks(keys, {"customer_no": "0"}, key)
    most = known.agg(F.max("customer_no")).first()[0] or 0
    new = global_ranks(keys.join(known, key, "left_anti"), {"customer_no": "0"}, key)
    return known.select(key, "customer_no").unionByName(new.select(key, (F.col("customer_no") + most).alias("customer_no")))
