"""Parameterised filters, their option lists, and search."""

import datetime
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv

SEARCHED = ("name", "email", "customer_id")


def filter_customers(
    df: DataFrame,
    categories: Sequence[str] = (),
    tier: str = fv.ALL_TIERS,
    min_spent: float = 0.0,
) -> DataFrame:
    """Keep customers of the categories and tier that spent at least ``min_spent``.

    No categories means all of them; so does the tier "All".
    """
    if categories:
        df = df.where(F.col("preferred_category").isin(*categories))
    if tier != fv.ALL_TIERS:
        df = df.where(F.col("churn_risk_level") == tier)
    return df.where(F.col("total_spent") >= float(min_spent))


def filter_orders(
    orders: DataFrame,
    start: datetime.date | str | None = None,
    end: datetime.date | str | None = None,
) -> DataFrame:
    """Keep orders dated from ``start`` to ``end``, both included.

    Unless both are given nothing is filtered. Tables stored by month also skip the
    months outside.
    """
    if start is None or end is None:
        return orders
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    if "order_month" in orders.columns:
        orders = orders.where(F.col("order_month").between(F.trunc(first, "month"), last))
    return orders.where(F.col("order_date").cast("date").between(first, last))


def filter_options(orders: DataFrame, summary: DataFrame) -> DataFrame:
    """One row: first and last order date of any status, and the largest total spent."""
    spend = summary.selectExpr("max(total_spent)")
    dates = orders.selectExpr("min(order_date) AS min_order_date", "max(order_date) AS max_order_date")
    return dates.select("*", spend.scalar().alias("max_total_spent"))


def category_options(customers: DataFrame, column: str = "category") -> DataFrame:
    """Distinct categories in order."""
    return customers.select(column).distinct().orderBy(column)


def search_customers(df: DataFrame, term: str, literal: bool = False) -> DataFrame:
    """Keep customers whose name, email or id contains ``term``, in any case.

    The term is a Java regular expression unless ``literal``; an empty one keeps
    everybody, a malformed one raises ValueError before any task starts.
    """
    if not term:
        return df
    if literal:
        hit = _any_of(lambda c: F.contains(F.lower(c), F.lower(F.lit(term))))
    else:
        pattern = f"(?iU){term}"
        _check_pattern(df.sparkSession, pattern, term)
        hit = _any_of(lambda c: c.rlike(pattern))
    return df.where(hit)


def _any_of(test) -> Column:
    hit = F.lit(False)
    for name in SEARCHED:
        hit = hit | F.coalesce(test(F.col(name).cast("string")), F.lit(False))
    return hit


def _check_pattern(spark: SparkSession, pattern: str, term: str) -> None:
    try:
        spark.range(1).select(F.lit("").rlike(pattern)).collect()
    except Exception as error:
        if isinstance(error, PySparkException) or "PatternSyntaxException" in str(error):
            raise ValueError(f"not a valid search pattern: {term!r}") from error
        raise
