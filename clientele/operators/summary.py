"""Customer summary, monthly sales and the denormalised order fact."""

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.money import exact_sum, from_units, ratio, unit_sums
from .filters import filter_orders
from .joins import hot_keys, join_to_unique


# What is kept of a customer's orders: parts of it, from any split of the orders, add up.
STATE = {
    "completed": "sum",
    "spent_high": "sum",
    "spent_low": "sum",
    "amounts": "sum",
    "last_order_date": "max",
    "first_order_date": "min",
    "returned": "sum",
}


def customer_state(orders: DataFrame) -> DataFrame:
    """customer_id and the STATE columns of every customer with completed or returned orders."""
    done, returned = f"status = '{fv.COMPLETED}'", f"status = '{fv.RETURNED}'"
    done_amount, done_date = (f"CASE WHEN {done} THEN {c} END" for c in ("amount", "order_date"))
    high, low = unit_sums(done_amount)
    measures = [f"count_if({done})", high, low, f"count({done_amount})", f"max({done_date})", f"min({done_date})"]
    measures.append(f"count_if({returned})")
    return (
        orders.where(f"{done} OR {returned}")
        .groupBy("customer_id")
        .agg(*[F.expr(f"{text} AS {name}") for name, text in zip(STATE, measures)])
    )


def merged_state(parts: DataFrame) -> DataFrame:
    """One row per customer from any number of partial ones."""
    return parts.groupBy("customer_id").agg(*[F.expr(f"{how}({name}) AS {name}") for name, how in STATE.items()])


def summary_of_state(customers: DataFrame, state: DataFrame) -> DataFrame:
    """The customer summary from a merged state."""
    spent = from_units("spent_high", "spent_low")
    return customers.join(state, "customer_id", "left").selectExpr(
        "customer_id",
        "name",
        "email",
        "category AS preferred_category",
        "country",
        "join_date",
        "coalesce(completed, 0L) AS total_orders",
        f"coalesce({spent}, 0D) AS total_spent",
        f"coalesce({ratio(spent, 'amounts')}, 0D) AS avg_order_value",
        "last_order_date",
        "first_order_date",
        "coalesce(returned, 0L) AS returned_orders",
    )


def customer_summary(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per customer, with or without orders.

    Orders are reduced to one row per customer before the join, so only that row
    crosses it however many orders a customer has; ``customer_id`` must be unique
    in ``customers``.
    """
    return summary_of_state(customers, customer_state(orders))


def _by_month(orders: DataFrame) -> DataFrame:
    # Months are grouped as dates; text is made for the few result rows only.
    measures = {
        "revenue": exact_sum("amount"),
        "orders": "count(order_id)",
        "amounts": "count(amount)",
        "buyers": "count(DISTINCT customer_id)",
    }
    return (
        orders.where(f"status = '{fv.COMPLETED}'")
        .groupBy(F.expr("trunc(order_date, 'month') AS month"))
        .agg(*[F.expr(f"{text} AS {name}") for name, text in measures.items()])
    )


YEAR_MONTH = "date_format(month, 'yyyy-MM') AS year_month"


def monthly_sales(orders: DataFrame) -> DataFrame:
    """Completed revenue, orders, distinct buyers and mean amount per month."""
    months = _by_month(orders).selectExpr(
        YEAR_MONTH,
        "revenue AS monthly_revenue",
        "orders AS total_orders",
        "buyers AS active_customers",
        f"{ratio('revenue', 'amounts')} AS avg_order_amount",
    )
    return months.orderBy("year_month")


def monthly_trend(
    orders: DataFrame,
    start: datetime.date | str | None = None,
    end: datetime.date | str | None = None,
) -> DataFrame:
    """The monthly chart: revenue, orders and distinct buyers of a date range."""
    months = _by_month(filter_orders(orders, start, end)).selectExpr(
        YEAR_MONTH, "coalesce(revenue, 0D) AS revenue", "orders", "buyers AS unique_customers"
    )
    return months.orderBy("year_month")


def order_details(
    customers: DataFrame,
    orders: DataFrame,
    ordered: bool = True,
    split_hot: bool = True,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Every order with its customer's attributes, newest first.

    ``split_hot`` looks for customers with too many orders for one task and spreads
    them, which runs a count and a sample scan before this returns; pass ``hot``, a
    result of ``hot_keys``, to use known ones. ``ordered=False`` saves the sort of the
    whole fact.
    """
    if hot is None and split_hot:
        hot = hot_keys(orders, "customer_id")
    attributes = customers.selectExpr(
        "customer_id", "name AS customer_name", "category AS customer_category", "country"
    )
    facts = orders.withColumnRenamed("category", "product_category")
    joined = join_to_unique(facts, attributes, "customer_id", "order_id", hot).select(
        "order_id",
        "customer_id",
        "customer_name",
        "customer_category",
        "country",
        "order_date",
        "amount",
        "item_count",
        "product_category",
        "status",
    )
    return joined.orderBy(F.desc("order_date"), "order_id") if ordered else joined
