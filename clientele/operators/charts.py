"""KPIs and chart datasets over customer frames."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.money import as_count, as_dollars, as_percent, exact_sum, ratio
from ..functions.rules import recency_label


def kpis(df: DataFrame, risk: bool = True) -> DataFrame:
    """One row: revenue, customers, mean order value and, with ``risk``, the high-risk part.

    The mean counts every customer once, those without orders as 0. An empty
    selection gives zeros.
    """
    row = df.selectExpr(
        f"coalesce({exact_sum('total_spent')}, 0D) AS total_revenue",
        "count(*) AS customers",
        "coalesce(avg(avg_order_value), 0D) AS avg_order_value",
        *([f"count_if(churn_risk_level = '{fv.HIGH_RISK}') AS high_risk_customers"] if risk else []),
    )
    if not risk:
        return row
    share = f"coalesce({ratio('high_risk_customers', 'customers')} * 100, 0D)"
    return row.withColumn("high_risk_pct", F.expr(share))


def kpis_display(row: DataFrame) -> DataFrame:
    """The KPI row as the text shown to people."""
    shown = {
        "total_revenue": as_dollars("total_revenue"),
        "customers": as_count("customers"),
        "avg_order_value": as_dollars("avg_order_value"),
    }
    if "high_risk_pct" in row.columns:
        shown["high_risk_customers"] = "cast(high_risk_customers as string)"
        shown["high_risk_pct"] = as_percent("high_risk_pct")
    return row.withColumns({name: F.expr(text) for name, text in shown.items()})


def segment_counts(df: DataFrame) -> DataFrame:
    """Customers per segment, most first."""
    return df.groupBy("rfm_segment").count().orderBy(F.desc("count"), "rfm_segment")


def segment_spend(df: DataFrame) -> DataFrame:
    """Mean total spent per segment, least first."""
    mean = ratio(exact_sum("total_spent"), "count(total_spent)")
    spend = df.groupBy("rfm_segment").agg(F.expr(f"{mean} AS avg_total_spent"))
    return spend.orderBy("avg_total_spent", "rfm_segment")


def heatmap(
    df: DataFrame, index: str, columns: str, value: str, values: Sequence | None = None
) -> DataFrame:
    """Matrix of the mean of ``value``; cells without rows are 0.

    Columns are the ones observed, which costs a pass over ``df``, or ``values``.
    """
    pivoted = df.groupBy(index).pivot(columns, list(values) if values else None)
    return pivoted.agg(F.avg(value)).na.fill(0.0).orderBy(index)


def label_axes(matrix: DataFrame, index: str = "R_score") -> DataFrame:
    """Name the columns F<score> and the rows after their recency score."""
    scores = [c for c in matrix.columns if c != index]
    return matrix.selectExpr(f"{recency_label(index)} AS {index}", *[f"`{c}` AS F{c}" for c in scores])
