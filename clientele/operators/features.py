"""Recency, frequency and monetary features of customer summaries."""

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv


def snapshot_date(summary: DataFrame) -> DataFrame:
    """One row: the day after the last completed order of anybody, or the fallback."""
    last = "max(cast(last_order_date as date))"
    return summary.selectExpr(
        f"coalesce(date_add({last}, 1), date '{fv.FALLBACK_SNAPSHOT}') AS snapshot_date"
    )


def rfm_features(
    summary: DataFrame,
    snapshot: datetime.date | str,
    never_ordered_days: int = fv.NEVER_ORDERED_DAYS,
) -> DataFrame:
    """Add recency_days, frequency, monetary and tenure_days as of ``snapshot``, a date or its ISO text."""
    if isinstance(snapshot, str):
        snapshot = datetime.date.fromisoformat(snapshot)
    never_ordered_days = int(never_ordered_days)
    since_order = f"datediff(date '{snapshot}', cast(last_order_date as date))"
    since_join = f"datediff(date '{snapshot}', cast(join_date as date))"
    features = {
        "recency_days": f"greatest(0, coalesce({since_order}, {never_ordered_days}))",
        "frequency": "coalesce(total_orders, 0L)",
        "monetary": "coalesce(total_spent, 0D)",
        "avg_order_value": "coalesce(avg_order_value, 0D)",
        "returned_orders": "coalesce(returned_orders, 0L)",
        "tenure_days": f"greatest(1, coalesce({since_join}, {fv.UNKNOWN_TENURE_DAYS}))",
    }
    return summary.withColumns({name: F.expr(text) for name, text in features.items()})


# What is ranked, as SQL expressions; larger is better, so the most recent customer ranks last.
RFM_MEASURES = {"R_score": "-recency_days", "F_score": "frequency", "M_score": "monetary"}


def scale_features(df: DataFrame, columns=fv.CHURN_FEATURES) -> DataFrame:
    """Add ``<column>_scaled`` with mean 0 and population deviation 1; 0 for a constant.

    The moments are one row of numbers, read once; the scaling is a projection.
    """
    moments = df.selectExpr(*[f"avg({c})" for c in columns], *[f"stddev_pop({c})" for c in columns]).first()
    scaled = {}
    for c, mean, std in zip(columns, moments, moments[len(columns) :]):
        scaled[f"{c}_scaled"] = (F.col(c) - mean) / std if std else F.lit(0.0)
    return df.withColumns(scaled)
