"""The customer risk report: who is at risk and what to do about it."""

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.money import as_count, as_dollars, as_percent, plain
from ..functions.rules import recommended_action
from ..sources.storage import export_csv


def risk_report(df: DataFrame) -> DataFrame:
    """The report columns of a scored frame and the recommended action."""
    return df.withColumn("recommended_action", F.expr(recommended_action())).select(*fv.REPORT_HEADINGS)


def with_headings(report: DataFrame) -> DataFrame:
    """The report under its display headings (not valid as parquet names)."""
    return report.toDF(*[fv.REPORT_HEADINGS[c] for c in report.columns])


def report_display(report: DataFrame) -> DataFrame:
    """The report with headings and its numbers as the text shown to people."""
    shown = {
        "total_spent": as_dollars("total_spent"),
        "churn_risk_pct": as_percent("churn_risk_pct"),
        "total_orders": as_count("total_orders"),
        "recency_days": as_count("recency_days"),
    }
    return with_headings(report.withColumns({name: F.expr(text) for name, text in shown.items()}))


def export_report(report: DataFrame, folder: str, day: datetime.date | None = None, run: str = "") -> str:
    """Write the report as CSV with headings and unformatted numbers; returns the folder written."""
    numbers = {
        "total_spent": F.expr(plain("total_spent", 2)),
        "churn_risk_pct": F.expr(plain("churn_risk_pct", 1)),
    }
    return export_csv(with_headings(report.withColumns(numbers)), folder, day, run)
