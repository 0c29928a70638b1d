"""Table contracts: each check returns the violations it found, none when all is well."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, rows) for every key held by more than one row."""
    return df.groupBy(key).agg(F.expr("count(*) AS rows")).where("rows > 1")


def orphan_keys(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """(key, rows) for every non-null key of ``child`` that ``parent`` lacks.

    Child rows are counted per key first, so a hot key crosses the join as one row.
    """
    counted = child.where(f"{key} IS NOT NULL").groupBy(key).agg(F.expr("count(*) AS rows"))
    return counted.join(parent.select(key), key, "left_anti")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nulls), one row per column, from a single pass."""
    counts = ", ".join(f"'{c}', count_if({c} IS NULL)" for c in columns)
    return df.selectExpr(f"map({counts}) AS counts").selectExpr("explode(counts) AS (column, nulls)")


def unexpected_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """(value, rows) for every non-null value outside ``allowed``."""
    return (
        df.where(~F.col(column).isin(*allowed))
        .groupBy(F.col(column).alias("value"))
        .agg(F.expr("count(*) AS rows"))
    )
