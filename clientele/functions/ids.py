"""Text form of numeric keys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID_WIDTH = 9
ID_PREFIXES = {"customer_id": "CUST_", "order_id": "ORD_"}


def public_id(key: str, prefix: str) -> str:
    """``prefix`` plus the key, zero-padded to nine digits and never cut short."""
    digits = f"cast({key} as string)"
    return f"concat('{prefix}', lpad({digits}, greatest({ID_WIDTH}, length({digits})), '0'))"


def with_public_ids(df: DataFrame) -> DataFrame:
    """Replace the key columns present by their text form.

    Joins, groupings and ranks run on the narrow numeric key; this belongs after them.
    """
    present = {c: F.expr(public_id(c, p)) for c, p in ID_PREFIXES.items() if c in df.columns}
    return df.withColumns(present)
