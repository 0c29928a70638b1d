"""Declared types of the two model tables."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

CUSTOMERS = T.StructType(
    [
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("email", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("join_date", T.DateType(), False),
        T.StructField("country", T.StringType(), False),
    ]
)

# item_count is 64 bit: the quantities of one very large order may pass 2**31.
ORDERS = T.StructType(
    [
        T.StructField("order_id", T.StringType(), False),
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("order_date", T.DateType(), False),
        T.StructField("amount", T.DoubleType(), False),
        T.StructField("item_count", T.LongType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the declared columns and cast each; ISO text becomes a date, bad text fails."""
    return df.selectExpr(*[f"cast({f.name} as {f.dataType.simpleString()}) AS {f.name}" for f in schema])
