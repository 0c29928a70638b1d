"""The constraints of the model tables as a gate: rows that break one are set apart with their reasons.

Keys are unique and not null, every declared column holds a value of its type, status and
category (where given) come from their domains, and an order's customer is an admitted one.
All rows of a key that several rows hold are refused, as none of them can be told to be the
right one; orders of refused customers are refused in turn.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..sources.schema import CUSTOMERS, ORDERS
from ..sources.staging import stage
from .joins import HIDDEN, member_filter, with_maybe

REFUSED = "table_name string, row_key string, reasons array<string>, row string"
_REASONS = "gate_reasons"


def admit(
    customers: DataFrame,
    orders: DataFrame,
    statuses: Sequence[str] = fv.STATUSES,
    categories: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(customers, orders, refused): the rows that keep all constraints, typed, and the others.

    A refused row has its table, its key as text, its sorted reasons and itself as JSON. Reasons
    are ``null <column>``, ``not a <type>: <column>``, ``repeated key``, ``outside of domain: <column>``
    and ``no such customer``. The keys at fault are found first, from the keys alone, and go to the
    rows as bitmaps of a fixed size: only rows that may hold one move, for the joins that
    decide. The judged rows are staged, so that what is admitted and what is refused read them there. Runs jobs.
    """
    twice = _repeated(customers, CUSTOMERS, "customer_id")
    domains = {"category": categories} if categories else {}
    found_customers = _judged(customers, CUSTOMERS, domains, [("customer_id", twice, "repeated key")])
    good = _admitted(found_customers, CUSTOMERS)
    # Orders are reduced to the ids they name before these meet the customers.
    named = orders.select(_typed(ORDERS["customer_id"])).where("customer_id IS NOT NULL").distinct()
    missing = stage(named.join(good.select("customer_id"), "customer_id", "left_anti"), "gate-missing")
    faults = [("order_id", _repeated(orders, ORDERS, "order_id"), "repeated key"), ("customer_id", missing, "no such customer")]
    found_orders = _judged(orders, ORDERS, {"status": statuses}, faults)
    refused = _refused(found_customers, "customers", "customer_id").unionByName(
        _refused(found_orders, "orders", "order_id")
    )
    return good, _admitted(found_orders, ORDERS), refused


def _typed(field: T.StructField) -> Column:
    return F.expr(f"try_cast({field.name} as {field.dataType.simpleString()})").alias(field.name)


def _repeated(df: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    """The keys that several rows hold, staged."""
    keys = df.select(_typed(schema[key])).where(f"{key} IS NOT NULL")
    return stage(keys.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "gate-repeated")


def _judged(
    df: DataFrame, schema: T.StructType, domains: Mapping[str, Sequence[str]], faults: Sequence[tuple[str, DataFrame, str]]
) -> DataFrame:
    """The declared columns cast where they can be, the row as JSON where it may be refused, and the reasons against it.

    A fault is a column, its values (once each) that are refused, and the reason.
    """
    row = F.to_json(F.struct(*[F.col(f.name) for f in schema]), {"ignoreNullFields": "false"})
    typed, reasons = [_typed(field) for field in schema], []
    for field, value in zip(schema, typed):
        kind, stored = field.dataType.simpleString(), F.col(field.name)
        reasons.append(F.when(stored.isNull(), F.lit(f"null {field.name}")))
        reasons.append(F.when(stored.isNotNull() & value.isNull(), F.lit(f"not a {kind}: {field.name}")))
        if field.name in domains:
            outside = ~stored.cast("string").isin(*domains[field.name])
            reasons.append(F.when(outside, F.lit(f"outside of domain: {field.name}")))
    against = F.array_compact(F.array(*reasons))
    rows, maybe = df.select(*[f.name for f in schema]), F.lit(False)
    for i, (column, keys, _) in enumerate(faults):
        key = f"gate_key_{i}"
        rows = with_maybe(rows.withColumn(key, _typed(schema[column])), key, member_filter(keys.withColumnRenamed(column, key), key))
        rows = rows.drop(key).withColumnRenamed(HIDDEN + "maybe", f"gate_maybe_{i}")
        maybe = maybe | F.col(f"gate_maybe_{i}")
    kept = F.when(maybe | (F.size(against) > 0), row).alias("gate_row")
    judged = stage(rows.select(*typed, kept, against.alias(_REASONS), maybe.alias("gate_maybe")), "gate-judged")
    asked = judged.where("gate_maybe")
    for column, keys, reason in faults:
        added = F.when(F.col("gate_fault"), F.array_append(_REASONS, F.lit(reason))).otherwise(F.col(_REASONS))
        asked = asked.join(keys.withColumn("gate_fault", F.lit(True)), column, "left").withColumn(_REASONS, added).drop("gate_fault")
    return judged.where("NOT gate_maybe").unionByName(asked)


def _admitted(judged: DataFrame, schema: T.StructType) -> DataFrame:
    return judged.where(F.size(_REASONS) == 0).select(*[f.name for f in schema])


def _refused(judged: DataFrame, table: str, key: str) -> DataFrame:
    return judged.where(F.size(_REASONS) > 0).select(
        F.lit(table).alias("table_name"),
        F.col(key).cast("string").alias("row_key"),
        F.array_sort(_REASONS).alias("reasons"),
        F.col("gate_row").alias("row"),
    )
