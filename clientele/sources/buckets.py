"""Orders and customers stored in buckets by customer, so that no join or grouping by customer moves rows.

Both tables are hashed by customer_id into the same number of buckets and sorted inside. A
customer with more orders than a task should take would make its bucket too long; its orders
lie apart, unbucketed, and meet its one row by a broadcast of the few such customers.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import ROWS_PER_TASK, hot_keys
from . import commits
from .schema import CUSTOMERS, ORDERS

KEY = "customer_id"
BUCKETED = "buckets"


def load_bucketed(customers: DataFrame, orders: DataFrame, path: str, buckets: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Write both tables under ``path`` in ``buckets`` buckets and return the number of the load.

    customer_id must be of the same type in both and unique in ``customers``; choose ``buckets`` so that one
    holds a task's worth of orders. Every row is moved once, here. Runs jobs, a count and a sample
    among them to find the customers set apart.
    """
    spark = customers.sparkSession
    kind = dict(customers.dtypes)[KEY]
    if dict(orders.dtypes)[KEY] != kind:
        raise TypeError("customer_id has two types")
    version = uuid.uuid4().hex
    customers = customers.selectExpr(*[_cast(f, kind) for f in CUSTOMERS])
    orders = orders.selectExpr(*[_cast(f, kind) for f in ORDERS])
    hot = hot_keys(orders, KEY, rows_per_task)
    entry = {"buckets": buckets, "key": kind, "order_key": dict(orders.dtypes)["order_id"], "hot": None}
    if hot is not None:
        # A task of its own for each piece of a hot customer, by a hash that a retry repeats.
        entry["hot"] = f"hot-orders-{version}"
        orders.join(hot.select(KEY), KEY, "left_semi").write.parquet(f"{path}/{entry['hot']}")
        orders = orders.join(hot.select(KEY), KEY, "left_anti")
    for name, df in (("customers", customers), ("orders", orders)):
        entry[name] = f"{name}-{version}"
        # Dealt by the hash of the buckets, so that a task writes one file.
        dealt = df.repartition(buckets, KEY).write.bucketBy(buckets, KEY).sortBy(KEY)
        table = _table(f"{name}_{version}")
        dealt.format("parquet").option("path", f"{path}/{entry[name]}").saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # the name only: files of a table with a path stay
    found = commits.numbers(spark, path, BUCKETED)
    number = max(found, default=0) + 1
    while True:
        try:
            commits.publish(spark, path, BUCKETED, number, entry)
            return number
        except commits.Taken:
            number += 1


class Buckets:
    """The newest bucketed load under ``path``: its tables, and the two joins by customer."""

    def __init__(self, spark: SparkSession, path: str, load: int | None = None):
        found = commits.numbers(spark, path, BUCKETED)
        if not found:
            raise FileNotFoundError(f"no bucketed load under {path}")
        self.spark, self.path = spark, path
        self.entry = commits.read(spark, path, BUCKETED, load or found[-1])

    def customers(self) -> DataFrame:
        return self._stored("customers", CUSTOMERS)

    def orders(self) -> DataFrame:
        """Orders of all customers but those set apart."""
        return self._stored("orders", ORDERS)

    def hot_orders(self) -> DataFrame | None:
        """Orders of the customers set apart, or None."""
        if self.entry["hot"] is None:
            return None
        return self.spark.read.schema(self._columns(ORDERS)).parquet(f"{self.path}/{self.entry['hot']}")

    def by_customer(self, function) -> DataFrame:
        """``function(customers, orders)`` over both tables, where each customer's rows decide its own result.

        Joins and groupings by customer_id inside run over the buckets as they lie. Customers set apart, of
        which there are at most orders / rows_per_task, are done beside them.
        """
        hot = self.hot_orders()
        if hot is None:
            return function(self.customers(), self.orders())
        few = F.broadcast(hot.select(KEY).distinct())
        most = function(self.customers().join(few, KEY, "left_anti"), self.orders())
        return most.unionByName(function(F.broadcast(self.customers().join(few, KEY, "left_semi")), hot))

    def _columns(self, schema) -> str:
        kinds = {KEY: self.entry["key"], "order_id": self.entry["order_key"]}
        return ", ".join(f"{f.name} {kinds.get(f.name, f.dataType.simpleString())}" for f in schema)

    def _stored(self, name: str, schema) -> DataFrame:
        """The files as a table of this session, which is how Spark learns of their buckets."""
        table = _table(self.entry[name].replace("-", "_"))
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({self._columns(schema)}) USING parquet "
            f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {self.entry['buckets']} BUCKETS "
            f"LOCATION '{self.path}/{self.entry[name]}'"
        )
        return self.spark.table(table)


def _cast(field, kind: str) -> str:
    # Keys keep the type they come with.
    if field.name in (KEY, "order_id"):
        return field.name
    return f"cast({field.name} as {field.dataType.simpleString()}) AS {field.name}"


def _table(name: str) -> str:
    return f"clientele_{name}"
