"""A shop whose summaries are kept up to date from new orders alone.

Each batch of orders is reduced to three small tables that add up: a row a customer, a row a
day, and bitmaps of buyers. A commit lists the folders that make up a version, so a refresh
writes one more part and never reads the orders, or the parts, of before; a reader adds the
parts up. ``compact`` turns them into one. Versions are numbered in a log where each number is taken once:
a batch is in a version whole or not at all, and once.
"""

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import from_units, ratio
from ..operators import activity
from ..operators.summary import YEAR_MONTH, customer_state, merged_state, summary_of_state
from ..sources import commits

VERSION = "version"


class ShopState:
    """The state of a shop under ``path``; ``number`` names a customer's number for the bitmaps."""

    def __init__(self, spark: SparkSession, path: str, number: str = "customer_id"):
        self.spark, self.path, self.number = spark, path.rstrip("/"), number

    # ---- versions

    def versions(self) -> list[int]:
        return commits.numbers(self.spark, self.path, VERSION)

    def entry(self, version: int | None = None) -> dict:
        """{parts, batches, key} of a version, by default the newest; empty before the first one."""
        found = self.versions()
        if version is None and not found:
            return {"parts": [], "batches": [], "key": None}
        return commits.read(self.spark, self.path, VERSION, found[-1] if version is None else version)

    def refresh(self, batch: str, orders: DataFrame) -> bool:
        """Add the orders of ``batch``; False where a version already holds a batch of this name.

        Orders must be new: a correction of old ones needs a new state. Two writers may refresh
        at once; whoever finds a number taken adds its part to the version that took it.
        """
        if batch in self.entry()["batches"]:
            return False
        part, key = f"part-{uuid.uuid4().hex}", dict(orders.dtypes)["customer_id"]
        self._write(part, customer_state(orders), activity.daily_sales(orders), activity.buyer_bitmaps(orders, self.number))

        def added(entry: dict) -> dict | None:
            if batch in entry["batches"]:
                return None
            if entry["key"] not in (None, key):
                raise TypeError(f"customer_id is {entry['key']} in earlier batches, {key} in {batch}")
            return {"parts": [*entry["parts"], part], "batches": [*entry["batches"], batch], "key": key}

        if self._publish(added):
            return True
        commits.remove(self.spark, f"{self.path}/{part}")
        return False

    def compact(self) -> bool:
        """Replace the parts of the newest version by their sum; parts added meanwhile stay beside it.

        Older versions keep their folders. False where there is nothing to join.
        """
        found = self.entry()
        old = found["parts"]
        if len(old) < 2:
            return False
        part = f"part-{uuid.uuid4().hex}"
        state, sales, bitmaps = (self._read(name, found) for name in ("customers", "sales", "buyers"))
        self._write(part, merged_state(state), activity.merged_sales(sales), activity.merged_bitmaps(bitmaps))

        def joined(entry: dict) -> dict | None:
            if not set(old) <= set(entry["parts"]):
                return None
            return entry | {"parts": [part, *[p for p in entry["parts"] if p not in old]]}

        if self._publish(joined):
            return True
        commits.remove(self.spark, f"{self.path}/{part}")
        return False

    def _publish(self, change: Callable[[dict], dict | None]) -> bool:
        while True:
            found = self.versions()
            entry = change(self.entry(found[-1] if found else None))
            if entry is None:
                return False
            try:
                commits.publish(self.spark, self.path, VERSION, found[-1] + 1 if found else 1, entry)
                return True
            except commits.Taken:
                continue

    # ---- parts

    def _write(self, part: str, state: DataFrame, sales: DataFrame, bitmaps: DataFrame) -> None:
        dates = {c: F.col(c).cast("date") for c in ("last_order_date", "first_order_date")}
        state.withColumns(dates).write.parquet(f"{self.path}/{part}/customers")
        sales.write.parquet(f"{self.path}/{part}/sales")
        # Sorted by start, a file's statistics let a range of days skip most of it.
        bitmaps.sortWithinPartitions("grain", "start").write.option("compression", "zstd").parquet(f"{self.path}/{part}/buyers")

    def _read(self, name: str, entry: dict) -> DataFrame:
        if not entry["parts"]:
            raise FileNotFoundError(f"no version under {self.path}")
        folders = [f"{self.path}/{part}/{name}" for part in entry["parts"]]
        return self.spark.read.schema(SCHEMAS[name].format(key=entry["key"])).parquet(*folders)

    # ---- answers

    def state(self, version: int | None = None) -> DataFrame:
        """One row a customer: what is kept of all orders of the version."""
        entry = self.entry(version)
        rows = self._read("customers", entry)
        return rows if len(entry["parts"]) == 1 else merged_state(rows)

    def summary(self, customers: DataFrame, version: int | None = None) -> DataFrame:
        """``customer_summary`` of all orders so far."""
        return summary_of_state(customers, self.state(version))

    def monthly_sales(self, version: int | None = None) -> DataFrame:
        """``monthly_sales`` of all orders so far."""
        entry = self.entry(version)
        months = self._read("sales", entry).groupBy(F.expr("trunc(day, 'month') AS month"))
        months = months.agg(*[F.expr(f"sum({c}) AS {c}") for c in ("orders", "amounts", "high", "low")])
        buyers = activity.trend_of_bitmaps(self._read("sales", entry), self._read("buyers", entry))
        revenue = from_units("high", "low")
        return (
            months.selectExpr(YEAR_MONTH, f"{revenue} AS monthly_revenue", "orders AS total_orders", "amounts")
            .join(buyers.select("year_month", F.col("unique_customers").alias("active_customers")), "year_month")
            .selectExpr("year_month", "monthly_revenue", "total_orders", "active_customers",
                        f"{ratio('monthly_revenue', 'amounts')} AS avg_order_amount")
            .orderBy("year_month")
        )

    def monthly_trend(
        self, start: datetime.date | str | None = None, end: datetime.date | str | None = None, version: int | None = None
    ) -> DataFrame:
        """``monthly_trend`` of a range of days, exact, without reading an order."""
        entry = self.entry(version)
        return activity.trend_of_bitmaps(self._read("sales", entry), self._read("buyers", entry), start, end)

    def active_customers(
        self, start: datetime.date | str | None = None, end: datetime.date | str | None = None, version: int | None = None
    ) -> DataFrame:
        return activity.active_customers(self._read("buyers", self.entry(version)), start, end)


SCHEMAS = {
    "customers": "customer_id {key}, completed long, spent_high long, spent_low long, amounts long, "
    "last_order_date date, first_order_date date, returned long",
    "sales": "day date, orders long, amounts long, high long, low long",
    "buyers": "grain string, start date, bucket long, buyers binary",
}
