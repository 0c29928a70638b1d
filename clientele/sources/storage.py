"""Bulk load of the model tables and CSV export."""

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.gate import REFUSED, admit
from . import commits
from .schema import CUSTOMERS, ORDERS, conform

MONTH = "order_month"
MANIFEST = "load"


def load_tables(
    customers: DataFrame, orders: DataFrame, path: str, force: bool = False, gate: bool = False
) -> int | None:
    """Write both tables under ``path``; a complete load already there stays unless ``force``.

    Every load writes new folders and, last, a manifest that names them; its number is
    returned, or None where a load was there. Readers follow
    the newest manifest, so a load cut short is not seen, and a forced one does
    not touch files that somebody reads. Older versions stay until they are removed.
    A manifest number is taken by one writer: of two first loads the later one removes what it
    wrote, of two forced ones it takes the next number.

    With ``gate`` rows that break a constraint go to a quarantine table of the same commit
    instead (``operators.gate``); without it they are loaded as they are, and text that is
    no valid date or number fails the load.

    Orders are laid out by month so that date filters prune folders. The rebalance hint
    gives each month a few files of even size and splits a month that is too large for
    one task, which needs adaptive execution.
    """
    spark = customers.sparkSession
    loads = commits.numbers(spark, path, MANIFEST)
    if loads and not force:
        return None
    version = uuid.uuid4().hex
    entry = {name: f"{name}-{version}" for name in ("customers", "orders", *(["quarantine"] if gate else []))}
    if gate:
        customers, orders, refused = admit(customers, orders)
        refused.write.parquet(f"{path}/{entry['quarantine']}")
    conform(customers, CUSTOMERS).write.parquet(f"{path}/{entry['customers']}")
    by_month = conform(orders, ORDERS).withColumn(MONTH, F.trunc("order_date", "month"))
    by_month.hint("rebalance", MONTH).write.partitionBy(MONTH).parquet(f"{path}/{entry['orders']}")
    number = max(loads, default=0) + 1
    while True:
        try:
            commits.publish(spark, path, MANIFEST, number, entry)
            return number
        except commits.Taken:
            if not force and commits.numbers(spark, path, MANIFEST):
                for folder in entry.values():
                    commits.remove(spark, f"{path}/{folder}")
                return None
            number += 1


def read_tables(spark: SparkSession, path: str, load: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The (customers, orders) of a load, by default the newest; orders keep ``order_month`` for pruning."""
    entry = _manifest(spark, path, load)
    stored = T.StructType([*ORDERS, T.StructField(MONTH, T.DateType())])
    return (
        spark.read.schema(CUSTOMERS).parquet(f"{path}/{entry['customers']}"),
        spark.read.schema(stored).parquet(f"{path}/{entry['orders']}"),
    )


def read_quarantine(spark: SparkSession, path: str, load: int | None = None) -> DataFrame:
    """The rows that a load refused (table_name, row_key, reasons, row); none for a load without a gate."""
    entry = _manifest(spark, path, load)
    if "quarantine" not in entry:
        return spark.createDataFrame([], REFUSED)
    return spark.read.schema(REFUSED).parquet(f"{path}/{entry['quarantine']}")


def _manifest(spark: SparkSession, path: str, load: int | None) -> dict:
    loads = commits.numbers(spark, path, MANIFEST)
    if not loads or (load is not None and load not in loads):
        raise FileNotFoundError(f"no complete load under {path}")
    return commits.read(spark, path, MANIFEST, max(loads) if load is None else load)


def export_csv(df: DataFrame, folder: str, day: datetime.date | None = None, run: str = "") -> str:
    """Write ``df`` as CSV part files and return the folder, which carries the day's date and ``run``.

    An export of that name that is already there is an error, not replaced.
    """
    day = day or datetime.date.today()
    target = f"{folder.rstrip('/')}/churn_risk_report_{day:%Y%m%d}" + (f"_{run}" if run else "")
    # Doubling quotes is how RFC 4180 readers expect a quote inside a field.
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(target)
    return target
