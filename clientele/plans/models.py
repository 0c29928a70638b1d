"""Fitted churn models kept with what they were fitted for, and refused for anything else."""

import datetime
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed_values as fv
from ..operators.churn import ChurnResult, PARTITIONS, SPLIT_BINS, apply_churn
from ..operators.forest import NODES, forest_nodes
from ..sources import commits

KIND = "model"


class ModelMismatch(ValueError):
    """A model is asked for what it was not fitted for."""


def save_churn(
    model: PipelineModel | None,
    spark: SparkSession,
    path: str,
    snapshot: datetime.date | str,
    table_version: int | None = None,
    after_days: int = fv.CHURN_AFTER_DAYS,
    after_days_if_rare: int = fv.CHURN_AFTER_DAYS_IF_RARE,
    rare_orders: int = fv.RARE_ORDERS,
    partitions: int = PARTITIONS,
) -> int:
    """Keep ``model`` (None: fitted on no rows) and its manifest under ``path``; returns its number.

    The manifest has the features in their order, the thresholds of the label, the snapshot and the
    load its rows came from, and the settings of the fit. The nodes lie beside the model as a table.
    """
    folder = None
    if model is not None:
        folder = f"churn-{uuid.uuid4().hex}"
        model.write().save(f"{path}/{folder}/pipeline")
        nodes = forest_nodes(model, f"{path}/{folder}/forest")
        nodes.write.parquet(f"{path}/{folder}/nodes")
    manifest = {
        "folder": folder,
        "features": list(model.stages[0].getInputCols()) if model else list(fv.CHURN_FEATURES),
        "label": {"after_days": after_days, "after_days_if_rare": after_days_if_rare, "rare_orders": rare_orders},
        "snapshot": str(snapshot),
        "table_version": table_version,
        "fit": {"trees": fv.FOREST_TREES, "depth": fv.FOREST_DEPTH, "seed": fv.FOREST_SEED, "bins": SPLIT_BINS, "partitions": partitions},
    }
    found = commits.numbers(spark, path, KIND)
    number = max(found, default=0) + 1
    while True:
        try:
            commits.publish(spark, path, KIND, number, manifest)
            return number
        except commits.Taken:
            number += 1


class SavedChurn:
    """A kept model, by default the newest under ``path``."""

    def __init__(self, spark: SparkSession, path: str, number: int | None = None):
        found = commits.numbers(spark, path, KIND)
        if not found or (number is not None and number not in found):
            raise FileNotFoundError(f"no model under {path}")
        self.spark, self.path = spark, path
        self.manifest = commits.read(spark, path, KIND, found[-1] if number is None else number)

    def model(self) -> PipelineModel | None:
        folder = self.manifest["folder"]
        return PipelineModel.load(f"{self.path}/{folder}/pipeline") if folder else None

    def nodes(self) -> DataFrame:
        """The node table; empty for a model of no rows."""
        if self.manifest["folder"] is None:
            return self.spark.createDataFrame([], NODES)
        return self.spark.read.schema(NODES).parquet(f"{self.path}/{self.manifest['folder']}/nodes")

    def check(self, frame: DataFrame, snapshot: datetime.date | str | None = None, table_version: int | None = None, **label) -> None:
        """Raise ``ModelMismatch`` unless the model fits ``frame`` and what else is given.

        ``label`` holds thresholds of the churn label that the caller goes by.
        """
        wrong = []
        if tuple(self.manifest["features"]) != tuple(fv.CHURN_FEATURES):
            wrong.append(f"features {self.manifest['features']}")
        numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
        kinds = dict(frame.dtypes)
        wrong += [f"column {c}: {kinds.get(c, 'missing')}" for c in self.manifest["features"] if kinds.get(c) not in numbers]
        wrong += [f"{k} {self.manifest['label'].get(k)}, not {v}" for k, v in label.items() if self.manifest["label"].get(k) != v]
        if snapshot is not None and str(snapshot) != self.manifest["snapshot"]:
            wrong.append(f"snapshot {self.manifest['snapshot']}, not {snapshot}")
        if table_version is not None and table_version != self.manifest["table_version"]:
            wrong.append(f"table version {self.manifest['table_version']}, not {table_version}")
        if wrong:
            raise ModelMismatch("the model was fitted for " + "; ".join(wrong))

    def apply(self, frame: DataFrame, snapshot: datetime.date | str | None = None, table_version: int | None = None, **label) -> ChurnResult:
        """``apply_churn`` after ``check``."""
        self.check(frame, snapshot, table_version, **label)
        return apply_churn(frame, self.model())
