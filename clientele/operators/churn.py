"""Churn probability from a random forest.

The label is a rule over two of the features and the rows scored are the rows
trained on, so the percentage restates the rule smoothly rather than forecasts. Fitting
and scoring are apart, so that a model fitted once can score many frames.
"""

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.rules import one_decimal, risk_tier
from ..sources.staging import pin

# Bags are drawn in each partition of the training rows, so their number is part of the
# model: the same number gives the same forest. More rows have more of them to share the fit.
PARTITIONS = 8
ROWS_PER_PARTITION = 1_000_000
# Candidate thresholds per feature.
SPLIT_BINS = 128


class ChurnResult(NamedTuple):
    customers: DataFrame
    importances: DataFrame
    model: PipelineModel | None


def score_churn(
    frame: DataFrame,
    key: str = "customer_id",
    partitions: int | None = None,
    moderate_from: float = fv.MODERATE_FROM_PCT,
    high_from: float = fv.HIGH_FROM_PCT,
) -> ChurnResult:
    """Fit the forest on ``frame`` and add churn_risk_pct and churn_risk_level.

    ``frame`` is read a few times and should be staged.
    """
    return apply_churn(frame, fit_churn(frame, key, partitions), moderate_from, high_from)


def apply_churn(
    frame: DataFrame,
    model: PipelineModel | None,
    moderate_from: float = fv.MODERATE_FROM_PCT,
    high_from: float = fv.HIGH_FROM_PCT,
) -> ChurnResult:
    """Add churn_risk_pct and churn_risk_level by a fitted ``model``; without one all risks are 0."""
    if model is None:
        pct, weights = F.lit(0.0), [0.0] * len(fv.CHURN_FEATURES)
        scored = frame
    else:
        pct = vector_to_array("probability")[1] * 100.0
        weights = model.stages[-1].featureImportances.toArray().tolist()
        scored = model.transform(frame)
    customers = scored.select(*frame.columns, pct.alias("pct")).selectExpr(
        *frame.columns, f"{one_decimal('pct')} AS churn_risk_pct"
    )
    customers = customers.withColumn("churn_risk_level", F.expr(risk_tier(moderate_from=moderate_from, high_from=high_from)))
    importances = frame.sparkSession.createDataFrame(
        list(zip(fv.CHURN_FEATURES, weights)), "feature string, importance double"
    )
    return ChurnResult(customers, importances.orderBy("importance", "feature"), model)


def training_partitions(frame: DataFrame) -> int:
    """The parts that ``fit_churn`` lays ``frame`` out in: by its rows, so that a refit draws the same bags."""
    return max(PARTITIONS, -(-frame.count() // ROWS_PER_PARTITION))


def fit_churn(frame: DataFrame, key: str = "customer_id", partitions: int | None = None) -> PipelineModel | None:
    """The forest fitted on all rows of ``frame``, or None without rows.

    Features go in unscaled: a tree's splits are the same on any increasing function of
    a feature. The training rows are laid out by ``key`` in ``partitions`` parts, so a
    refit draws the same bags, and pinned, as the fit would shuffle anew for each pass.
    """
    if frame.isEmpty():
        return None
    partitions = partitions or training_partitions(frame)
    # The metadata says there are two classes even when only one occurs.
    label = F.col("is_churned_target").cast("double").alias("label", metadata={"ml_attr": {"type": "binary"}})
    laid_out = frame.select(key, "is_churned_target", *fv.CHURN_FEATURES).repartition(partitions, key)
    training = pin(laid_out.sortWithinPartitions(key)).select(label, *fv.CHURN_FEATURES)
    forest = RandomForestClassifier(
        numTrees=fv.FOREST_TREES,
        maxDepth=fv.FOREST_DEPTH,
        seed=fv.FOREST_SEED,
        impurity="gini",
        featureSubsetStrategy=str(fv.FOREST_FEATURES_PER_SPLIT),
        maxBins=SPLIT_BINS,
    )
    assembler = VectorAssembler(inputCols=list(fv.CHURN_FEATURES), outputCol="features")
    return Pipeline(stages=[assembler, forest]).fit(training)
