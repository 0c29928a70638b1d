"""A forest as data: its nodes as a table, importances and scores from that table.

A fitted forest has a bounded number of nodes (trees times 2^(depth + 1)), whatever it was
fitted on, so its scores can be one SQL expression, which needs no model at hand.
"""

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.rules import one_decimal

# node 0 is a tree's root; left takes values up to the threshold; a leaf has no feature.
NODES = (
    "tree int, node int, left int, right int, feature string, threshold double, gain double, rows bigint, "
    "stayed double, churned double"
)


def forest_nodes(model: PipelineModel, folder: str) -> DataFrame:
    """One row per node of the fitted forest, which is saved under ``folder`` on the way.

    ``stayed`` and ``churned`` are the rows of either class in the node, as its bag weighs them.
    """
    forest, features = model.stages[-1], model.stages[0].getInputCols()
    forest.save(folder)
    spark = SparkSession.getActiveSession()
    stored = spark.read.parquet(f"{folder.rstrip('/')}/data")
    names = F.array(*[F.lit(f) for f in features])
    node, split = F.col("nodeData"), F.col("nodeData.split")
    inner = node["leftChild"] >= 0
    return stored.select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        F.when(inner, node["leftChild"]).alias("left"),
        F.when(inner, node["rightChild"]).alias("right"),
        F.when(inner, F.get(names, split["featureIndex"])).alias("feature"),
        F.when(inner, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner, node["gain"]).alias("gain"),
        node["rawCount"].alias("rows"),
        F.get(node["impurityStats"], F.lit(0)).alias("stayed"),
        F.get(node["impurityStats"], F.lit(1)).alias("churned"),
    )


def node_importances(nodes: DataFrame, features: Sequence[str] = fv.CHURN_FEATURES) -> DataFrame:
    """(feature, importance), least first: the gains of a tree's splits weighed by their rows, each tree
    brought to 1, all trees together to 1; 0 for a feature that nothing splits."""
    spark = nodes.sparkSession
    every = spark.createDataFrame([(f,) for f in features], "feature string")
    gains = nodes.where("feature IS NOT NULL").groupBy("tree", "feature")
    gains = gains.agg(F.expr("sum(gain * (stayed + churned)) AS gain"))
    shares = gains.selectExpr("feature", "try_divide(gain, sum(gain) OVER (PARTITION BY tree)) AS share")
    totals = shares.groupBy("feature").agg(F.sum("share").alias("share"))
    known = every.join(totals, "feature", "left").selectExpr("feature", "coalesce(share, 0D) AS share")
    whole = known.agg(F.sum("share").alias("whole"))
    importance = F.expr("coalesce(try_divide(share, whole), 0D) AS importance")
    return known.crossJoin(F.broadcast(whole)).select("feature", importance).orderBy("importance", "feature")


def probability_sql(nodes: Sequence[Row]) -> str:
    """The churn probability as an SQL expression over the feature columns.

    A tree is a CASE over its splits that ends in the number of a leaf, whose shares of both classes are looked
    up; trees are added in their order, as the model itself does.
    """
    trees: dict[int, dict[int, Row]] = {}
    for row in nodes:
        trees.setdefault(row["tree"], {})[row["node"]] = row
    if not trees:
        return "0D"
    stayed, churned = [], []
    for _, tree in sorted(trees.items()):
        leaves: list[Row] = []
        place = _place(tree, 0, leaves)
        for sums, name in ((stayed, "stayed"), (churned, "churned")):
            shares = ", ".join(_double(r[name] / (r["stayed"] + r["churned"])) for r in leaves)
            sums.append(f"element_at(array({shares}), {place})")
    total, risk = (" + ".join(s) for s in (stayed, churned))
    return f"({risk}) / (({total}) + ({risk}))"


def _place(tree: dict[int, Row], node: int, leaves: list[Row]) -> str:
    row = tree[node]
    if row["feature"] is None:
        leaves.append(row)
        return str(len(leaves))
    left, right = (_place(tree, row[side], leaves) for side in ("left", "right"))
    return f"CASE WHEN {row['feature']} <= {_double(row['threshold'])} THEN {left} ELSE {right} END"


def _double(x: float) -> str:
    return f"cast('{x!r}' as double)"


def score_by_nodes(frame: DataFrame, nodes: DataFrame) -> DataFrame:
    """``frame`` with churn_risk_pct from a node table, to the last bit what the model gives.

    The nodes, a bounded number, come to the driver; the frame is only projected.
    """
    risk = probability_sql(nodes.collect())
    return frame.withColumn("churn_risk_pct", F.expr(one_decimal(f"({risk}) * 100D")))
