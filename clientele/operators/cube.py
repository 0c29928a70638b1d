"""Filtered KPIs and charts from a cube of the scored customers, without reading them again.

The filters pick categories, a tier and a least spend; KPIs, segments and heatmap cells are
sums over the customers picked. The cube holds these sums for every grouping that a
question needs, by steps of spend, and running from the highest step down: the sum over all
customers of a group that spent at least a step is one row of it.
"""

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.money import from_units, ratio, unit_sums
from .charts import label_axes

SPEND_STEP = 50.0
DIMENSIONS = ("preferred_category", "churn_risk_level", "rfm_segment", "R_score", "F_score")
# What is grouped beside category and tier for each kind of question.
QUESTIONS = {"kpis": (), "segments": ("rfm_segment",), "heatmap": ("R_score", "F_score")}

# Sums of a cell; the percentage has one decimal, so its tenths are whole.
_high, _low = unit_sums("total_spent")
MEASURES = {
    "customers": "count(*)",
    "spenders": "count(total_spent)",
    "spent_high": _high,
    "spent_low": _low,
    "order_values": "sum(avg_order_value)",
    "order_valued": "count(avg_order_value)",
    "tenths": "sum(cast(rint(churn_risk_pct * 10D) as bigint))",
    "rated": "count(churn_risk_pct)",
}


def filter_cube(customers: DataFrame, step: float = SPEND_STEP) -> DataFrame:
    """question, the dimensions, step and the sums of the customers of a group from that step of spend on.

    ``customers`` are scored ones, read once. A grouping has a row for each step that
    occurs in it; the window that runs over the steps has one group's steps to sort, never
    customers.
    """
    stepped = customers.where("total_spent IS NOT NULL").withColumn("step", F.floor(F.col("total_spent") / step).cast("bigint"))
    grouped = ["preferred_category", "churn_risk_level", "step"]
    sets = [[*grouped, *extra] for extra in QUESTIONS.values()]
    cells = stepped.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*DIMENSIONS, "step")])
    cells = cells.agg(
        F.grouping("rfm_segment").alias("no_segment"),
        F.grouping("R_score").alias("no_score"),
        *[F.expr(f"{text} AS {name}") for name, text in MEASURES.items()],
    )
    question = F.when(F.col("no_segment") == 0, "segments").when(F.col("no_score") == 0, "heatmap").otherwise("kpis")
    down = f"OVER (PARTITION BY question, {', '.join(DIMENSIONS)} ORDER BY step DESC)"
    return cells.withColumn("question", question).select(
        "question", *DIMENSIONS, "step", *[F.expr(f"sum({name}) {down} AS {name}") for name in MEASURES]
    )


class FilteredCube:
    """Answers from a cube (stored or staged) under any categories, tier and least spend.

    ``customers`` is read only where the least spend lies between two steps, and then only the
    customers of that one step, by a filter that reaches the scan.
    """

    def __init__(self, cube: DataFrame, customers: DataFrame | None = None, step: float = SPEND_STEP):
        self.cube, self.customers, self.step = cube, customers, step

    def _sums(self, question: str, categories: Sequence[str], tier: str, min_spent: float) -> DataFrame:
        """The sums of a question's groups under the filters, one row a group and (category, tier)."""
        first = math.ceil(min_spent / self.step)
        own = self.cube.where((F.col("question") == question) & (F.col("step") >= first))
        group = ["preferred_category", "churn_risk_level", *QUESTIONS[question]]
        # The row of the lowest step that is left sums all above.
        lowest = own.groupBy(*group).agg(F.min_by(F.struct(*MEASURES), "step").alias("sums")).select(*group, "sums.*")
        if first * self.step > min_spent:
            lowest = lowest.unionByName(self._edge(group, min_spent, first))
        if categories:
            lowest = lowest.where(F.col("preferred_category").isin(*categories))
        if tier != fv.ALL_TIERS:
            lowest = lowest.where(F.col("churn_risk_level") == tier)
        return lowest

    def _edge(self, group: list[str], min_spent: float, first: int) -> DataFrame:
        if self.customers is None:
            raise ValueError(f"{min_spent} lies between two steps of {self.step}: pass the customers, too")
        # The step that holds the least spend, found as the cube found it.
        spent = F.col("total_spent")
        inside = (spent >= float(min_spent)) & (spent < first * self.step) & (F.floor(spent / self.step) < first)
        edge = self.customers.where(inside)
        return edge.groupBy(*group).agg(*[F.expr(f"{text} AS {name}") for name, text in MEASURES.items()])

    def kpis(self, categories: Sequence[str] = (), tier: str = fv.ALL_TIERS, min_spent: float = 0.0) -> DataFrame:
        """``kpis`` of the customers that ``filter_customers`` keeps."""
        sums = self._sums("kpis", categories, tier, min_spent).selectExpr(
            "sum(spent_high) AS high",
            "sum(spent_low) AS low",
            "coalesce(sum(customers), 0L) AS customers",
            f"coalesce({ratio('sum(order_values)', 'sum(order_valued)')}, 0D) AS avg_order_value",
            f"coalesce(sum(customers) FILTER (WHERE churn_risk_level = '{fv.HIGH_RISK}'), 0L) AS high_risk_customers",
        )
        return sums.selectExpr(
            f"coalesce({from_units('high', 'low')}, 0D) AS total_revenue",
            "customers",
            "avg_order_value",
            "high_risk_customers",
            f"coalesce({ratio('high_risk_customers', 'customers')} * 100, 0D) AS high_risk_pct",
        )

    def segments(self, categories: Sequence[str] = (), tier: str = fv.ALL_TIERS, min_spent: float = 0.0) -> DataFrame:
        """rfm_segment, count, avg_total_spent: both segment charts, most customers first."""
        total = from_units("sum(spent_high)", "sum(spent_low)")
        sums = self._sums("segments", categories, tier, min_spent).groupBy("rfm_segment")
        found = sums.agg(
            F.expr("sum(customers) AS count"), F.expr(f"{ratio(total, 'sum(spenders)')} AS avg_total_spent")
        )
        return found.orderBy(F.desc("count"), "rfm_segment")

    def heatmap(self, categories: Sequence[str] = (), tier: str = fv.ALL_TIERS, min_spent: float = 0.0) -> DataFrame:
        """The mean risk by R_score and F_score, cells without customers 0, rows and columns as ``label_axes`` names them."""
        sums = self._sums("heatmap", categories, tier, min_spent)
        mean = F.expr(f"{ratio('sum(tenths)', 'sum(rated)')} / 10D")
        matrix = sums.groupBy("R_score").pivot("F_score", [1, 2, 3, 4]).agg(mean).na.fill(0.0).orderBy("R_score")
        return label_axes(matrix)
