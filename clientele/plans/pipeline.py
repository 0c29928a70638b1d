"""The jobs that chain the operators: customer value, churn and the dashboard load."""

import datetime
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.rules import churned, segment
from ..operators.churn import ChurnResult, score_churn
from ..operators.features import RFM_MEASURES, rfm_features, snapshot_date
from ..operators.ranking import quartile_cuts, quartile_score
from ..operators.summary import customer_summary, monthly_sales, order_details
from ..sources.catalogue import Catalogue
from ..sources.staging import stage


def staged_features(
    summary: DataFrame,
    snapshot: datetime.date | str | None = None,
    never_ordered_days: int = fv.NEVER_ORDERED_DAYS,
    staged: bool = False,
) -> DataFrame:
    """RFM features over a summary written once, since several passes follow.

    Pass ``staged=True`` for a summary that is cheap to read again, such as a table.
    """
    base = summary if staged else stage(summary, "summary")
    if snapshot is None:
        snapshot = snapshot_date(base).first()[0]
    return rfm_features(base, snapshot, never_ordered_days)


def with_scores(features: DataFrame) -> DataFrame:
    """Add R_score, F_score and M_score, 1 to 4, over all rows of ``features``."""
    cuts = quartile_cuts(features, RFM_MEASURES, "customer_id")
    scores = {
        name: F.expr(quartile_score(measure, "customer_id", cuts[name])) for name, measure in RFM_MEASURES.items()
    }
    return features.withColumns(scores)


def rfm(
    summary: DataFrame,
    snapshot: datetime.date | str | None = None,
    never_ordered_days: int = fv.NEVER_ORDERED_DAYS,
    staged: bool = False,
    after_days: int = fv.CHURN_AFTER_DAYS,
    after_days_if_rare: int = fv.CHURN_AFTER_DAYS_IF_RARE,
    rare_orders: int = fv.RARE_ORDERS,
) -> DataFrame:
    """Features, scores, segment and churn label of every customer.

    Finding the snapshot and the score cuts runs jobs; the frame returned is a
    projection of the staged summary.
    """
    scored = with_scores(staged_features(summary, snapshot, never_ordered_days, staged))
    label = churned(after_days=after_days, after_days_if_rare=after_days_if_rare, rare_orders=rare_orders)
    return scored.withColumns({"rfm_segment": F.expr(segment()), "is_churned_target": F.expr(label)})


def rfm_and_churn(
    summary: DataFrame,
    snapshot: datetime.date | str | None = None,
    never_ordered_days: int = fv.NEVER_ORDERED_DAYS,
    staged: bool = False,
    moderate_from: float = fv.MODERATE_FROM_PCT,
    high_from: float = fv.HIGH_FROM_PCT,
    **label,
) -> ChurnResult:
    """``rfm`` followed by the churn model; ``label`` holds the thresholds of the churn label."""
    frame = rfm(summary, snapshot, never_ordered_days, staged, **label)
    return score_churn(frame, moderate_from=moderate_from, high_from=high_from)


class Dashboard(NamedTuple):
    customers: DataFrame
    monthly: DataFrame
    orders: DataFrame
    importances: DataFrame


def load_dashboard(
    customers: DataFrame, orders: DataFrame, catalogue: Catalogue | None = None, version: str = "1"
) -> Dashboard:
    """All frames of the dashboard, the scored customers staged for reuse.

    Call it again to refresh; frames of an earlier call stay as they were. With a ``catalogue`` a
    call finds what an earlier one, of any session, made of the same ``version`` of the tables, runs no
    job and recomputes once that has expired.
    """
    churn: list[ChurnResult] = []

    def fitted() -> ChurnResult:
        if not churn:
            churn.append(rfm_and_churn(customer_summary(customers, orders)))
        return churn[0]

    parts: dict[str, Callable[[], DataFrame]] = {
        "scored": lambda: fitted().customers,
        "monthly": lambda: monthly_sales(orders),
        "importances": lambda: fitted().importances,
    }
    if catalogue is None:
        found = {"scored": stage(parts["scored"](), "scored"), "monthly": parts["monthly"](), "importances": parts["importances"]()}
    else:
        found = {name: catalogue.get(name, version, build) for name, build in parts.items()}
        found["monthly"] = found["monthly"].orderBy("year_month")
        found["importances"] = found["importances"].orderBy("importance", "feature")
    return Dashboard(
        found["scored"], found["monthly"], order_details(customers, orders, ordered=False, split_hot=catalogue is None), found["importances"]
    )
