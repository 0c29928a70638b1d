"""Fixed rules: business decisions as SQL expressions over column names; first match wins in every chain."""

from . import fixed_values as fv


def segment(r: str = "R_score", f: str = "F_score", m: str = "M_score") -> str:
    """Customer segment from the three scores; 3 and 4 count as high."""
    return f"""CASE
        WHEN {r} >= 3 AND {f} >= 3 AND {m} >= 3 THEN '{fv.CHAMPIONS}'
        WHEN {f} >= 3 AND {m} >= 3 THEN '{fv.LOYAL}'
        WHEN {r} >= 3 AND {f} <= 2 THEN '{fv.PROMISING}'
        WHEN {r} <= 2 AND {f} >= 3 THEN '{fv.AT_RISK}'
        WHEN {r} <= 2 AND {f} <= 2 THEN '{fv.HIBERNATING}'
        ELSE '{fv.NEEDS_ATTENTION}' END"""


def churned(
    recency: str = "recency_days",
    frequency: str = "frequency",
    after_days: int = fv.CHURN_AFTER_DAYS,
    after_days_if_rare: int = fv.CHURN_AFTER_DAYS_IF_RARE,
    rare_orders: int = fv.RARE_ORDERS,
) -> str:
    """1 for a customer gone quiet, 0 otherwise. Rare buyers count sooner."""
    rare = f"{recency} > {after_days_if_rare} AND {frequency} <= {rare_orders}"
    return f"CASE WHEN {recency} > {after_days} OR ({rare}) THEN 1 ELSE 0 END"


def risk_tier(
    pct: str = "churn_risk_pct",
    moderate_from: float = fv.MODERATE_FROM_PCT,
    high_from: float = fv.HIGH_FROM_PCT,
) -> str:
    """Tier of a rounded churn percentage; lower bounds belong to the higher tier."""
    return f"""CASE
        WHEN {pct} < {moderate_from}D THEN '{fv.LOW_RISK}'
        WHEN {pct} < {high_from}D THEN '{fv.MODERATE_RISK}'
        ELSE '{fv.HIGH_RISK}' END"""


def recommended_action(tier: str = "churn_risk_level", segment_: str = "rfm_segment") -> str:
    """What to do about a customer; a high risk outranks the segment."""
    return f"""CASE
        WHEN {tier} = '{fv.HIGH_RISK}' THEN '{fv.WIN_BACK}'
        WHEN {segment_} = '{fv.AT_RISK}' THEN '{fv.VIP_OUTREACH}'
        WHEN {segment_} = '{fv.CHAMPIONS}' THEN '{fv.LOYALTY_CLUB}'
        WHEN {tier} = '{fv.MODERATE_RISK}' THEN '{fv.RE_ENGAGE}'
        ELSE '{fv.STANDARD}' END"""


def one_decimal(x: str) -> str:
    """Round to one decimal, halves to the even digit."""
    return f"rint(({x}) * 10D) / 10D"


def recency_label(score: str = "R_score") -> str:
    """Heatmap row label of a recency score."""
    named = " ".join(f"WHEN {value} THEN '{text}'" for value, text in fv.HEATMAP_ROW_LABELS.items())
    return f"CASE {score} {named} ELSE concat('R', {score}) END"
