"""Words, thresholds and defaults that results depend on.

They are contract, not tuning: changing one changes what a customer is called
in a report.
"""

import datetime

# Order states.
COMPLETED = "Completed"
RETURNED = "Returned"
CANCELLED = "Cancelled"
STATUSES = (COMPLETED, RETURNED, CANCELLED)

# Customer segments.
CHAMPIONS = "Champions"
LOYAL = "Loyal Customers"
PROMISING = "Promising / New"
AT_RISK = "At-Risk VIPs"
HIBERNATING = "Hibernating / Lost"
NEEDS_ATTENTION = "Needs Attention"

# Churn risk tiers, and the word that switches the tier filter off.
LOW_RISK = "Low Risk"
MODERATE_RISK = "Moderate Risk"
HIGH_RISK = "High Churn Risk"
ALL_TIERS = "All"

# Recommended actions.
WIN_BACK = "🚨 Urgent: 25% Off Win-back Promo"
VIP_OUTREACH = "⭐ VIP Personal Outreach & Gift"
LOYALTY_CLUB = "💎 Invite to Exclusive Loyalty Club"
RE_ENGAGE = "📧 Re-engagement Email Campaign"
STANDARD = "✅ Retain via Standard Engagement"

# Features of the churn model, in model order.
CHURN_FEATURES = (
    "recency_days",
    "frequency",
    "monetary",
    "avg_order_value",
    "returned_orders",
    "tenure_days",
)

# Report columns and their display headings.
REPORT_HEADINGS = {
    "customer_id": "Customer ID",
    "name": "Customer Name",
    "email": "Email",
    "preferred_category": "Category",
    "country": "Country",
    "total_orders": "Total Orders",
    "total_spent": "Total Spent ($)",
    "recency_days": "Recency (Days)",
    "rfm_segment": "RFM Segment",
    "churn_risk_pct": "Churn Risk %",
    "churn_risk_level": "Risk Level",
    "recommended_action": "Recommended Action",
}

# Heatmap row labels of the lowest and highest recency score.
HEATMAP_ROW_LABELS = {1: "R1 (Inactive)", 4: "R4 (Active)"}

# Defaults of the feature and churn rules.
FALLBACK_SNAPSHOT = datetime.date(2026, 7, 25)
NEVER_ORDERED_DAYS = 999
UNKNOWN_TENURE_DAYS = 30
CHURN_AFTER_DAYS = 90
CHURN_AFTER_DAYS_IF_RARE = 60
RARE_ORDERS = 2
MODERATE_FROM_PCT = 35.0
HIGH_FROM_PCT = 70.0

# Shape of the churn forest. Two of six features are tried per
# split (the whole part of the square root of six).
FOREST_TREES = 100
FOREST_DEPTH = 5
FOREST_SEED = 42
FOREST_FEATURES_PER_SPLIT = 2
