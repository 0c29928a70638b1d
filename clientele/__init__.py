"""Customer value and churn analytics as PySpark DataFrame operators."""

from .operators.activity import active_customers, buyer_bitmaps, customer_numbers, daily_sales, trend_of_bitmaps
from .operators.charts import heatmap, kpis, kpis_display, label_axes, segment_counts, segment_spend
from .operators.checks import duplicate_keys, null_counts, orphan_keys, unexpected_values
from .operators.churn import ChurnResult, apply_churn, fit_churn, score_churn, training_partitions
from .operators.cube import FilteredCube, filter_cube
from .operators.features import RFM_MEASURES, rfm_features, scale_features, snapshot_date
from .operators.filters import (
    category_options,
    filter_customers,
    filter_options,
    filter_orders,
    search_customers,
)
from .operators.forest import forest_nodes, node_importances, probability_sql, score_by_nodes
from .operators.gate import admit
from .operators.joins import hot_keys, join_to_unique
from .operators.ranking import global_ranks, quartile_cuts, quartile_score
from .operators.report import export_report, report_display, risk_report, with_headings
from .operators.search_index import gram_sizes, indexed_search, search_index, store_index
from .operators.summary import (
    customer_state,
    customer_summary,
    merged_state,
    monthly_sales,
    monthly_trend,
    order_details,
    summary_of_state,
)
from .plans.models import ModelMismatch, SavedChurn, save_churn
from .plans.pipeline import Dashboard, load_dashboard, rfm, rfm_and_churn, staged_features, with_scores
from .plans.refresh import ShopState
from .sources.buckets import Buckets, load_bucketed
from .sources.catalogue import Catalogue
from .sources.staging import stage
from .sources.storage import export_csv, load_tables, read_quarantine, read_tables

__all__ = [
    "active_customers",
    "admit",
    "apply_churn",
    "Buckets",
    "buyer_bitmaps",
    "Catalogue",
    "category_options",
    "ChurnResult",
    "customer_numbers",
    "customer_state",
    "customer_summary",
    "daily_sales",
    "Dashboard",
    "duplicate_keys",
    "export_csv",
    "export_report",
    "filter_cube",
    "filter_customers",
    "filter_options",
    "filter_orders",
    "FilteredCube",
    "fit_churn",
    "forest_nodes",
    "global_ranks",
    "gram_sizes",
    "heatmap",
    "hot_keys",
    "indexed_search",
    "join_to_unique",
    "kpis",
    "kpis_display",
    "label_axes",
    "load_bucketed",
    "load_dashboard",
    "load_tables",
    "merged_state",
    "ModelMismatch",
    "monthly_sales",
    "monthly_trend",
    "node_importances",
    "null_counts",
    "order_details",
    "orphan_keys",
    "probability_sql",
    "quartile_cuts",
    "quartile_score",
    "read_quarantine",
    "read_tables",
    "report_display",
    "rfm",
    "rfm_and_churn",
    "rfm_features",
    "RFM_MEASURES",
    "risk_report",
    "save_churn",
    "SavedChurn",
    "scale_features",
    "score_by_nodes",
    "score_churn",
    "search_customers",
    "search_index",
    "segment_counts",
    "segment_spend",
    "ShopState",
    "snapshot_date",
    "stage",
    "staged_features",
    "store_index",
    "summary_of_state",
    "training_partitions",
    "trend_of_bitmaps",
    "unexpected_values",
    "with_headings",
    "with_scores",
]
