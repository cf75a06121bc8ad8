"""Named view registry (S5): one name per reference view / metric statement.

``OPERATORS`` maps each name to ``op(model) -> DataFrame``. ``register_views``
publishes them as session temp views so they can also be queried with
``spark.sql``. Views are lazy but for those that rank customers
(``mart_customer_rfm`` and what reads it, ``customer_revenue_ranked``,
``ltv_by_channel``): registering one of them runs its checkpoint and its
cut-key passes, so register by name what a session needs.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cohort, exports, legacy, marts, metrics, quality, rfm, staging
from ..sources.model import Model


def _source(name: str) -> Callable[[Model], DataFrame]:
    return lambda m: m.table(name)


OPERATORS: dict[str, Callable[[Model], DataFrame]] = {
    # The six model tables as scanned (through the driver adapter in tests)
    "source_channels": _source("channels"),
    "source_campaigns": _source("campaigns"),
    "source_daily_campaign_spend": _source("daily_campaign_spend"),
    "source_customers": _source("customers"),
    "source_leads": _source("leads"),
    "source_orders": _source("orders"),
    # G1-G2
    "stg_campaigns": staging.stg_campaigns,
    "stg_customers": staging.stg_customers,
    # M1-M10
    "mart_campaign_spend": marts.mart_campaign_spend,
    "mart_campaign_funnel": marts.mart_campaign_funnel,
    "mart_campaign_revenue": marts.mart_campaign_revenue,
    "mart_customer_revenue": marts.mart_customer_revenue,
    "mart_reference_date": marts.mart_reference_date,
    "mart_customer_cohort_spine": cohort.mart_customer_cohort_spine,
    "mart_customer_month_activity": cohort.mart_customer_month_activity,
    "mart_channel_retention": cohort.mart_channel_retention,
    "mart_customer_rfm": rfm.mart_customer_rfm,
    "mart_ltv_90d": marts.mart_ltv_90d,
    # Q1-Q29
    "funnel_by_campaign": metrics.funnel_by_campaign,
    "funnel_by_channel": metrics.funnel_by_channel,
    "funnel_totals": metrics.funnel_totals,
    "budget_allocation": metrics.budget_allocation,
    "cac_by_campaign": metrics.cac_by_campaign,
    "cac_by_channel": metrics.cac_by_channel,
    "performance_by_campaign": metrics.performance_by_campaign,
    "performance_by_channel": metrics.performance_by_channel,
    "cohort_retention": cohort.cohort_retention,
    "channel_retention_checkpoints": cohort.channel_retention_checkpoints,
    "channel_retention_grid": cohort.channel_retention_grid,
    "customer_revenue_ranked": metrics.customer_revenue_ranked,
    "customer_revenue_by_channel": metrics.customer_revenue_by_channel,
    "ltv_by_customer": metrics.ltv_by_customer,
    "ltv_by_channel": metrics.ltv_by_channel,
    "ltv_by_campaign": metrics.ltv_by_campaign,
    "ltv_90d_by_channel": metrics.ltv_90d_by_channel,
    "cohort_ltv_checkpoints": cohort.cohort_ltv_checkpoints,
    "ltv_cac_by_channel": metrics.ltv_cac_by_channel,
    "ltv_cac_by_campaign": metrics.ltv_cac_by_campaign,
    "contribution_by_campaign": metrics.contribution_by_campaign,
    "contribution_by_channel": metrics.contribution_by_channel,
    "profitability_by_campaign": metrics.profitability_by_campaign,
    "profitability_by_channel": metrics.profitability_by_channel,
    "rfm_segment_summary": rfm.rfm_segment_summary,
    "rfm_segment_by_channel": rfm.rfm_segment_by_channel,
    "rfm_sample": rfm.rfm_sample,
    "roas_by_campaign": metrics.roas_by_campaign,
    "roas_by_channel": metrics.roas_by_channel,
    # V1-V16
    "data_quality_checks": quality.data_quality_checks,
    "analytics_checks": quality.analytics_checks,
    "month0_retention_info": quality.month0_retention_info,
    "zero_customer_campaigns": quality.zero_customer_campaigns,
    "constraint_checks": quality.constraint_checks,
    # X1-X6
    "pbi_campaign_performance": exports.pbi_campaign_performance,
    "pbi_channel_performance": exports.pbi_channel_performance,
    "pbi_cohort_retention": cohort.pbi_cohort_retention,
    "pbi_executive_summary": exports.pbi_executive_summary,
    "pbi_monthly_trend": exports.pbi_monthly_trend,
    "pbi_rfm_segments": rfm.pbi_rfm_segments,
    # D1-D5
    "kpi_totals": exports.kpi_totals,
    "blended_measures": exports.blended_measures,
    "blended_measures_paid": lambda m: exports.blended_measures(m, exports.PAID_EXAMPLE),
    "page_channel_table": exports.page_channel_table,
    "page_channel_scatter": exports.page_channel_scatter,
    "page_campaign_table": exports.page_campaign_table,
    "retention_matrix": cohort.retention_matrix,
    "retention_matrix_by_year": cohort.retention_matrix_by_year,
    # L1-L8, S7, S8 over the legacy tables derived from the model
    "legacy_ltv_per_user": legacy.ltv_per_user,
    "legacy_top_converting_channel": legacy.top_converting_channel,
    "legacy_top_value_user": legacy.top_value_user,
    "legacy_loyalty_tiers": legacy.loyalty_tiers,
    "legacy_user_revenue_tiers": legacy.user_revenue_tiers,
    "legacy_churn_buckets": legacy.churn_buckets,
    "legacy_channel_profit": legacy.channel_profit,
    "legacy_cac": legacy.campaign_cac,
    "legacy_row_counts": legacy.row_counts,
    "legacy_campaigns": lambda m: legacy.legacy_tables(m)["campaigns"],
    "legacy_conversions": lambda m: legacy.legacy_tables(m)["conversions"],
    "legacy_daily_spend": lambda m: legacy.legacy_tables(m)["daily_spend"],
    "legacy_revenue": lambda m: legacy.legacy_tables(m)["revenue"],
    "legacy_users": lambda m: legacy.legacy_tables(m)["users"],
    "legacy_user_acquisition": lambda m: legacy.legacy_tables(m)["user_acquisition"],
}


def normalize(df: DataFrame) -> DataFrame:
    """Engine-neutral output types for comparisons: DECIMAL -> DOUBLE, small ints -> BIGINT,
    DATE -> ISO 'yyyy-MM-dd' string (engines and pandas disagree on date objects)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register_views(model: Model, names: list[str] | None = None) -> list[str]:
    """Create (or replace) a temp view per operator; returns the names registered."""
    done = []
    for name in names or list(OPERATORS):
        OPERATORS[name](model).createOrReplaceTempView(name)
        done.append(name)
    return done
