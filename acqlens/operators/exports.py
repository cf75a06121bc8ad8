"""BI export operators X1, X2, X4, X5 (X3 and X6 live with cohort / RFM),
the dashboard data operators D1-D5 and the S6 export writer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import SUM_MONEY, avg_round, month_start, pct2, rounded_ratio
from ..plans.broadcast import one_row
from ..sources.files import write_exports
from ..sources.model import Model
from .cohort import mart_channel_retention, pbi_cohort_retention
from .lattice import account_totals, channel_ledger
from .marts import reference_row
from .metrics import RECOMMENDATIONS, first_label, profitability_by_campaign
from .rfm import pbi_rfm_segments


def pbi_campaign_performance(m: Model) -> DataFrame:
    """Campaign grain export (unrounded-CAC LTV:CAC, like Q23)."""
    prof = profitability_by_campaign(m)
    dims = m.memo("x1_dims", lambda: m.campaigns.select("campaign_id", "objective", "start_date", "end_date"))
    return prof.join(dims, "campaign_id").select(
        "channel_name", "campaign_id", "campaign_name", "objective", "start_date", "end_date",
        "total_spend",
        F.col("lead_count").alias("leads"),
        F.col("converted_lead_count").alias("conversions"),
        F.col("acquired_customer_count").alias("customers_acquired"),
        "conversion_rate_pct", "cac",
        F.col("revenue_lifetime_to_date").alias("revenue_lifetime"),
        "roas_lifetime", "avg_ltv_lifetime", "ltv_cac_lifetime", "marketing_contribution",
    )


def pbi_channel_performance(m: Model) -> DataFrame:
    """One row per channel of the ledger; its recommendation compares unrounded values."""
    ltv, cac, spend, revenue = F.col("avg_ltv_lifetime"), F.col("cac"), F.col("total_spend"), F.col("revenue_lifetime_to_date")
    account_cac = rounded_ratio("account_spend", "account_customers", 2, 2, 0)
    pays = (revenue > spend) & (cac != 0)
    ratio = lambda a, b: rounded_ratio(a, b, 2, 2, 2)
    return channel_ledger(m).withColumn("cac", rounded_ratio(spend, "acquired_customer_count", 2, 2, 0)).select(
        "channel_name", "total_spend",
        F.col("lead_count").alias("leads"),
        F.col("converted_lead_count").alias("conversions"),
        pct2("converted_lead_count", "lead_count").alias("conversion_rate_pct"),
        F.col("acquired_customer_count").alias("customers_acquired"),
        "cac",
        F.col("revenue_in_campaign_window").alias("revenue_in_window"),
        revenue.alias("revenue_lifetime"),
        ratio("revenue_in_campaign_window", spend).alias("roas_in_window"),
        ratio(revenue, spend).alias("roas_lifetime"),
        "avg_ltv_lifetime", "avg_ltv_90d",
        ratio(ltv, cac).alias("ltv_cac_lifetime"),
        ratio("avg_ltv_90d", cac).alias("ltv_cac_90d"),
        (revenue - spend).cast(SUM_MONEY).alias("marketing_contribution"),
        "retention_month_1_pct", "retention_month_3_pct",
        first_label([label for label, _ in RECOMMENDATIONS],
                    pays & (ltv >= cac * 3) & (cac <= account_cac), pays & (ltv * 2 >= cac * 3), pays & (ltv >= cac)).alias("recommendation"),
    )


def pbi_executive_summary(m: Model) -> DataFrame:
    """One row of account-wide KPIs over the campaign facts; each input is a one-row aggregate."""
    customers = m.customers.agg(F.count(F.lit(1)).alias("total_customers"))
    return account_totals(m).crossJoin(one_row(customers)).crossJoin(reference_row(m)).select(
        "total_spend", "total_revenue",
        rounded_ratio("total_revenue", "total_spend", 2, 2, 2).alias("roas_lifetime"),
        rounded_ratio("total_spend", "acquired_customers", 2, 2, 0).alias("blended_cac"),
        avg_round("ltv_sum", "ltv_customers").alias("avg_ltv_lifetime"),
        (F.col("total_revenue") - F.col("total_spend")).cast(SUM_MONEY).alias("marketing_contribution"),
        "total_customers", F.col("reference_date").alias("data_as_of"),
    )


def pbi_monthly_trend(m: Model) -> DataFrame:
    """Calendar-month spend and (unattributed) revenue, 0-filled on both sides."""
    spend = m.daily_campaign_spend.groupBy(month_start("spend_date").alias("month")).agg(
        F.sum("spend_amount").cast(SUM_MONEY).alias("_spend"))
    revenue = m.orders.groupBy(month_start("order_date").alias("month")).agg(
        F.sum("order_amount").cast(SUM_MONEY).alias("_revenue"))
    zero = F.lit(0).cast(SUM_MONEY)
    return spend.join(revenue, "month", "full_outer").select(
        "month",
        F.coalesce("_spend", zero).alias("total_spend"),
        F.coalesce("_revenue", zero).alias("total_revenue"),
    )


# ---------------------------------------------------------------- dashboard data

# Example slicer selection used by the registered D3 query.
PAID_EXAMPLE = ("AMERICA", "ASIA", "Paid Search", "Paid Social")


def slice_channels(df: DataFrame, channels=None, column: str = "channel_name") -> DataFrame:
    """D3: the channel slicer - filter before any aggregation."""
    return df if not channels else df.where(F.col(column).isin(*channels))


def kpi_totals(m: Model) -> DataFrame:
    """Total Revenue, Total Spend and Marketing Contribution cards (SUM measures)."""
    return pbi_executive_summary(m).agg(
        F.sum("total_revenue").cast(SUM_MONEY).alias("total_revenue"),
        F.sum("total_spend").cast(SUM_MONEY).alias("total_spend"),
        F.sum("marketing_contribution").cast(SUM_MONEY).alias("marketing_contribution"),
    )


def blended_measures(m: Model, channels=None) -> DataFrame:
    """D2 (+D3): Blended CAC and Blended ROAS recomputed under a channel filter.

    Like DIVIDE(SUM, SUM): unrounded, NULL for a zero denominator.
    """
    df = slice_channels(pbi_channel_performance(m), channels).agg(
        F.sum("total_spend").cast("double").alias("_spend"),
        F.sum("customers_acquired").cast("double").alias("_cust"),
        F.sum("revenue_lifetime").cast("double").alias("_rev"),
    )
    return df.select(
        (F.col("_spend") / F.nullif(F.col("_cust"), F.lit(0.0))).alias("blended_cac"),
        (F.col("_rev") / F.nullif(F.col("_spend"), F.lit(0.0))).alias("blended_roas_lifetime"),
    )


def page_channel_table(m: Model) -> DataFrame:
    """Page 2 channel table columns."""
    return pbi_channel_performance(m).select(
        "channel_name", "total_spend", "conversion_rate_pct", "cac", "revenue_lifetime",
        "roas_lifetime", "avg_ltv_lifetime", "ltv_cac_lifetime", "marketing_contribution",
        "recommendation")


def page_channel_scatter(m: Model) -> DataFrame:
    """CAC vs LTV scatter (bubble size = customers acquired)."""
    return pbi_channel_performance(m).select("channel_name", "cac", "avg_ltv_lifetime", "customers_acquired")


def page_campaign_table(m: Model) -> DataFrame:
    """Campaign drill-down table."""
    return pbi_campaign_performance(m).select(
        "channel_name", "campaign_name", "total_spend", "cac", "roas_lifetime",
        "ltv_cac_lifetime", "marketing_contribution")


def export_frames(m: Model) -> dict[str, DataFrame]:
    """The seven objects the dashboard imports."""
    return {
        "pbi_executive_summary": pbi_executive_summary(m),
        "pbi_channel_performance": pbi_channel_performance(m),
        "pbi_campaign_performance": pbi_campaign_performance(m),
        "pbi_monthly_trend": pbi_monthly_trend(m),
        "pbi_cohort_retention": pbi_cohort_retention(m),
        "pbi_rfm_segments": pbi_rfm_segments(m),
        "mart_channel_retention": mart_channel_retention(m),
    }


def write_dashboard_exports(m: Model, directory: str, mode: str = "overwrite") -> None:
    """Write the seven export objects as Parquet folders."""
    write_exports(export_frames(m), directory, mode)


__all__ = [
    "pbi_campaign_performance", "pbi_channel_performance", "pbi_executive_summary",
    "pbi_monthly_trend", "kpi_totals", "blended_measures", "slice_channels",
    "page_channel_table", "page_channel_scatter", "page_campaign_table",
    "export_frames", "write_dashboard_exports",
]
