"""Metric operators Q1-Q8, Q13-Q17, Q19-Q24, Q28-Q29 and Q4.

Channel and account tables are sums over the roll-up lattice (``lattice``): one
grouping of spend, leads and customers by campaign, summed upwards. Campaign tables join
campaign-grain inputs (M1-M3, stg_campaigns), which the campaign dimension bounds;
customer-grain inputs are reduced to campaign grain by a partial + final aggregate
before any join. Every operator returns an unsorted DataFrame; pass ``sort=True`` for the
reference's presentation order (explicit null placement everywhere).

Ratios use the exact helpers of ``acqlens.functions.exprs``. Channel ratios
divide sums (never average campaign ratios); averages are sum / count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import SUM_MONEY, avg_round, pct2, rounded_ratio
from ..sources.model import Model
from .lattice import FUNNEL, REVENUE, SPEND, WINDOWS, campaign_facts, channel_ledger, channel_sums
from .marts import (mart_campaign_funnel, mart_campaign_revenue, mart_campaign_spend,
                    mart_customer_revenue, reference_row, stg_customer_facts)
from .staging import stg_campaigns


def _money_ratio(num, den):
    return rounded_ratio(num, den, 2, 2, 2)


def _per_customer(num, den):
    """money / count, e.g. CAC."""
    return rounded_ratio(num, den, 2, 2, 0)


def _cac() -> F.Column:
    return _per_customer("total_spend", "acquired_customer_count").alias("cac")


def _roas_lifetime() -> F.Column:
    return _money_ratio("revenue_lifetime_to_date", "total_spend").alias("roas_lifetime")


def _contribution() -> F.Column:
    return (F.col("revenue_lifetime_to_date") - F.col("total_spend")).cast(SUM_MONEY).alias("marketing_contribution")


def _unrounded_cac_ratio(ltv, spend, customers):
    """round(ltv / nullif(spend / nullif(customers, 0), 0), 2) evaluated exactly."""
    return F.when(customers != 0, rounded_ratio(ltv * customers, spend, 2, 2, 2))


def campaign_join(m: Model, spend=False, funnel=False, revenue=False) -> DataFrame:
    """stg_campaigns inner-joined to the requested campaign marts (T7: drops campaigns)."""
    df = stg_campaigns(m)
    if spend:
        df = df.join(mart_campaign_spend(m), "campaign_id")
    if funnel:
        df = df.join(mart_campaign_funnel(m), "campaign_id")
    if revenue:
        df = df.join(mart_campaign_revenue(m).drop("channel_id"), "campaign_id")
    return df


def _order(df: DataFrame, sort: bool, *cols) -> DataFrame:
    return df.orderBy(*cols) if sort else df


# ------------------------------------------------------------ acquisition funnel

def funnel_by_campaign(m: Model, sort: bool = False) -> DataFrame:
    """Q1: funnel counts, conversion rate and its rank within the channel."""
    df = campaign_join(m, funnel=True).select(
        "campaign_id", "channel_name", "campaign_name", "lead_count",
        "converted_lead_count", "acquired_customer_count",
        pct2("converted_lead_count", "lead_count").alias("conversion_rate_pct"),
    )
    w = Window.partitionBy("channel_name").orderBy(F.col("conversion_rate_pct").desc_nulls_first())
    df = df.withColumn("conv_rate_rank_in_channel", F.rank().over(w))
    return _order(df, sort, F.col("channel_name").asc_nulls_last(), "conv_rate_rank_in_channel")


def funnel_by_channel(m: Model, sort: bool = False) -> DataFrame:
    """Q2: funnel counts summed per channel, rate of the sums."""
    df = channel_sums(m, FUNNEL).select(
        "channel_name", "lead_count", "converted_lead_count", "acquired_customer_count",
        pct2("converted_lead_count", "lead_count").alias("conversion_rate_pct"))
    return _order(df, sort, F.col("conversion_rate_pct").desc_nulls_first())


def funnel_totals(m: Model) -> DataFrame:
    """Q3: account-wide funnel totals (one row)."""
    return campaign_facts(m, (FUNNEL,)).agg(
        F.sum("lead_count").alias("total_leads"),
        F.sum("converted_lead_count").alias("total_conversions"),
        F.sum("acquired_customer_count").alias("total_customers_acquired"),
    ).select(
        "total_leads", "total_conversions",
        pct2("total_conversions", "total_leads").alias("overall_conversion_rate_pct"),
        "total_customers_acquired",
    )


# ------------------------------------------------------------ CAC

def cac_by_campaign(m: Model, sort: bool = False) -> DataFrame:
    """Q5: spend / acquired customers per campaign (NULL when none acquired)."""
    df = campaign_join(m, spend=True, funnel=True).select(
        "channel_name", "campaign_id", "campaign_name", "total_spend", "acquired_customer_count",
        _per_customer("total_spend", "acquired_customer_count").alias("cac"),
    )
    return _order(df, sort, F.col("cac").asc_nulls_last())


def cac_by_channel(m: Model, sort: bool = False) -> DataFrame:
    """Q6: channel CAC from summed spend and customers."""
    df = channel_sums(m, SPEND, FUNNEL).select("channel_name", "total_spend", "acquired_customer_count", _cac())
    return _order(df, sort, F.col("cac").asc_nulls_last())


# ------------------------------------------------------------ performance

def performance_by_campaign(m: Model, sort: bool = False) -> DataFrame:
    """Q7: spend, funnel, revenue, CAC and lifetime ROAS per campaign."""
    df = campaign_join(m, spend=True, funnel=True, revenue=True).select(
        "channel_name", "campaign_id", "campaign_name", "objective", "total_spend",
        "lead_count", "converted_lead_count", "acquired_customer_count",
        pct2("converted_lead_count", "lead_count").alias("conversion_rate_pct"),
        "revenue_lifetime_to_date",
        _per_customer("total_spend", "acquired_customer_count").alias("cac"),
        _money_ratio("revenue_lifetime_to_date", "total_spend").alias("roas_lifetime"),
    )
    return _order(df, sort, F.col("channel_name").asc_nulls_last(), F.col("roas_lifetime").desc_nulls_last())


def performance_by_channel(m: Model, sort: bool = False) -> DataFrame:
    """Q8: Q7 rolled up to channel."""
    df = channel_sums(m, SPEND, FUNNEL, REVENUE).select(
        "channel_name", "total_spend", "lead_count", "converted_lead_count", "acquired_customer_count",
        pct2("converted_lead_count", "lead_count").alias("conversion_rate_pct"),
        "revenue_lifetime_to_date", _cac(), _roas_lifetime(),
    )
    return _order(df, sort, F.col("roas_lifetime").desc_nulls_last())


# ------------------------------------------------------------ customer revenue / LTV

def customer_stats(m: Model, level: str) -> DataFrame:
    """Per-channel (``level="channel"``) or per-first-campaign (``"campaign"``)
    customer statistics in ONE aggregate over the customer facts: customers,
    order and lifetime-revenue sums, and the 90-day window counts and sums.

    The LTV figures of Q13, Q15-Q17, Q20, Q23 and X1 are read from this one node, so a
    query that needs several of them aggregates the customer grain once. Channel tables
    that need spend or leads too (Q4, Q19, Q24, X2) use the roll-up lattice.
    """
    key = "channel_name" if level == "channel" else "first_campaign_id"

    def build():
        zero = F.lit(0).cast(SUM_MONEY)
        ltv = F.coalesce(F.col("revenue"), zero)
        ltv90 = F.coalesce(F.col("revenue_90d"), zero)
        complete = F.date_add("signup_date", 90) <= F.col("reference_date")
        return stg_customer_facts(m).crossJoin(reference_row(m)).groupBy(key).agg(
            F.count("customer_id").alias("customers"),
            F.sum("order_count").alias("_orders"), F.count("order_count").alias("_n_orders"),
            F.sum(ltv).cast(SUM_MONEY).alias("_rev"), F.count(ltv).alias("_n"),
            F.count_if(complete).alias("customers_with_complete_window"),
            F.count_if(~complete).alias("excluded_incomplete_window"),
            F.sum(F.when(complete, ltv90)).cast(SUM_MONEY).alias("_s90"),
            F.count(F.when(complete, ltv90)).alias("_n90"),
        ).select("*", avg_round("_rev", "_n").alias("avg_ltv_lifetime"),
                 avg_round("_s90", "_n90").alias("avg_ltv_90d"))
    return m.shared(f"customer_stats_{level}", build)


def customer_revenue_by_channel(m: Model, sort: bool = False) -> DataFrame:
    """Q13: customers, average orders, average and total revenue per channel."""
    df = customer_stats(m, "channel").select(
        F.col("channel_name").alias("acquisition_channel_name"),
        F.col("customers").alias("customers_acquired"),
        avg_round("_orders", "_n_orders", 2, scale=0).alias("avg_orders_per_customer"),
        F.col("avg_ltv_lifetime").alias("avg_revenue_per_customer"),
        F.col("_rev").alias("total_revenue_to_date"),
    )
    return _order(df, sort, F.col("avg_revenue_per_customer").desc_nulls_first())


def ltv_by_customer(m: Model, sort: bool = False) -> DataFrame:
    """Q14: lifetime LTV per customer (a projection of M4)."""
    df = mart_customer_revenue(m).select(
        "customer_id", "acquisition_channel_name", "signup_date", "order_count",
        F.col("lifetime_revenue_to_date").alias("lifetime_ltv"),
    )
    return _order(df, sort, F.col("lifetime_ltv").desc_nulls_first())


def channel_ltv(m: Model) -> DataFrame:
    """Rounded mean lifetime LTV per channel (Q15)."""
    return customer_stats(m, "channel").select("channel_name", "customers", "avg_ltv_lifetime")


def campaign_ltv(m: Model) -> DataFrame:
    """Rounded mean lifetime LTV per first campaign."""
    return customer_stats(m, "campaign").select("first_campaign_id", "customers", "avg_ltv_lifetime")


def ltv_by_channel(m: Model, sort: bool = False) -> DataFrame:
    """Q15: customers, mean and exact median lifetime LTV per channel."""
    from .ranking import group_median

    med = group_median(mart_customer_revenue(m), "acquisition_channel_name",
                       "lifetime_revenue_to_date", "customer_id")
    df = channel_ltv(m).join(
        med.withColumnRenamed("acquisition_channel_name", "channel_name"), "channel_name", "left"
    ).select(
        F.col("channel_name").alias("acquisition_channel_name"), "customers",
        F.col("avg_ltv_lifetime").alias("avg_lifetime_ltv"),
        F.round("median", 2).cast("decimal(20,2)").alias("median_lifetime_ltv"),
    )
    return _order(df, sort, F.col("avg_lifetime_ltv").desc_nulls_first())


def ltv_by_campaign(m: Model, sort: bool = False) -> DataFrame:
    """Q16: customers and mean lifetime LTV per campaign."""
    df = stg_campaigns(m).join(
        campaign_ltv(m), F.col("campaign_id") == F.col("first_campaign_id")
    ).select("channel_name", "campaign_id", "campaign_name", "customers",
             F.col("avg_ltv_lifetime").alias("avg_lifetime_ltv"))
    return _order(df, sort, F.col("avg_lifetime_ltv").desc_nulls_first())


def ltv_90d_by_channel(m: Model, sort: bool = False) -> DataFrame:
    """Q17: complete / incomplete 90-day windows and mean 90-day LTV of complete ones."""
    df = customer_stats(m, "channel").select(
        "channel_name", "customers_with_complete_window", "excluded_incomplete_window", "avg_ltv_90d")
    return _order(df, sort, F.col("avg_ltv_90d").desc_nulls_last())


def campaign_ltv_90d(m: Model) -> DataFrame:
    return customer_stats(m, "campaign").select("first_campaign_id", "avg_ltv_90d")


# ------------------------------------------------------------ LTV:CAC

# Flag texts, in rule order.
LTV_CAC_FLAGS = ["Above 3x heuristic", "Positive but below 3x heuristic", "Below 1x (spend exceeds observed lifetime value)"]


def ltv_cac_by_channel(m: Model, sort: bool = False) -> DataFrame:
    """Q19: LTV:CAC per channel on rounded CAC, with the 3x / 1x heuristic flag."""
    ltv = F.col("avg_ltv_lifetime")
    cac = F.col("cac")
    df = channel_sums(m, SPEND, FUNNEL, WINDOWS).where("customer_rows > 0").select(
        "channel_name", "total_spend", "acquired_customer_count", _cac(),
        avg_round("ltv_sum", "customer_rows").alias("avg_ltv_lifetime"),
        avg_round("ltv_90d_sum", "windows_complete").alias("avg_ltv_90d"),
    ).select(
        "channel_name", "total_spend", F.col("acquired_customer_count").alias("customers_acquired"), "cac", "avg_ltv_lifetime",
        _money_ratio(ltv, cac).alias("ltv_cac_lifetime"),
        "avg_ltv_90d",
        _money_ratio("avg_ltv_90d", cac).alias("ltv_cac_90d"),
        F.when((cac != 0) & (ltv >= cac * 3), F.lit(LTV_CAC_FLAGS[0]))
         .when((cac != 0) & (ltv >= cac), F.lit(LTV_CAC_FLAGS[1]))
         .otherwise(F.lit(LTV_CAC_FLAGS[2]))
         .alias("heuristic_flag_lifetime"),
    )
    return _order(df, sort, F.col("ltv_cac_lifetime").desc_nulls_last())


def ltv_cac_by_campaign(m: Model, sort: bool = False) -> DataFrame:
    """Q20: LTV:CAC per campaign; the 90-day side is a left join."""
    cc = campaign_join(m, spend=True, funnel=True).select(
        "campaign_id", "channel_name", "campaign_name", "total_spend", "acquired_customer_count",
        _per_customer("total_spend", "acquired_customer_count").alias("cac"))
    df = cc.join(campaign_ltv(m).drop("customers"), F.col("campaign_id") == F.col("first_campaign_id")) \
        .drop("first_campaign_id") \
        .join(campaign_ltv_90d(m), F.col("campaign_id") == F.col("first_campaign_id"), "left") \
        .select(
            "channel_name", "campaign_id", "campaign_name", "total_spend", "acquired_customer_count",
            "cac", "avg_ltv_lifetime",
            _money_ratio("avg_ltv_lifetime", "cac").alias("ltv_cac_lifetime"),
            "avg_ltv_90d",
            _money_ratio("avg_ltv_90d", "cac").alias("ltv_cac_90d"),
        )
    return _order(df, sort, F.col("ltv_cac_lifetime").desc_nulls_last())


# ------------------------------------------------------------ contribution / ROAS

def contribution_by_campaign(m: Model, sort: bool = False) -> DataFrame:
    """Q21: revenue minus spend per campaign, ranked within channel."""
    df = campaign_join(m, spend=True, revenue=True).select(
        "channel_name", "campaign_id", "campaign_name", "total_spend", "revenue_lifetime_to_date",
        (F.col("revenue_lifetime_to_date") - F.col("total_spend")).cast(SUM_MONEY).alias("marketing_contribution"),
    )
    w = Window.partitionBy("channel_name").orderBy(F.col("marketing_contribution").desc_nulls_first())
    df = df.withColumn("contribution_rank_in_channel", F.rank().over(w))
    return _order(df, sort, F.col("marketing_contribution").desc_nulls_first())


def contribution_by_channel(m: Model, sort: bool = False) -> DataFrame:
    """Q22: summed revenue minus summed spend per channel."""
    df = channel_sums(m, SPEND, REVENUE).select("channel_name", "total_spend", "revenue_lifetime_to_date", _contribution())
    return _order(df, sort, F.col("marketing_contribution").desc_nulls_first())


def roas_by_campaign(m: Model, sort: bool = False) -> DataFrame:
    """Q28: ROAS in the campaign window and over the customers' lifetime."""
    df = campaign_join(m, spend=True, revenue=True).select(
        "channel_name", "campaign_id", "campaign_name", "total_spend",
        "revenue_in_campaign_window", "revenue_lifetime_to_date",
        _money_ratio("revenue_in_campaign_window", "total_spend").alias("roas_in_window"),
        _money_ratio("revenue_lifetime_to_date", "total_spend").alias("roas_lifetime"),
    )
    return _order(df, sort, F.col("roas_lifetime").desc_nulls_last())


def roas_by_channel(m: Model, sort: bool = False) -> DataFrame:
    """Q29: channel ROAS from summed revenue and spend."""
    df = channel_sums(m, SPEND, REVENUE).select(
        "channel_name", "total_spend", "revenue_in_campaign_window", "revenue_lifetime_to_date",
        _money_ratio("revenue_in_campaign_window", "total_spend").alias("roas_in_window"), _roas_lifetime(),
    )
    return _order(df, sort, F.col("roas_lifetime").desc_nulls_last())


# ------------------------------------------------------------ profitability

def profitability_by_campaign(m: Model, sort: bool = False) -> DataFrame:
    """Q23: the consolidated campaign table; LTV:CAC here uses unrounded CAC (T5)."""
    df = campaign_join(m, spend=True, funnel=True, revenue=True).join(
        campaign_ltv(m).drop("customers"), F.col("campaign_id") == F.col("first_campaign_id")
    ).select(
        "channel_name", "campaign_id", "campaign_name", "total_spend", "lead_count",
        "converted_lead_count", "acquired_customer_count",
        pct2("converted_lead_count", "lead_count").alias("conversion_rate_pct"),
        _per_customer("total_spend", "acquired_customer_count").alias("cac"),
        "revenue_in_campaign_window", "revenue_lifetime_to_date",
        _money_ratio("revenue_in_campaign_window", "total_spend").alias("roas_in_window"),
        _money_ratio("revenue_lifetime_to_date", "total_spend").alias("roas_lifetime"),
        "avg_ltv_lifetime",
        _unrounded_cac_ratio(F.col("avg_ltv_lifetime"), F.col("total_spend"),
                             F.col("acquired_customer_count")).alias("ltv_cac_lifetime"),
        (F.col("revenue_lifetime_to_date") - F.col("total_spend")).cast(SUM_MONEY).alias("marketing_contribution"),
    )
    return _order(df, sort, F.col("marketing_contribution").desc_nulls_first())


def profitability_by_channel(m: Model, sort: bool = False) -> DataFrame:
    """Q24: Q23 rolled up to channel, with the channel's mean LTV."""
    df = channel_sums(m, SPEND, FUNNEL, REVENUE).withColumn("avg_ltv_lifetime", avg_round("ltv_sum", "customer_rows")).select(
        "channel_name", "total_spend", "lead_count", "converted_lead_count", "acquired_customer_count",
        pct2("converted_lead_count", "lead_count").alias("conversion_rate_pct"),
        _cac(), "revenue_lifetime_to_date", _roas_lifetime(), "avg_ltv_lifetime",
        _unrounded_cac_ratio(F.col("avg_ltv_lifetime"), F.col("total_spend"),
                             F.col("acquired_customer_count")).alias("ltv_cac_lifetime"),
        _contribution(),
    )
    return _order(df, sort, F.col("marketing_contribution").desc_nulls_first())


# ------------------------------------------------------------ budget allocation

# Recommendation labels and rationales, in rule order.
RECOMMENDATIONS = [
    ("Scale candidate",
     "Contribution positive, LTV:CAC >= 3x heuristic, CAC at or below dataset average"),
    ("Maintain / monitor",
     "Contribution positive, LTV:CAC >= 1.5x - healthy but not exceptional"),
    ("Review",
     "Contribution positive but LTV:CAC below 1.5x, or CAC well above average"),
    ("Reduce / investigate",
     "Contribution negative or LTV:CAC below 1x - spend is not being recovered"),
]


def first_label(labels: list[str], *conditions: F.Column) -> F.Column:
    """The label of the first condition that holds; the last label where none does (or all are NULL)."""
    return reduce(lambda rest, rule: F.when(rule[0], F.lit(rule[1])).otherwise(rest),
                  reversed(list(zip(conditions, labels))), F.lit(labels[-1]))


def budget_allocation(m: Model, sort: bool = False) -> DataFrame:
    """Q4: recommendation from rounded LTV:CAC and rounded CAC-vs-average (T6), from the channel ledger."""
    account_cac = _per_customer("account_spend", "account_customers")
    rated = channel_ledger(m).select("*", _cac(), _roas_lifetime(), _contribution()).withColumns({
        "cac_vs_avg_ratio": _money_ratio("cac", account_cac),
        "ltv_cac_lifetime": _money_ratio("avg_ltv_lifetime", "cac"),
    })
    pays, multiple = F.col("marketing_contribution") > 0, F.col("ltv_cac_lifetime")
    rules = [pays & (multiple >= 3) & (F.col("cac_vs_avg_ratio") <= 1), pays & (multiple >= 1.5), pays & (multiple >= 1)]
    df = rated.select(
        "channel_name", "total_spend", F.col("acquired_customer_count").alias("customers_acquired"), "cac", "cac_vs_avg_ratio",
        "roas_lifetime", "ltv_cac_lifetime", "marketing_contribution", "retention_month_3_pct",
        first_label([label for label, _ in RECOMMENDATIONS], *rules).alias("recommendation"),
        first_label([reason for _, reason in RECOMMENDATIONS], *rules).alias("rationale"))
    return _order(df, sort, F.col("marketing_contribution").desc_nulls_first())


def customer_revenue_ranked(m: Model, sort: bool = False) -> DataFrame:
    """Q12: M4 with RANK of lifetime revenue within the acquisition channel.

    A channel can hold a third of all customers, so the rank is computed by
    ``ranking.ranked`` (range partitions) rather than a window partitioned by
    channel.
    """
    from .ranking import SortKey, ranked

    src = mart_customer_revenue(m).select(
        "customer_id", "acquisition_channel_name", "signup_date", "order_count",
        "lifetime_revenue_to_date", "first_order_date", "last_order_date")
    df = ranked(src, ["acquisition_channel_name"], [SortKey("lifetime_revenue_to_date", ascending=False)],
                ["customer_id"], "revenue_rank_in_channel")
    return _order(df, sort, F.col("lifetime_revenue_to_date").desc_nulls_first())
