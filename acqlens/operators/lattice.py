"""Roll-up lattice: one row of facts per campaign, summed to channels, summed to the account.

``campaign_facts`` unites spend rows, leads and customers as partial rows of their
campaign and groups them once: each table is read once, and map-side partial sums
leave one row per campaign and task. A row tells on which sides its campaign was
met (``spend_rows``, ``lead_count``, ``customer_rows``), so the inner joins that drop
campaigns (T7) are conditions on sums instead of joins. ``channel_sums`` adds the facts
up per channel; account figures are sums of channel rows or of the facts.

Only the sides that a caller names are read. Campaign ids are taken as unique, as
declared (``data_quality_checks`` reports where they are not).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import SUM_MONEY, avg_round, months_between_cal, pct2
from ..sources.model import Model
from .marts import CHECKPOINT_MONTHS, customer_facts, reference_row
from .staging import stg_campaigns

SPEND, FUNNEL, REVENUE, WINDOWS = "spend", "funnel", "revenue", "windows"
ALL_SIDES = (SPEND, FUNNEL, REVENUE, WINDOWS)

MONEY_SUMS = ("total_spend", "revenue_in_campaign_window", "revenue_lifetime_to_date", "ltv_90d_sum")
# how a campaign is seen to be met on a side
MET = {SPEND: "spend_rows", FUNNEL: "lead_count", REVENUE: "customer_rows"}


def _one() -> F.Column:
    return F.lit(1).cast("bigint")


def _flag(condition: F.Column) -> F.Column:
    return F.coalesce(condition, F.lit(False)).cast("bigint")


def _spend_rows(m: Model) -> DataFrame:
    return m.daily_campaign_spend.select(
        "campaign_id", _one().alias("spend_rows"), F.col("spend_amount").cast(SUM_MONEY).alias("total_spend"))


def _lead_rows(m: Model) -> DataFrame:
    """Leads by (campaign, customer): a customer of several leads is acquired once."""
    return m.leads.groupBy("campaign_id", "converted_customer_id").agg(
        F.count(F.lit(1)).alias("lead_count"),
        F.count_if("converted_flag").alias("converted_lead_count"),
    ).withColumn("acquired_customer_count", F.col("converted_customer_id").isNotNull().cast("bigint")).drop("converted_customer_id")


def _customer_rows(m: Model, windows: bool) -> DataFrame:
    zero = F.lit(0).cast(SUM_MONEY)
    columns = [
        F.col("first_campaign_id").alias("campaign_id"), _one().alias("customer_rows"), F.col("customer_id").isNotNull().cast("bigint").alias("customers"),
        F.coalesce("revenue_in_window", zero).alias("revenue_in_campaign_window"), F.coalesce("revenue", zero).alias("revenue_lifetime_to_date"),
    ]
    if not windows:
        return customer_facts(m).select(columns)
    complete = F.date_add("signup_date", 90) <= F.col("reference_date")
    lived = months_between_cal("reference_month", "signup_date")
    columns += [_flag(complete).alias("windows_complete"), F.when(complete, F.coalesce("revenue_90d", zero)).alias("ltv_90d_sum")]
    for k in CHECKPOINT_MONTHS:
        columns += [_flag(lived >= k).alias(f"in_scope_{k}"), _flag((lived >= k) & F.col(f"active_month_{k}")).alias(f"active_{k}")]
    return customer_facts(m).crossJoin(reference_row(m)).select(columns)


def campaign_facts(m: Model, sides=ALL_SIDES) -> DataFrame:
    """One row per campaign id that occurs on any of ``sides``; sums of a side are NULL where it does not."""
    def build():
        parts = []
        if SPEND in sides:
            parts.append(_spend_rows(m))
        if FUNNEL in sides:
            parts.append(_lead_rows(m))
        if REVENUE in sides or WINDOWS in sides:
            parts.append(_customer_rows(m, WINDOWS in sides))
        met = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return met.groupBy("campaign_id").agg(
            *(F.sum(c).cast(SUM_MONEY if c in MONEY_SUMS else "bigint").alias(c) for c in met.columns if c != "campaign_id"))
    return m.shared(f"campaign_facts {sorted(sides)}", build)


def channel_sums(m: Model, *sides: str) -> DataFrame:
    """Facts per channel that has a campaign met on all of ``sides``.

    Spend, funnel and revenue are summed over these campaigns only. What counts
    customers (``customers``, ``ltv_*``, windows, retention) is summed over all campaigns of
    the channel, whether they had spend or not.
    """
    facts = campaign_facts(m, sides)
    named = facts.join(stg_campaigns(m).select("campaign_id", "channel_name"), "campaign_id")
    met = reduce(lambda a, b: a & b, [F.coalesce(F.col(MET[s]) > 0, F.lit(False)) for s in sides if s in MET])
    gated = [c for c in ("total_spend", "lead_count", "converted_lead_count", "acquired_customer_count",
                         "revenue_in_campaign_window", "revenue_lifetime_to_date") if c in facts.columns]
    always = [c for c in facts.columns if c not in gated and c not in ("campaign_id", "spend_rows")]
    summed = lambda name, value: F.sum(value).cast(SUM_MONEY if name in MONEY_SUMS else "bigint").alias(name)
    sums = [summed(c, F.when(met, F.col(c))) for c in gated] + [summed(c, F.col(c)) for c in always]
    if "customer_rows" in always:
        sums.append(F.sum("revenue_lifetime_to_date").cast(SUM_MONEY).alias("ltv_sum"))
    return named.groupBy("channel_name").agg(F.count_if(met).alias("campaigns_met"), *sums).where("campaigns_met > 0").drop("campaigns_met")


def channel_ledger(m: Model) -> DataFrame:
    """All channel figures that the dashboard and the budget rule need, with the account's spend and customers beside them.

    The account is a window over the channel rows, so the figures are computed once.
    """
    def build():
        account = Window.partitionBy()
        retention = [pct2(f"active_{k}", f"in_scope_{k}").alias(f"retention_month_{k}_pct") for k in CHECKPOINT_MONTHS]
        return channel_sums(m, *ALL_SIDES).select(
            "channel_name", "total_spend", "lead_count", "converted_lead_count", "acquired_customer_count",
            "revenue_in_campaign_window", "revenue_lifetime_to_date",
            avg_round("ltv_sum", "customer_rows").alias("avg_ltv_lifetime"),
            avg_round("ltv_90d_sum", "windows_complete").alias("avg_ltv_90d"),
            *retention,
            F.sum("total_spend").over(account).cast(SUM_MONEY).alias("account_spend"),
            F.sum("acquired_customer_count").over(account).alias("account_customers"),
        )
    return m.shared("channel_ledger", build)


def account_totals(m: Model) -> DataFrame:
    """One row: spend, revenue, acquired customers and lifetime value of all campaigns, known or not.

    Lifetime value counts customers whose campaign has a channel.
    """
    named = stg_campaigns(m).select("campaign_id", F.lit(True).alias("staged"))
    return campaign_facts(m, (SPEND, FUNNEL, REVENUE)).join(named, "campaign_id", "left").agg(
        F.sum("total_spend").cast(SUM_MONEY).alias("total_spend"),
        F.sum("revenue_lifetime_to_date").cast(SUM_MONEY).alias("total_revenue"),
        F.sum("acquired_customer_count").alias("acquired_customers"),
        F.sum(F.when(F.col("staged"), F.col("revenue_lifetime_to_date"))).cast(SUM_MONEY).alias("ltv_sum"),
        F.coalesce(F.sum(F.when(F.col("staged"), F.col("customer_rows"))), F.lit(0)).alias("ltv_customers"),
    )
