"""Legacy analytics (L1-L8, S7, S8) over the superseded six-table schema.

The legacy schema has no loader of its own, so its tables are derived from the
model (``legacy_tables``):

* campaigns(campaign_id, channel)            <- stg_campaigns
* conversions(campaign_id, conversions)      <- converted leads per campaign
* daily_spend(campaign_id, channel, spend)   <- daily spend with channel name
* revenue(user_id, revenue)                  <- orders
* users(user_id, signup_date, churn_probability) <- customers; the probability
  is a recency proxy: min(1, days since last order / 365) rounded to 4 places,
  1 for customers who never ordered
* user_acquisition(user_id, campaign_id)     <- customers' first campaign

Per-user revenue is always aggregated before it meets ``users``; L5, which
emits one row per revenue row, replicates each per-user result in bounded
chunks so a user owning a third of all revenue rows is spread over many tasks.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import SUM_MONEY, rounded_ratio
from ..plans.session import spread
from ..sources.model import Model
from .marts import mart_campaign_funnel, mart_reference_date
from .staging import stg_campaigns

PROBABILITY = T.DecimalType(5, 4)
CHURN_HORIZON_DAYS = 365
REPLICA_CHUNK = 100_000

# Loyalty tiers with their upper bounds (percent of churn probability).
TIERS = [(10, "Loyal Client"), (30, "High Potential Client"), (60, "Passive Client")]
TOP_TIER = "At Risk"


def legacy_tables(m) -> dict[str, DataFrame]:
    """The legacy tables derived from a ``Model``; a dict of tables passes through."""
    if isinstance(m, dict):
        return m

    def build_users():
        last = m.orders.groupBy("customer_id").agg(F.max("order_date").alias("_last"))
        ref = F.broadcast(mart_reference_date(m).select("reference_date"))
        recency = F.datediff("reference_date", "_last")
        proxy = F.least(rounded_ratio(recency, F.lit(CHURN_HORIZON_DAYS), 4, 0, 0),
                        F.lit(1).cast("decimal(20,4)"))
        return m.customers.join(last, "customer_id", "left").crossJoin(ref).select(
            F.col("customer_id").alias("user_id"), "signup_date",
            F.when(F.col("_last").isNull(), F.lit(1)).otherwise(proxy).cast(PROBABILITY)
            .alias("churn_probability"))

    return {
        "campaigns": stg_campaigns(m).select("campaign_id", F.col("channel_name").alias("channel")),
        "conversions": mart_campaign_funnel(m).select(
            "campaign_id", F.col("converted_lead_count").alias("conversions")),
        "daily_spend": m.daily_campaign_spend.join(
            stg_campaigns(m).select("campaign_id", F.col("channel_name").alias("channel")), "campaign_id"
        ).select("campaign_id", "channel", F.col("spend_amount").alias("spend")),
        "revenue": m.orders.select(F.col("customer_id").alias("user_id"),
                                   F.col("order_amount").alias("revenue")),
        "users": m.memo("legacy_users", build_users),
        "user_acquisition": m.customers.select(F.col("customer_id").alias("user_id"),
                                               F.col("first_campaign_id").alias("campaign_id")),
    }


def _tier(value, scale: str = "1"):
    expr = None
    for bound, name in TIERS:
        cond = value <= F.lit(Decimal(bound) * Decimal(scale))
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise(TOP_TIER)


def _round0(c):
    return F.round(c, 0)


def _user_revenue(t: dict[str, DataFrame]) -> DataFrame:
    """Per-user revenue sum and row count (partial aggregation before any join)."""
    return t["revenue"].groupBy("user_id").agg(
        F.sum("revenue").cast(SUM_MONEY).alias("_sum"), F.count(F.lit(1)).alias("_rows"),
        F.count("revenue").alias("_n"))


def ltv_per_user(m: Model) -> DataFrame:
    """L1: rounded lifetime value per user."""
    return _user_revenue(legacy_tables(m)).select("user_id", _round0("_sum").alias("lifetime_value"))


def top_converting_channel(m: Model) -> DataFrame:
    """L2: the channel with the most conversions (ties: channel name)."""
    t = legacy_tables(m)
    return t["campaigns"].join(t["conversions"], "campaign_id").groupBy("channel").agg(
        F.sum("conversions").alias("total_conversions")
    ).orderBy(F.col("total_conversions").desc_nulls_first(), F.col("channel")).limit(1)


def top_value_user(m: Model) -> DataFrame:
    """L3: the highest-value user (ties: smallest user id)."""
    return ltv_per_user(m).orderBy(F.col("lifetime_value").desc_nulls_first(), "user_id").limit(1)


def loyalty_tiers(m: Model) -> DataFrame:
    """L4: tier from the churn percentage rounded to one decimal."""
    users = legacy_tables(m)["users"]
    perc = F.round(F.col("churn_probability") * 100, 1)
    return users.select("user_id", "signup_date", perc.alias("churn_prob_perc")).withColumn(
        "client_loyalty", _tier(F.col("churn_prob_perc")))


def user_revenue_tiers(m: Model) -> DataFrame:
    """One row per revenue row with the user's rounded total and raw-probability tier.

    The per-user result is computed once, then replicated back to the user's
    row count in chunks of at most ``REPLICA_CHUNK`` rows spread by
    (user, chunk), so no task materialises a hot user's rows alone.
    """
    t = legacy_tables(m)
    per_user = _user_revenue(t).join(t["users"], "user_id").select(
        "user_id", _round0("_sum").alias("lifetime_value"), "churn_probability",
        _tier(F.col("churn_probability"), "0.01").alias("client_loyalty"), "_rows")
    chunks = per_user.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_rows") - 1) / REPLICA_CHUNK).cast("int"))))
    chunks = chunks.withColumn(
        "_copies", F.least(F.lit(REPLICA_CHUNK), F.col("_rows") - F.col("_chunk") * REPLICA_CHUNK).cast("int"))
    return spread(chunks, "user_id", "_chunk").select(
        "user_id", "lifetime_value", "churn_probability", "client_loyalty",
        F.explode(F.array_repeat(F.lit(1), F.col("_copies"))).alias("_one"),
    ).drop("_one")


def churn_buckets(m: Model) -> DataFrame:
    """Average revenue per churn bucket floor(p * 10) / 10, with its tier."""
    t = legacy_tables(m)
    joined = _user_revenue(t).join(t["users"], "user_id").withColumn(
        "churn_bucket", F.floor(F.col("churn_probability") * 10) / 10)
    return joined.groupBy("churn_bucket").agg(
        F.sum("_sum").cast(SUM_MONEY).alias("_s"), F.sum("_n").alias("_c")
    ).select(
        "churn_bucket",
        rounded_ratio("_s", "_c", 0, 2, 0).alias("avg_income"),
        _tier(F.col("churn_bucket"), "0.01").alias("client_loyalty"),
    )


def channel_profit(m: Model) -> DataFrame:
    """Rounded revenue and spend per channel, profit and ROAS."""
    t = legacy_tables(m)
    revenue = _user_revenue(t).join(t["user_acquisition"], "user_id").join(t["campaigns"], "campaign_id") \
        .groupBy("channel").agg(_round0(F.sum("_sum").cast(SUM_MONEY)).alias("total_revenue"))
    spend = t["daily_spend"].groupBy("channel").agg(_round0(F.sum("spend").cast(SUM_MONEY)).alias("total_spend"))
    return revenue.join(spend, "channel").select(
        "channel", "total_revenue", "total_spend",
        (F.col("total_revenue") - F.col("total_spend")).alias("profit"),
        rounded_ratio("total_revenue", "total_spend", 2, 0, 0).alias("roas"),
    )


def campaign_cac(m: Model) -> DataFrame:
    """Rounded spend per campaign over distinct acquired users."""
    t = legacy_tables(m)
    spend = t["daily_spend"].groupBy("campaign_id", "channel").agg(
        _round0(F.sum("spend").cast(SUM_MONEY)).alias("total_spend"))
    clients = t["users"].join(t["user_acquisition"], "user_id").groupBy("campaign_id").agg(
        F.countDistinct("user_id").alias("total_clients"))
    return spend.join(clients, "campaign_id").select(
        "channel", "campaign_id", "total_spend", "total_clients",
        rounded_ratio("total_spend", "total_clients", 2, 0, 0).alias("cac"))


def row_counts(m: Model) -> DataFrame:
    """Row count per legacy table."""
    t = legacy_tables(m)
    parts = [t[name].agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"), "row_count")
        for name in ("campaigns", "conversions", "daily_spend", "revenue", "users")]
    return reduce(DataFrame.unionByName, parts)
