"""Staging operators G1-G2: dimension denormalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.model import Model


def stg_campaigns(m: Model) -> DataFrame:
    """G1: campaigns with their channel name and duration in days (inner join)."""
    def build():
        return m.campaigns.join(m.channels, "channel_id").select(
            "campaign_id", "channel_id", "channel_name", "campaign_name",
            "start_date", "end_date", "objective",
            F.datediff("end_date", "start_date").alias("campaign_duration_days"),
        )
    return m.memo("stg_campaigns", build)


def stg_customers(m: Model) -> DataFrame:
    """Customers with first-touch campaign, channel id and channel name."""
    def build():
        sc = stg_campaigns(m).select(
            F.col("campaign_id").alias("first_campaign_id"),
            F.col("channel_id").alias("acquisition_channel_id"),
            F.col("channel_name").alias("acquisition_channel_name"),
        )
        return m.customers.join(sc, "first_campaign_id").select(
            "customer_id", "first_campaign_id", "acquisition_channel_id",
            "acquisition_channel_name", "signup_date", "region",
        )
    return m.memo("stg_customers", build)
