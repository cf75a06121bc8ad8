"""Hand-written model fixtures (FIXTURES.md section 4)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from acqlens.sources.model import TABLES, Model


def D(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def M(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def make_model(spark, channels=(), campaigns=(), spend=(), customers=(), leads=(), orders=(),
               nullable: bool = False) -> Model:
    """A model from row tuples; ``nullable=True`` admits NULLs in NOT NULL columns
    (to exercise the required-field checks)."""
    rows = {
        "channels": channels, "campaigns": campaigns, "daily_campaign_spend": spend,
        "customers": customers, "leads": leads, "orders": orders,
    }
    frames = {}
    for name, schema in TABLES.items():
        if nullable:
            schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
        frames[name] = spark.createDataFrame(list(rows[name]), schema)
    return Model(**frames)


def campaign(cid, channel_id, start="2025-01-01", end="2025-03-31", name=None, objective="Conversions"):
    return (cid, channel_id, name or f"C{cid}", D(start), D(end), objective)


def customer(cust_id, campaign_id, signup, region="EU"):
    return (cust_id, campaign_id, D(signup), region)


def converted_lead(lead_id, campaign_id, date, cust_id):
    return (lead_id, campaign_id, D(date), True, cust_id)


def open_lead(lead_id, campaign_id, date):
    return (lead_id, campaign_id, D(date), False, None)


def order(order_id, cust_id, date, amount):
    return (order_id, cust_id, D(date), M(amount))


def spend_row(campaign_id, date, amount, impressions=100, clicks=10):
    return (campaign_id, D(date), M(amount), impressions, clicks)
