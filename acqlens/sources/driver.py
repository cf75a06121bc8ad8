"""Adapter from the driver's TPC-H-style parquet tables to the funnel model.

The mapping is a fixed, documented rule so that the DuckDB oracle in
``acqlens.verify.oracle`` can rebuild exactly the same six tables:

* channels  <- region   (r_regionkey, r_name)
* campaigns <- nation   (n_nationkey, n_regionkey, n_name); with k = n_nationkey
  the campaign runs from ``make_date(1995 + k % 6, 1 + k % 12, 1)`` for
  ``90 + 20 * (k % 5)`` days; the objective cycles through the four objectives.
* orders    <- orders   (o_orderkey, o_custkey, date of o_orderdate,
  o_totalprice as money)
* customers <- customer (c_custkey, c_nationkey as first campaign, region =
  c_mktsegment); signup is the customer's first order date (1996-01-01 when
  there is none) minus ``c_custkey % 4`` days, or plus 20 days for every 40th
  customer (``c_custkey % 40 = 11``), whose first orders thus precede it.
* daily_campaign_spend <- lineitem joined to supplier; the supplier's nation is
  the campaign. Every line counts, also on days outside the campaign's window;
  per (campaign, day): spend = sum(extendedprice * discount) in exact decimals,
  impressions = sum(quantity), clicks = number of lines.
* leads     <- one converted lead per customer (id 2 * customer_id, the
  customer's campaign and signup date) plus one unconverted lead per event
  (id 2 * event_id + 1, campaign ``user_id`` modulo the number of nations, the
  event's date).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.broadcast import one_row
from .model import Model, model_from_frames

# Campaign objectives, in the order k % 4 selects them.
OBJECTIVES = ["Lead Generation", "Conversions", "Brand Awareness", "Retargeting"]

NO_ORDER_SIGNUP = "1996-01-01"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _objective(k):
    expr = F.lit(OBJECTIVES[-1])
    for i in reversed(range(len(OBJECTIVES) - 1)):
        expr = F.when(k % 4 == i, F.lit(OBJECTIVES[i])).otherwise(expr)
    return expr


def campaigns_from_nation(nation: DataFrame) -> DataFrame:
    k = F.col("n_nationkey")
    start = F.make_date(F.lit(1995) + k % 6, F.lit(1) + k % 12, F.lit(1))
    return nation.select(
        k.cast("int").alias("campaign_id"),
        F.col("n_regionkey").cast("int").alias("channel_id"),
        F.col("n_name").alias("campaign_name"),
        start.alias("start_date"),
        F.date_add(start, (F.lit(90) + F.lit(20) * (k % 5)).cast("int")).alias("end_date"),
        _objective(k).alias("objective"),
    )


def model_from_driver(spark: SparkSession, sf_dir: str) -> Model:
    region = _read(spark, sf_dir, "region")
    nation = _read(spark, sf_dir, "nation")
    customer = _read(spark, sf_dir, "customer")
    orders_raw = _read(spark, sf_dir, "orders")
    supplier = _read(spark, sf_dir, "supplier")
    lineitem = _read(spark, sf_dir, "lineitem")
    events = _read(spark, sf_dir, "events")

    channels = region.select(
        F.col("r_regionkey").cast("int").alias("channel_id"),
        F.col("r_name").alias("channel_name"),
    )
    campaigns = campaigns_from_nation(nation)

    orders = orders_raw.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("order_amount"),
    )

    # First order per customer: a partial/final aggregate, one row per buyer.
    first_order = orders.groupBy("customer_id").agg(F.min("order_date").alias("first_order_date"))
    customers = (
        customer.join(first_order, customer["c_custkey"] == first_order["customer_id"], "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_nationkey").cast("int").alias("first_campaign_id"),
            F.date_add(
                F.coalesce(F.col("first_order_date"), F.lit(NO_ORDER_SIGNUP).cast("date")),
                F.when(F.col("c_custkey") % 40 == 11, 20).otherwise(-(F.col("c_custkey") % 4)).cast("int"),
            ).alias("signup_date"),
            F.col("c_mktsegment").alias("region"),
        )
    )

    # Spend: lines are first reduced to (supplier, ship day) with exact decimal
    # sums (map-side partial aggregation; a supplier owning a third of all lines
    # becomes one row per day), then joined to supplier and summed per
    # (campaign, day). The planner chooses the join by measured sizes.
    ship = F.to_date("l_shipdate")
    per_supplier_day = lineitem.groupBy("l_suppkey", ship.alias("ship_date")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")
              * F.col("l_discount").cast("decimal(4,2)")).alias("_spend"),
        F.sum("l_quantity").alias("_qty"),
        F.count(F.lit(1)).alias("_lines"),
    )
    spend = (
        per_supplier_day
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(campaigns.select("campaign_id"), F.col("s_nationkey") == F.col("campaign_id"))
        .groupBy("campaign_id", F.col("ship_date").alias("spend_date"))
        .agg(
            F.sum("_spend").cast("decimal(18,2)").alias("spend_amount"),
            F.sum("_qty").cast("bigint").alias("impressions"),
            F.sum("_lines").cast("bigint").alias("clicks"),
        )
    )

    converted = customers.select(
        (F.col("customer_id") * 2).alias("lead_id"),
        F.col("first_campaign_id").alias("campaign_id"),
        F.col("signup_date").alias("lead_date"),
        F.lit(True).alias("converted_flag"),
        F.col("customer_id").alias("converted_customer_id"),
    )
    nations = one_row(nation.agg(F.count(F.lit(1)).alias("_nations")))
    unconverted = events.crossJoin(nations).select(
        (F.col("event_id") * 2 + 1).alias("lead_id"),
        (F.col("user_id") % F.col("_nations")).cast("int").alias("campaign_id"),
        F.to_date("ts").alias("lead_date"),
        F.lit(False).alias("converted_flag"),
        F.lit(None).cast("bigint").alias("converted_customer_id"),
    )
    leads = converted.unionByName(unconverted)

    return model_from_frames(
        channels=channels,
        campaigns=campaigns,
        daily_campaign_spend=spend,
        customers=customers,
        leads=leads,
        orders=orders,
    )
