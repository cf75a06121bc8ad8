"""Hot keys: one customer owns a third of all orders (derived from the driver data).

Results must equal brute-force formulations (plain joins and single-partition
windows) - the distributed paths may split work, never change answers.
"""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from acqlens.operators import legacy, marts, metrics, rfm
from acqlens.sources.driver import model_from_driver

HOT = 1


@pytest.fixture(scope="module")
def skewed(spark):
    m = model_from_driver(spark, "/root/testdata/sf0.01")
    hot_orders = m.orders.withColumn(
        "customer_id", F.when(F.col("order_id") % 3 == 0, F.lit(HOT)).otherwise(F.col("customer_id")))
    return m.replace(orders=hot_orders)


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hot_customer_holds_a_third(skewed):
    total = skewed.orders.count()
    hot = skewed.orders.where(F.col("customer_id") == HOT).count()
    assert hot >= total / 3


def test_customer_revenue_under_skew(skewed):
    o = skewed.orders
    brute = skewed.customers.join(o, "customer_id", "left").groupBy("customer_id").agg(
        F.count("order_id").alias("order_count"),
        F.coalesce(F.sum("order_amount"), F.lit(0)).cast("decimal(22,2)").alias("lifetime_revenue_to_date"))
    got = marts.mart_customer_revenue(skewed).select("customer_id", "order_count", "lifetime_revenue_to_date")
    assert _same(brute, got)


def test_rfm_scores_under_skew(skewed):
    base = rfm.rfm_base(skewed)
    w = lambda *o: Window.orderBy(*o)
    brute = base.select(
        "customer_id",
        F.ntile(5).over(w(F.col("recency_days").desc(), "customer_id")).alias("recency_score"),
        F.ntile(5).over(w("frequency", "customer_id")).alias("frequency_score"),
        F.ntile(5).over(w("monetary", "customer_id")).alias("monetary_score"))
    got = rfm.mart_customer_rfm(skewed).select("customer_id", "recency_score", "frequency_score", "monetary_score")
    assert _same(brute, got)


def test_rank_in_channel_under_skew(skewed):
    src = marts.mart_customer_revenue(skewed)
    brute = src.select("customer_id", F.rank().over(
        Window.partitionBy("acquisition_channel_name").orderBy(F.col("lifetime_revenue_to_date").desc())
    ).alias("revenue_rank_in_channel"))
    got = metrics.customer_revenue_ranked(skewed).select("customer_id", "revenue_rank_in_channel")
    assert _same(brute, got)


def test_per_row_output_under_skew(skewed):
    t = legacy.legacy_tables(skewed)
    brute = t["users"].join(t["revenue"], "user_id").select(
        "user_id", F.round(F.sum("revenue").over(Window.partitionBy("user_id")), 0).alias("lifetime_value"))
    got = legacy.user_revenue_tiers(skewed).select("user_id", "lifetime_value")
    assert _same(brute, got)


def test_windowed_revenue_under_skew(skewed):
    """M3 and M10 against a plain join of customers and orders."""
    heavy = {r.heavy_id for r in marts.heavy_customers(skewed).collect()}
    assert HOT in heavy and 0 < len(heavy) < skewed.customers.count()  # both ways are taken
    joined = skewed.customers.join(skewed.campaigns, F.col("first_campaign_id") == F.col("campaign_id")).join(skewed.orders, "customer_id", "left")
    money = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(28,2)")
    brute = joined.groupBy("campaign_id", "channel_id").agg(
        money(F.when(F.col("order_date").between(F.col("start_date"), F.col("end_date")), F.col("order_amount"))).alias("revenue_in_campaign_window"),
        money("order_amount").alias("revenue_lifetime_to_date"))
    assert _same(brute, marts.mart_campaign_revenue(skewed).select(brute.columns))
    brute = joined.groupBy("customer_id").agg(
        money(F.when(F.col("order_date") <= F.date_add("signup_date", 90), F.col("order_amount"))).alias("ltv_90d"))
    assert _same(brute, marts.mart_ltv_90d(skewed).select("customer_id", "ltv_90d"))


def test_copies_of_one_customer_are_laid_out_in_chunks(skewed):
    """A customer row repeated many times: as many rows as a plain join gives, spread over partitions."""
    copies = skewed.customers.where(F.col("customer_id") == HOT).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(1000)))).drop("n")
    m = skewed.replace(customers=skewed.customers.union(copies))
    m.persist = False
    base = rfm.rfm_base(m, chunk=16)
    hot = base.where(F.col("customer_id") == HOT)
    assert hot.count() == hot.select("_copy").distinct().count() == 1001
    assert hot.agg(F.min("_copy"), F.max("_copy")).first() == (1, 1001)
    assert hot.groupBy(F.spark_partition_id()).count().count() > 1
    assert _same(base, rfm.rfm_base(m))
