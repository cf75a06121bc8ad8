"""Compact cohort path == aggregates over the row-level spine (M7), on driver data."""

import pytest
from pyspark.sql import functions as F

from acqlens.operators import cohort
from acqlens.sources.driver import model_from_driver


@pytest.fixture(scope="module", params=["keys hold", "duplicate customers"])
def model(spark, request):
    m = model_from_driver(spark, "/root/testdata/sf0.01")
    if request.param == "duplicate customers":
        m = m.replace(customers=m.customers.union(m.customers.where("customer_id % 30 = 1")))
    return m


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_channel_retention_compact_equals_spine(model):
    act = cohort.mart_customer_month_activity(model)
    spine_based = act.groupBy("channel_id", "channel_name", "months_since_acquisition").agg(
        F.countDistinct("customer_id").alias("customers_in_scope"),
        F.countDistinct(F.when(F.col("is_active"), F.col("customer_id"))).alias("active_customers"))
    compact = cohort.mart_channel_retention(model).select(
        "channel_id", "channel_name", "months_since_acquisition", "customers_in_scope", "active_customers")
    assert _same(spine_based, compact)


def test_cohort_grid_compact_equals_spine(model):
    act = cohort.mart_customer_month_activity(model)
    spine_based = act.groupBy("cohort_month", "months_since_acquisition").agg(
        F.countDistinct(F.when(F.col("is_active"), F.col("customer_id"))).alias("active_customers"),
        F.sum("revenue").cast("decimal(28,2)").alias("monthly_revenue"))
    compact = cohort.cohort_monthly(model)
    assert _same(spine_based, compact.select(*spine_based.columns))
    total = compact.agg(F.sum("monthly_revenue")).first()[0]
    assert total == act.agg(F.sum("revenue")).first()[0]
