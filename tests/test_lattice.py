"""Roll-up lattice == joins of campaign marts, over campaigns that miss a side and over empty tables."""

import pytest
from pyspark.sql import functions as F

from acqlens.operators import cohort, exports, lattice, marts, metrics
from acqlens.operators.staging import stg_campaigns
from acqlens.sources.driver import model_from_driver
from fixtures import campaign, converted_lead, customer, make_model, open_lead, order, spend_row


@pytest.fixture(scope="module")
def gaps(spark):
    """Every combination of (spend, leads, customers) occurs among campaigns 1 to 16 of two channels; 99 is no campaign, 7 has no channel."""
    ids = range(1, 17)
    return make_model(
        spark,
        channels=[(1, "Email"), (2, "Referral")],
        campaigns=[campaign(i, 3 if i == 7 else 1 + i % 2) for i in ids],
        spend=[spend_row(i, f"2025-01-0{d}", 10 * i + d) for i in ids if i & 1 for d in (1, 2)] + [spend_row(99, "2025-01-01", 500)],
        leads=[converted_lead(10 * i, i, "2025-01-10", i) for i in ids if i & 2] + [converted_lead(10 * i + 1, i, "2025-01-11", i) for i in ids if i & 2]
        + [open_lead(10 * i + 2, i, "2025-01-10") for i in ids if i & 2] + [converted_lead(990, 99, "2025-01-10", 4)],
        customers=[customer(10 * i + c, i, f"2025-01-1{c}") for i in ids if i & 4 for c in (0, 1, 2)],
        orders=[order(100 * i + c, 10 * i + c % 3, f"2025-0{1 + c}-15", 7 * i + c) for i in ids if i & 4 for c in (0, 1, 3, 4)],
    )


@pytest.fixture(scope="module")
def driver_model(spark):
    m = model_from_driver(spark, "/root/testdata/sf0.001")
    hot = F.when(F.col("order_id") % 3 == 0, F.lit(1)).otherwise(F.col("customer_id"))
    return m.replace(orders=m.orders.withColumn("customer_id", hot))


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def joined(m, spend, funnel, revenue):
    sides = [(spend, marts.mart_campaign_spend(m)), (funnel, marts.mart_campaign_funnel(m)), (revenue, marts.mart_campaign_revenue(m).drop("channel_id"))]
    df = stg_campaigns(m)
    for wanted, side in sides:
        if wanted:
            df = df.join(side, "campaign_id")
    columns = [c for c in ("total_spend", "lead_count", "converted_lead_count", "acquired_customer_count",
                           "revenue_in_campaign_window", "revenue_lifetime_to_date") if c in df.columns]
    return df.groupBy("channel_name").agg(*(F.sum(c).cast("decimal(28,2)" if c in lattice.MONEY_SUMS else "bigint").alias(c) for c in columns))


@pytest.mark.parametrize("model", ["gaps", "driver_model"])
@pytest.mark.parametrize("sides", ["010", "110", "101", "111"])
def test_channel_sums_equal_joins(request, model, sides):
    m = request.getfixturevalue(model)
    wanted = [s == "1" for s in sides]
    names = [n for n, w in zip((lattice.SPEND, lattice.FUNNEL, lattice.REVENUE), wanted) if w]
    want = joined(m, *wanted)
    assert want.count() > 0
    assert same(want, lattice.channel_sums(m, *names))


@pytest.mark.parametrize("model", ["gaps", "driver_model"])
def test_ledger_equals_marts(request, model):
    """Retention, lifetime and 90-day value of the one pass against the marts that compute them apart."""
    m = request.getfixturevalue(model)
    ledger = lattice.channel_ledger(m)
    stats = metrics.customer_stats(m, "channel").select("channel_name", "avg_ltv_lifetime", "avg_ltv_90d")
    for k in marts.CHECKPOINT_MONTHS:
        at = cohort.mart_channel_retention(m).where(F.col("months_since_acquisition") == k)
        stats = stats.join(at.select("channel_name", F.col("retention_rate_pct").alias(f"retention_month_{k}_pct")), "channel_name", "left")
    met = joined(m, True, True, True)
    whole = met.agg(F.sum("total_spend").cast("decimal(28,2)").alias("account_spend"), F.sum("acquired_customer_count").alias("account_customers"))
    want = met.join(stats, "channel_name").crossJoin(whole)
    assert want.count() > 0
    assert same(want, ledger)


def test_totals_count_what_channels_miss(gaps):
    row = exports.pbi_executive_summary(gaps).first()
    assert row["total_spend"] == gaps.daily_campaign_spend.agg(F.sum("spend_amount")).first()[0]
    assert row["total_customers"] == gaps.customers.count()
    assert metrics.funnel_totals(gaps).first()["total_leads"] == gaps.leads.count()
    inside = gaps.customers.where("first_campaign_id <> 7").join(gaps.orders, "customer_id", "left")
    mean = inside.agg(F.sum("order_amount") / F.countDistinct("customer_id")).first()[0]
    assert abs(row["avg_ltv_lifetime"] - mean) < 0.01
    assert row["total_revenue"] == gaps.orders.agg(F.sum("order_amount")).first()[0]


def test_empty_tables(spark):
    m = make_model(spark)
    assert lattice.channel_ledger(m).collect() == [] and exports.pbi_channel_performance(m).collect() == []
    assert metrics.budget_allocation(m).collect() == [] and metrics.funnel_by_channel(m).collect() == []
    row = exports.pbi_executive_summary(m).first()
    assert row["total_customers"] == 0 and row["total_spend"] is None and row["roas_lifetime"] is None
    assert metrics.funnel_totals(m).first()["total_leads"] is None
