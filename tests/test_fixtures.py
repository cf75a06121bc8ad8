"""Hand-written edge fixtures for the semantic traps (FIXTURES.md F1-F23)."""

from decimal import Decimal

from pyspark.sql import functions as F

from acqlens.functions.exprs import avg_round
from acqlens.operators import cohort, exports, legacy, marts, metrics, quality, rfm
from fixtures import (D, M, campaign, converted_lead, customer, make_model, open_lead, order,
                      spend_row)

CHANNELS = [(1, "Email"), (2, "Referral")]


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def base_model(spark, **over):
    """Two channels, campaigns 10 (Email) and 20 (Referral), a few customers with orders."""
    parts = dict(
        channels=CHANNELS,
        campaigns=[campaign(10, 1), campaign(20, 2)],
        spend=[spend_row(10, "2025-01-05", 100), spend_row(20, "2025-01-06", 50)],
        customers=[customer(1, 10, "2025-01-10"), customer(2, 20, "2025-01-11")],
        leads=[converted_lead(1, 10, "2025-01-10", 1), converted_lead(2, 20, "2025-01-11", 2),
               open_lead(3, 10, "2025-01-12")],
        orders=[order(1, 1, "2025-01-12", 40), order(2, 2, "2025-02-01", 60)],
    )
    parts.update(over)
    return make_model(spark, **parts)


def test_f1_campaign_without_customers(spark):
    m = base_model(spark,
                   campaigns=[campaign(10, 1), campaign(20, 2), campaign(30, 1)],
                   spend=[spend_row(10, "2025-01-05", 100), spend_row(20, "2025-01-06", 50),
                          spend_row(30, "2025-01-07", 70)],
                   leads=[converted_lead(1, 10, "2025-01-10", 1), converted_lead(2, 20, "2025-01-11", 2),
                          open_lead(3, 30, "2025-01-12")])
    cac = by(metrics.cac_by_campaign(m), "campaign_id")
    assert cac[30]["cac"] is None and cac[30]["acquired_customer_count"] == 0
    ordered = [r["campaign_id"] for r in metrics.cac_by_campaign(m, sort=True).collect()]
    assert ordered[-1] == 30  # NULL CAC sorts last
    assert 30 not in by(metrics.roas_by_campaign(m), "campaign_id")
    assert 30 not in by(metrics.performance_by_campaign(m), "campaign_id")
    assert 30 not in by(metrics.contribution_by_campaign(m), "campaign_id")
    # its spend counts in the CAC roll-up and the executive summary, not in ROAS
    assert by(metrics.cac_by_channel(m), "channel_name")["Email"]["total_spend"] == M(170)
    assert by(metrics.roas_by_channel(m), "channel_name")["Email"]["total_spend"] == M(100)
    assert exports.pbi_executive_summary(m).first()["total_spend"] == M(220)
    info = quality.zero_customer_campaigns(m).collect()
    assert [(r["campaign_name"], r["cac"]) for r in info] == [("C30", None)]


def test_f2_campaign_without_leads(spark):
    m = base_model(spark, campaigns=[campaign(10, 1), campaign(20, 2), campaign(40, 2)],
                   spend=[spend_row(10, "2025-01-05", 100), spend_row(20, "2025-01-06", 50),
                          spend_row(40, "2025-01-07", 5)])
    assert 40 not in by(metrics.funnel_by_campaign(m), "campaign_id")
    assert 40 not in by(metrics.cac_by_campaign(m), "campaign_id")


def test_f3_customer_without_orders(spark):
    m = base_model(spark, customers=[customer(1, 10, "2025-01-10"), customer(2, 20, "2025-01-11"),
                                     customer(3, 10, "2025-01-15")])
    cr = by(marts.mart_customer_revenue(m), "customer_id")
    assert cr[3]["order_count"] == 0 and cr[3]["lifetime_revenue_to_date"] == M(0)
    assert cr[3]["first_order_date"] is None
    assert 3 not in by(rfm.mart_customer_rfm(m), "customer_id")
    checks = by(quality.analytics_checks(m), "check_name")
    assert checks["RFM: segment counts sum to total customers"]["failing_rows"] == 1
    assert checks["RFM: segment counts sum to total customers"]["status"] == "FAIL"


def test_f4_signup_after_last_order_month(spark):
    m = base_model(spark, customers=[customer(1, 10, "2025-01-10"), customer(2, 20, "2025-01-11"),
                                     customer(3, 10, "2025-05-15")])
    spine = marts_spine = cohort.mart_customer_cohort_spine(m)
    assert spine.where("customer_id = 3").count() == 0
    assert marts_spine.count() == 4  # customers 1 and 2: Jan and Feb (reference month)
    assert cohort.mart_channel_retention(m).count() > 0


def test_f5_f6_ninety_day_window(spark):
    m = base_model(spark, orders=[order(1, 1, "2025-04-10", 10),   # signup + 90
                                  order(2, 1, "2025-04-11", 20),   # signup + 91
                                  order(3, 1, "2025-01-01", 5),    # before signup (F6)
                                  order(4, 2, "2025-07-01", 1)])
    ltv = by(marts.mart_ltv_90d(m), "customer_id")
    assert ltv[1]["ltv_90d"] == M(15)
    assert ltv[1]["window_complete"] is True
    checks = by(quality.data_quality_checks(m), "check_name")
    assert checks["Order date >= customer signup_date"]["failing_rows"] == 1


def test_f7_empty_orders(spark):
    m = base_model(spark, orders=[])
    assert marts.mart_reference_date(m).first()["reference_date"] is None
    assert all(r["window_complete"] is None for r in marts.mart_ltv_90d(m).collect())
    l90 = metrics.ltv_90d_by_channel(m).collect()
    assert all(r["customers_with_complete_window"] == 0 and r["excluded_incomplete_window"] == 0 for r in l90)
    dq = by(quality.data_quality_checks(m), "check_name")
    assert dq["Reconciliation: customer-level revenue sum = orders total"]["status"] == "FAIL"
    ac = by(quality.analytics_checks(m), "check_name")
    assert ac["LTV: sum of customer lifetime LTV = sum of order revenue"]["status"] == "FAIL"
    assert ac["RFM: segment counts sum to total customers"]["status"] == "FAIL"
    assert ac["Profitability: total revenue_lifetime reconciles with Phase 2 mart"]["status"] == "PASS"


def test_f8_f9_month_edges(spark):
    m = base_model(spark, customers=[customer(1, 10, "2025-01-31"), customer(2, 20, "2025-01-11")],
                   orders=[order(1, 1, "2025-02-01", 10), order(2, 1, "2025-02-20", 5),
                           order(3, 2, "2025-01-12", 7)])
    act = {(r["customer_id"], r["months_since_acquisition"]): r
           for r in cohort.mart_customer_month_activity(m).collect()}
    assert act[(1, 0)]["is_active"] is False
    assert act[(1, 1)]["is_active"] is True and act[(1, 1)]["orders_count"] == 2
    ret = {(r["channel_name"], r["months_since_acquisition"]): r for r in cohort.mart_channel_retention(m).collect()}
    assert ret[("Email", 1)]["active_customers"] == 1


def test_f10_window_before_filter(spark):
    # one cohort (Jan) of size 2, monthly revenue 10, 0, 5, 0, 1 for months 0..4
    m = base_model(
        spark,
        customers=[customer(1, 10, "2025-01-10"), customer(2, 10, "2025-01-11")],
        leads=[converted_lead(1, 10, "2025-01-10", 1), converted_lead(2, 10, "2025-01-11", 2)],
        orders=[order(1, 1, "2025-01-12", 10), order(2, 1, "2025-03-03", 5), order(3, 2, "2025-05-05", 1)])
    got = {r["months_since_acquisition"]: r["cumulative_ltv_per_customer"]
           for r in cohort.cohort_ltv_checkpoints(m).collect()}
    assert got[3] == Decimal("7.50")
    assert got[0] == Decimal("5.00") and got[1] == Decimal("5.00")


def test_f13_segment_rules(spark):
    df = spark.createDataFrame(
        [(5, 5, 5, 1, "Champions"), (4, 1, 1, 1, "New"), (1, 2, 2, 3, "Lapsed"), (2, 3, 1, 2, "At Risk"),
         (3, 3, 3, 4, "Loyal"), (3, 1, 5, 2, "Needs Attention")],
        "recency_score int, frequency_score int, monetary_score int, frequency long, want string")
    got = df.withColumn("segment", rfm.segment_rule()).collect()
    assert all(r["segment"] == r["want"] for r in got)


def test_f14_avg_rounds_once(spark):
    n = 1_000_003
    df = spark.range(n).select(F.when(F.col("id") < 500_001, F.lit(Decimal("0.01")))
                               .otherwise(F.lit(Decimal("0.00"))).cast("decimal(12,2)").alias("x"))
    row = df.agg(avg_round(F.sum("x"), F.count("x")).alias("exact"),
                 F.round(F.avg("x"), 2).alias("naive")).first()
    assert row["exact"] == Decimal("0.00")


def _f15_model(spark):
    # Email: 5 customers, spend 502.00 -> CAC 100.40; Referral: 5 customers, spend 498.00 -> CAC 99.60;
    # dataset average CAC 100.00; every customer has one order of 400.00
    custs = [customer(i, 10 if i <= 5 else 20, "2025-01-10") for i in range(1, 11)]
    leads = [converted_lead(i, 10 if i <= 5 else 20, "2025-01-10", i) for i in range(1, 11)]
    orders = [order(i, i, "2025-01-12", 400) for i in range(1, 11)]
    return base_model(spark, customers=custs, leads=leads, orders=orders,
                      spend=[spend_row(10, "2025-01-05", 502), spend_row(20, "2025-01-06", 498)])


def test_f15_two_recommendation_rules(spark):
    m = _f15_model(spark)
    budget = by(metrics.budget_allocation(m), "channel_name")
    export = by(exports.pbi_channel_performance(m), "channel_name")
    assert budget["Email"]["cac"] == M("100.40")
    assert budget["Email"]["cac_vs_avg_ratio"] == M("1.00")
    assert budget["Email"]["recommendation"] == "Scale candidate"
    assert export["Email"]["recommendation"] == "Maintain / monitor"
    assert budget["Referral"]["recommendation"] == export["Referral"]["recommendation"] == "Scale candidate"


def test_f16_rounded_vs_unrounded_cac(spark):
    custs = [customer(i, 10, "2025-01-10") for i in (1, 2, 3)]
    leads = [converted_lead(i, 10, "2025-01-10", i) for i in (1, 2, 3)]
    orders = [order(i, i, "2025-01-12", 50) for i in (1, 2, 3)]
    m = base_model(spark, customers=custs, leads=leads, orders=orders,
                   spend=[spend_row(10, "2025-01-05", 10)])
    assert by(metrics.ltv_cac_by_campaign(m), "campaign_id")[10]["ltv_cac_lifetime"] == M("15.02")
    assert by(metrics.profitability_by_campaign(m), "campaign_id")[10]["ltv_cac_lifetime"] == M("15.00")
    assert by(exports.pbi_campaign_performance(m), "campaign_id")[10]["ltv_cac_lifetime"] == M("15.00")


def test_f17_rank_ties_skip(spark):
    m = base_model(
        spark,
        campaigns=[campaign(10, 1), campaign(11, 1), campaign(12, 1), campaign(20, 2)],
        leads=[converted_lead(1, 10, "2025-01-10", 1), open_lead(3, 10, "2025-01-12"),
               converted_lead(4, 11, "2025-01-10", 4), open_lead(5, 11, "2025-01-12"),
               open_lead(6, 12, "2025-01-12"), converted_lead(2, 20, "2025-01-11", 2)])
    ranks = {r["campaign_id"]: r["conv_rate_rank_in_channel"] for r in metrics.funnel_by_campaign(m).collect()}
    assert ranks[10] == ranks[11] == 1 and ranks[12] == 3


def test_f19_monthly_trend_full_outer(spark):
    m = base_model(spark, spend=[spend_row(10, "2025-03-05", 100)],
                   orders=[order(1, 1, "2025-01-12", 40)])
    trend = {r["month"]: (r["total_spend"], r["total_revenue"]) for r in exports.pbi_monthly_trend(m).collect()}
    assert trend[D("2025-03-01")] == (M(100), M(0))
    assert trend[D("2025-01-01")] == (M(0), M(40))


def test_f20_campaign_window_inclusive(spark):
    m = base_model(spark, campaigns=[campaign(10, 1, "2025-01-10", "2025-01-20"), campaign(20, 2)],
                   orders=[order(1, 1, "2025-01-10", 1), order(2, 1, "2025-01-20", 2),
                           order(3, 1, "2025-01-09", 4), order(4, 1, "2025-01-21", 8)])
    rev = by(marts.mart_campaign_revenue(m), "campaign_id")[10]
    assert rev["revenue_in_campaign_window"] == M(3)
    assert rev["revenue_lifetime_to_date"] == M(15)


def test_f21_each_check_fails_once(spark):
    m = base_model(
        spark,
        campaigns=[campaign(10, 1), campaign(20, 2), campaign(21, 9, "2025-02-01", "2025-01-01")],
        spend=[spend_row(10, "2025-01-05", 100), spend_row(20, "2025-01-06", 50),
               spend_row(20, "2026-01-06", -1)],
        orders=[order(1, 1, "2025-01-12", 40), order(2, 2, "2025-02-01", 60), order(2, 99, "2025-02-01", 1)])
    dq = by(quality.data_quality_checks(m), "check_name")
    for name in ["PK uniqueness: orders", "Orphans: campaigns.channel_id -> channels",
                 "Orphans: orders.customer_id -> customers", "Non-negative spend",
                 "Campaign dates: end >= start", "Spend dates within campaign window"]:
        assert dq[name]["failing_rows"] == 1, name
        assert dq[name]["status"] == "FAIL", name
    assert dq["PK uniqueness: channels"]["status"] == "PASS"
    # the orphan order also breaks the customer revenue reconciliation
    assert dq["Reconciliation: customer-level revenue sum = orders total"]["failing_rows"] == M(1)
    ordered = quality.data_quality_checks(m, sort=True).collect()
    assert ordered[0]["status"] == "PASS" and ordered[-1]["status"] == "FAIL"


def test_f22_f23_legacy_tiers(spark):
    users = spark.createDataFrame([(1, D("2025-01-01"), Decimal("0.1004"))],
                                  "user_id long, signup_date date, churn_probability decimal(5,4)")
    revenue = spark.createDataFrame([(1, M(10)), (1, M(20)), (1, M(30))], "user_id long, revenue decimal(12,2)")
    t = {"users": users, "revenue": revenue}
    assert legacy.loyalty_tiers(t).first()["client_loyalty"] == "Loyal Client"
    l5 = legacy.user_revenue_tiers(t).collect()
    assert len(l5) == 3
    assert {(r["lifetime_value"], r["client_loyalty"]) for r in l5} == {(Decimal("60"), "High Potential Client")}
