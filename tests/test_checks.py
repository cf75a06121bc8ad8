"""Every validation check PASSes on a clean model and FAILs on one violating row."""

import pytest

from acqlens.operators import quality
from fixtures import D, M, campaign, converted_lead, customer, make_model, open_lead, order, spend_row

BASE = dict(
    channels=[(1, "Email"), (2, "Referral")],
    campaigns=[campaign(10, 1), campaign(20, 2)],
    spend=[spend_row(10, "2025-01-05", 100), spend_row(20, "2025-01-06", 50)],
    customers=[customer(1, 10, "2025-01-10"), customer(2, 20, "2025-01-11")],
    leads=[converted_lead(1, 10, "2025-01-10", 1), converted_lead(2, 20, "2025-01-11", 2),
           open_lead(3, 10, "2025-01-12")],
    orders=[order(1, 1, "2025-01-12", 40), order(2, 2, "2025-02-01", 60)],
)


def model(spark, **changes):
    parts = {k: list(v) for k, v in BASE.items()}
    for key, value in changes.items():
        if key.endswith("_plus"):
            parts[key[:-5]] = parts[key[:-5]] + value
        else:
            parts[key] = value
    return make_model(spark, nullable=True, **parts)


SUITES = [quality.data_quality_checks, quality.analytics_checks, quality.constraint_checks]


def statuses(m, suites=SUITES):
    out = {}
    for suite in suites:
        for r in suite(m).collect():
            out[r["check_name"]] = (r["failing_rows"], r["status"])
    return out


@pytest.fixture(scope="module")
def owner(spark):
    """check name -> the suite that reports it (from the clean model)."""
    clean = model(spark)
    return {r["check_name"]: suite for suite in SUITES for r in suite(clean).collect()}


def test_clean_model_passes_everything(spark):
    got = statuses(model(spark))
    assert len(got) == 25 + 11 + 12
    assert {name for name, (_, status) in got.items() if status != "PASS"} == set()


CASES = [
    ("PK uniqueness: channels", dict(channels_plus=[(1, "Email again")]), 1),
    ("PK uniqueness: campaigns", dict(campaigns_plus=[campaign(10, 1, name="dup")]), 1),
    ("PK uniqueness: customers", dict(customers_plus=[customer(1, 10, "2025-01-10")]), 1),
    ("PK uniqueness: leads", dict(leads_plus=[open_lead(3, 10, "2025-01-13")]), 1),
    ("PK uniqueness: orders", dict(orders_plus=[order(1, 1, "2025-01-13", 5)]), 1),
    ("Required fields: campaigns (channel_id/dates)",
     dict(campaigns_plus=[(30, 1, "C30", None, D("2025-03-01"), "Conversions")]), 1),
    ("Required fields: customers (first_campaign_id/signup_date)",
     dict(customers_plus=[(3, 10, None, "EU")]), 1),
    ("Required fields: orders (customer_id/order_date/order_amount)",
     dict(orders_plus=[(3, 1, D("2025-01-20"), None)]), 1),
    ("Orphans: campaigns.channel_id -> channels", dict(campaigns_plus=[campaign(30, 9)]), 1),
    ("Orphans: customers.first_campaign_id -> campaigns", dict(customers_plus=[customer(3, 99, "2025-01-10")]), 1),
    ("Orphans: leads.campaign_id -> campaigns", dict(leads_plus=[open_lead(4, 99, "2025-01-12")]), 1),
    ("Orphans: orders.customer_id -> customers", dict(orders_plus=[order(3, 99, "2025-01-12", 5)]), 1),
    ("Non-negative spend", dict(spend_plus=[spend_row(10, "2025-01-07", -1)]), 1),
    ("Positive order amounts", dict(orders_plus=[order(3, 1, "2025-01-20", 0)]), 1),
    ("Campaign dates: end >= start", dict(campaigns_plus=[campaign(30, 1, "2025-02-01", "2025-01-01")]), 1),
    ("Spend dates within campaign window", dict(spend_plus=[spend_row(10, "2026-01-05", 5)]), 1),
    ("Lead conversion flag consistency", dict(leads_plus=[(4, 10, D("2025-01-12"), True, None)]), 1),
    ("Converted leads map to exactly one customer each (no duplicate customer reuse)",
     dict(leads_plus=[converted_lead(4, 10, "2025-01-10", 1)]), 1),
    ("Converted lead campaign matches customer first_campaign_id",
     dict(leads=[converted_lead(1, 20, "2025-01-10", 1), converted_lead(2, 20, "2025-01-11", 2)]), 1),
    ("Converted lead date matches customer signup_date",
     dict(leads=[converted_lead(1, 10, "2025-01-09", 1), converted_lead(2, 20, "2025-01-11", 2)]), 1),
    ("Order date >= customer signup_date", dict(orders_plus=[order(3, 1, "2025-01-01", 5)]), 1),
    ("Reconciliation: campaign-level acquired customers sum = customers table total",
     dict(customers_plus=[customer(3, 10, "2025-01-15")]), 1),
    ("Reconciliation: customer-level revenue sum = orders total",
     dict(orders_plus=[order(3, 99, "2025-01-12", 5)]), 5),
    ("Cohort: every customer maps to exactly one cohort_month",
     dict(customers_plus=[customer(1, 10, "2025-02-10")]), 1),
    ("RFM: every customer appears exactly once", dict(customers_plus=[customer(1, 10, "2025-01-10")]), 1),
    ("RFM: no null recency/frequency/monetary values",
     dict(orders=[order(1, 1, "2025-01-12", 40), (2, 2, D("2025-02-01"), None)]), 1),
    ("RFM: segment counts sum to total customers", dict(customers_plus=[customer(3, 10, "2025-01-15")]), 1),
    ("LTV: sum of customer lifetime LTV = sum of order revenue", dict(orders_plus=[order(3, 99, "2025-01-12", 5)]), 5),
    ("LTV:CAC: total customers across channels = total customers table",
     dict(customers_plus=[customer(3, 10, "2025-01-15")]), 1),
    ("Profitability: total revenue_lifetime reconciles with Phase 2 mart",
     dict(campaigns_plus=[campaign(30, 9)], customers_plus=[customer(3, 30, "2025-01-15")],
          orders_plus=[order(3, 3, "2025-01-20", 7)]), 7),
    ("UNIQUE: channels.channel_name", dict(channels_plus=[(3, "Email")]), 1),
    ("NOT NULL: channels", dict(channels_plus=[(3, None)]), 1),
    ("NOT NULL: campaigns (campaign_id/campaign_name/objective)",
     dict(campaigns_plus=[(30, 1, None, D("2025-01-01"), D("2025-02-01"), "Conversions")]), 1),
    ("PK uniqueness: daily_campaign_spend (campaign_id, spend_date)",
     dict(spend_plus=[spend_row(10, "2025-01-05", 1)]), 1),
    ("Non-negative impressions", dict(spend_plus=[spend_row(10, "2025-01-08", 1, impressions=-1)]), 1),
    ("Non-negative clicks", dict(spend_plus=[spend_row(10, "2025-01-08", 1, clicks=-1)]), 1),
    ("NOT NULL: daily_campaign_spend", dict(spend_plus=[(10, D("2025-01-08"), None, 1, 1)]), 1),
    ("NOT NULL: leads (lead_id/campaign_id/lead_date/converted_flag)",
     dict(leads_plus=[(5, 10, None, False, None)]), 1),
    ("NOT NULL: customers.customer_id", dict(customers_plus=[(None, 10, D("2025-01-10"), "EU")]), 1),
    ("NOT NULL: orders.order_id", dict(orders_plus=[(None, 1, D("2025-01-20"), M(5))]), 1),
    ("Orphans: daily_campaign_spend.campaign_id -> campaigns", dict(spend_plus=[spend_row(99, "2025-01-05", 1)]), 1),
    ("Orphans: leads.converted_customer_id -> customers",
     dict(leads_plus=[converted_lead(6, 10, "2025-01-10", 77)]), 1),
]


@pytest.mark.parametrize("check,change,expected", CASES, ids=[c[0][:60] for c in CASES])
def test_one_violation_fails_its_check(spark, owner, check, change, expected):
    failing, status = statuses(model(spark, **change), [owner[check]])[check]
    assert status == "FAIL"
    assert failing == M(expected)
