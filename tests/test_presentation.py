"""sort=True reproduces the original statements' ORDER BY, with Postgres null placement."""

from acqlens.operators import metrics, quality
from fixtures import campaign, converted_lead, customer, make_model, open_lead, order, spend_row


def _model(spark):
    return make_model(
        spark,
        channels=[(1, "Email"), (2, "Referral")],
        campaigns=[campaign(10, 1), campaign(11, 1), campaign(20, 2)],
        spend=[spend_row(10, "2025-01-05", 100), spend_row(11, "2025-01-05", 30),
               spend_row(20, "2025-01-06", 50)],
        customers=[customer(1, 10, "2025-01-10"), customer(2, 20, "2025-01-11")],
        leads=[converted_lead(1, 10, "2025-01-10", 1), converted_lead(2, 20, "2025-01-11", 2),
               open_lead(3, 11, "2025-01-12")],
        orders=[order(1, 1, "2025-01-12", 400), order(2, 2, "2025-02-01", 60)],
    )


def test_cac_ascending_nulls_last(spark):
    rows = metrics.cac_by_campaign(_model(spark), sort=True).collect()
    assert [r["campaign_id"] for r in rows] == [20, 10, 11]   # 50.00, 100.00, NULL
    assert rows[-1]["cac"] is None


def test_roas_descending_nulls_last(spark):
    rows = metrics.roas_by_campaign(_model(spark), sort=True).collect()
    assert [r["campaign_id"] for r in rows] == [10, 20]       # 4.00, 1.20


def test_funnel_by_channel_then_rank(spark):
    rows = metrics.funnel_by_campaign(_model(spark), sort=True).collect()
    assert [(r["channel_name"], r["conv_rate_rank_in_channel"]) for r in rows] == \
        [("Email", 1), ("Email", 2), ("Referral", 1)]


def test_checks_pass_rows_first(spark):
    rows = quality.data_quality_checks(_model(spark), sort=True).collect()
    statuses = [r["status"] for r in rows]
    assert statuses == sorted(statuses, reverse=True)
    passing = [r["check_name"] for r in rows if r["status"] == "PASS"]
    assert passing == sorted(passing)
