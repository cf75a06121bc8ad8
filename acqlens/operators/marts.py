"""Mart operators M1-M5 and M10, plus the shared customer-grain intermediates.

Two shared customer-grain plans:

* ``customer_totals`` (M4, M9, Q12-Q14) aggregates orders straight by
  ``customer_id``: one shuffle of order rows. Map-side partial sums turn a
  customer that owns a third of all orders into one row per task.
* ``customer_facts`` (M3, M10 and what reports them) also needs sums over date
  windows that are known only after the join with the customer. Orders join their
  customer as they are, in one shuffle, but for those of heavy customers
  (``heavy_customers``): these are reduced to (customer, day) first, so a hot customer
  is at most one row per day when it meets its attributes.

The per-(customer, month) aggregate feeds the cohort operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import SUM_MONEY, money_sum, month_start, months_between_cal
from ..plans.broadcast import few_rows, one_row
from ..sources.model import Model


# ---------------------------------------------------------------- shared

HEAVY_SHARE = 2048  # a heavy customer has at least one of so many orders, so there are at most so many of them
TRACKED = 16_384  # ids that the counter sketch tracks: its error is far below one of HEAVY_SHARE orders


def heavy_customers(m: Model) -> DataFrame:
    """(heavy_id): customers with at least 1 / HEAVY_SHARE of all orders, by a frequent-items sketch.

    The sketch is one pass over the ids without a shuffle of them, in the same plan. It
    counts no id too high by more than its error, and only decides how a customer's
    orders travel, never what they add up to.
    """
    sketch = m.orders.agg(F.expr(f"approx_top_k(customer_id, {HEAVY_SHARE}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n"))
    return sketch.select("n", F.inline("top")).where(
        F.col("item").isNotNull() & (F.col("count") * HEAVY_SHARE >= F.col("n"))).select(F.col("item").alias("heavy_id"))


def orders_for_join(m: Model) -> DataFrame:
    """Orders as (customer_id, order_date, order_rows, order_ids, amount): one row an order, but one row a day of a heavy customer."""
    def build():
        marked = m.orders.join(few_rows(heavy_customers(m)), F.col("customer_id") == F.col("heavy_id"), "left")
        light = marked.where("heavy_id is null").select(
            "customer_id", "order_date", F.lit(1).cast("bigint").alias("order_rows"),
            F.col("order_id").isNotNull().cast("bigint").alias("order_ids"), F.col("order_amount").cast(SUM_MONEY).alias("amount"))
        heavy = marked.where("heavy_id is not null").groupBy("customer_id", "order_date").agg(
            F.count(F.lit(1)).alias("order_rows"),
            F.count("order_id").alias("order_ids"),
            F.sum("order_amount").cast(SUM_MONEY).alias("amount"),
        )
        return light.union(heavy)
    return m.memo("orders_for_join", build)


def orders_monthly(m: Model) -> DataFrame:
    """Orders per (customer_id, order_month): count and revenue (M7's monthly_orders).

    Aggregated straight from the orders (one shuffle): map-side partial
    aggregation already bounds a hot customer to one row per month and task.
    """
    return m.memo("orders_monthly", lambda: m.orders.groupBy(
        "customer_id", month_start("order_date").alias("order_month")
    ).agg(
        F.count(F.lit(1)).alias("orders_count"),
        F.sum("order_amount").cast(SUM_MONEY).alias("revenue"),
    ))


def _campaign_channel_dim(m: Model) -> DataFrame:
    def build():
        dim = m.campaigns.join(m.channels, "channel_id", "left").select(
            "campaign_id", "channel_id", "channel_name", "start_date", "end_date")
        return dim
    return m.memo("campaign_channel_dim", build)


CHECKPOINT_MONTHS = (1, 3)  # months since acquisition that the channel exports report

CUSTOMER_KEYS = ["customer_id", "first_campaign_id", "channel_id", "channel_name",
                 "signup_date", "region", "start_date", "end_date"]


def _customer_rows(m: Model) -> DataFrame:
    """Distinct customer rows with their first campaign's attributes and the number of copies,
    partitioned by ``customer_id``."""
    base = m.customers.join(
        _campaign_channel_dim(m), F.col("first_campaign_id") == F.col("campaign_id")).drop("campaign_id")
    return base.repartition("customer_id").groupBy(*CUSTOMER_KEYS).agg(F.count(F.lit(1)).alias("copies"))


def customer_totals(m: Model) -> DataFrame:
    """One row per customer with order count, revenue and order dates, from one shuffle of the orders.

    ``copies`` and ``copy_*`` as in ``customer_facts``.
    """
    def build():
        per_customer = m.orders.groupBy("customer_id").agg(
            F.count(F.lit(1)).alias("copy_order_rows"),
            F.count("order_id").alias("copy_order_count"),
            F.sum("order_amount").cast(SUM_MONEY).alias("copy_revenue"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
        )
        k = F.col("copies")
        return _customer_rows(m).join(per_customer, "customer_id", "left").withColumns({
            "copy_order_rows": F.coalesce("copy_order_rows", F.lit(0)),
            "order_count": F.coalesce("copy_order_count", F.lit(0)) * k,
            "revenue": (F.col("copy_revenue") * k).cast(SUM_MONEY),
        })
    return m.shared("customer_totals", build)


def stg_customer_totals(m: Model) -> DataFrame:
    """``customer_totals`` restricted to ``stg_customers`` (channel present)."""
    return customer_totals(m).where(F.col("channel_name").isNotNull())


def customer_facts(m: Model) -> DataFrame:
    """One row per customer (joined to its first campaign) with order measures.

    ``channel_name`` is NULL when the campaign's channel is missing; such
    customers count for campaign revenue (M3 joins campaigns only) but not for
    the ``stg_customers``-based marts.

    ``copies`` counts identical customer rows (1 unless the primary key is
    violated). ``copy_*`` columns hold one copy's measures (what RFM reports per
    row); the unprefixed measures are multiplied by ``copies``, as a join of
    every copy to the orders followed by a GROUP BY yields. The customer side is
    partitioned by ``customer_id`` once, which both the copy count and the join
    reuse. ``active_month_k``: an order in the k-th calendar month after the signup.
    """
    def build():
        joined = _customer_rows(m).join(orders_for_join(m), "customer_id", "left")
        in_window = F.col("order_date").between(F.col("start_date"), F.col("end_date"))
        in_90d = F.col("order_date") <= F.date_add("signup_date", 90)
        per_copy = joined.groupBy(*CUSTOMER_KEYS, "copies").agg(
            F.coalesce(F.sum("order_rows"), F.lit(0)).alias("copy_order_rows"),
            F.coalesce(F.sum("order_ids"), F.lit(0)).alias("copy_order_count"),
            F.sum("amount").cast(SUM_MONEY).alias("copy_revenue"),
            F.sum(F.when(in_window, F.col("amount"))).cast(SUM_MONEY).alias("copy_revenue_in_window"),
            F.sum(F.when(in_90d, F.col("amount"))).cast(SUM_MONEY).alias("copy_revenue_90d"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
            *(F.bool_or(months_between_cal("order_date", "signup_date") == k).alias(f"active_month_{k}") for k in CHECKPOINT_MONTHS),
        )
        k = F.col("copies")
        return per_copy.select(
            "*",
            (F.col("copy_order_rows") * k).alias("order_rows"),
            (F.col("copy_order_count") * k).alias("order_count"),
            (F.col("copy_revenue") * k).cast(SUM_MONEY).alias("revenue"),
            (F.col("copy_revenue_in_window") * k).cast(SUM_MONEY).alias("revenue_in_window"),
            (F.col("copy_revenue_90d") * k).cast(SUM_MONEY).alias("revenue_90d"),
        )
    return m.shared("customer_facts", build)


def stg_customer_facts(m: Model) -> DataFrame:
    """``customer_facts`` restricted to ``stg_customers`` (channel present)."""
    return customer_facts(m).where(F.col("channel_name").isNotNull())


def _zero() -> F.Column:
    return F.lit(0).cast(SUM_MONEY)


# ---------------------------------------------------------------- marts

def mart_campaign_spend(m: Model) -> DataFrame:
    """M1: spend, impressions, clicks and spend date range per campaign."""
    return m.memo("mart_campaign_spend", lambda: m.daily_campaign_spend.groupBy("campaign_id").agg(
        money_sum("spend_amount").alias("total_spend"),
        F.sum("impressions").cast("bigint").alias("total_impressions"),
        F.sum("clicks").cast("bigint").alias("total_clicks"),
        F.min("spend_date").alias("first_spend_date"),
        F.max("spend_date").alias("last_spend_date"),
    ))


def mart_campaign_funnel(m: Model) -> DataFrame:
    """M2: leads, converted leads and distinct acquired customers per campaign."""
    return m.memo("mart_campaign_funnel", lambda: m.leads.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("lead_count"),
        F.count_if(F.col("converted_flag")).alias("converted_lead_count"),
        F.countDistinct("converted_customer_id").alias("acquired_customer_count"),
    ))


def mart_campaign_revenue(m: Model) -> DataFrame:
    """M3: first-touch revenue per campaign, in its run window and lifetime."""
    return m.memo("mart_campaign_revenue", lambda: customer_facts(m).groupBy(
        F.col("first_campaign_id").alias("campaign_id"), "channel_id"
    ).agg(
        F.coalesce(F.sum("revenue_in_window").cast(SUM_MONEY), _zero()).alias("revenue_in_campaign_window"),
        F.coalesce(F.sum("revenue").cast(SUM_MONEY), _zero()).alias("revenue_lifetime_to_date"),
    ))


def mart_customer_revenue(m: Model) -> DataFrame:
    """M4: observed revenue, order count and order date range per customer."""
    return m.memo("mart_customer_revenue", lambda: stg_customer_totals(m).select(
        "customer_id", "first_campaign_id",
        F.col("channel_id").alias("acquisition_channel_id"),
        F.col("channel_name").alias("acquisition_channel_name"),
        "signup_date", "region", "order_count",
        F.coalesce("revenue", _zero()).alias("lifetime_revenue_to_date"),
        "first_order_date", "last_order_date",
    ))


def mart_reference_date(m: Model) -> DataFrame:
    """M5: latest order date and its month; exactly one row."""
    return m.shared("mart_reference_date", lambda: m.orders.agg(
        F.max("order_date").alias("reference_date"),
    ).select("reference_date", month_start("reference_date").alias("reference_month")))


def reference_row(m: Model) -> DataFrame:
    """M5 marked for broadcast: a global aggregate is always one row."""
    return one_row(mart_reference_date(m))


def mart_ltv_90d(m: Model) -> DataFrame:
    """Revenue up to signup + 90 days, and whether that window has elapsed."""
    def build():
        return stg_customer_facts(m).crossJoin(reference_row(m)).select(
            "customer_id", "first_campaign_id", "channel_id", "channel_name", "signup_date",
            F.coalesce("revenue_90d", _zero()).alias("ltv_90d"),
            (F.date_add("signup_date", 90) <= F.col("reference_date")).alias("window_complete"),
        )
    return m.memo("mart_ltv_90d", build)
