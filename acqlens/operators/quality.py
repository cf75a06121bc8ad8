"""Data-quality and analytics-invariant suites.

Every suite returns rows ``(check_name, failing_rows, status)`` with status
PASS iff ``failing_rows = 0`` (a NULL count - e.g. a reconciliation over empty
tables - is FAIL). Spark plan shape:

* V1-V8 are expressions over one row of facts, gathered by two groupings: what meets
  on the customer's key, and what meets on the campaign's (``_check_facts``);
* V9-V13 are expressions over one row too: marts and tables as partial rows, summed
  once (``_invariant_facts``);
* elsewhere single-table checks of one table run as **one** aggregate pass over it
  (all counts side by side), then unpivot into rows;
* other orphan checks pre-aggregate the fact side on the join key first (a hot
  customer or campaign arrives as one row), then anti join the dimension.

Check names are fixed values: they must equal the reference's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import SUM_MONEY, pct2, rounded_ratio
from ..plans.broadcast import one_row
from ..sources.model import Model
from .cohort import cohort_sizes, mart_channel_retention
from .marts import (mart_campaign_funnel, mart_campaign_revenue, mart_campaign_spend,
                    reference_row, stg_customer_totals)
from .staging import stg_campaigns

FAILING = T.DecimalType(24, 2)


def _rows(agg: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """One aggregate row -> one output row per named check."""
    structs = [F.struct(F.lit(name).alias("check_name"), expr.cast(FAILING).alias("failing_rows"))
               for name, expr in checks]
    return agg.select(F.inline(F.array(*structs)))


def _single(name: str, df: DataFrame, expr: Column) -> DataFrame:
    return df.agg(expr.cast(FAILING).alias("failing_rows")).select(
        F.lit(name).alias("check_name"), "failing_rows")


def _finish(parts: list[DataFrame], sort: bool) -> DataFrame:
    df = reduce(DataFrame.unionByName, parts).withColumn(
        "status", F.when(F.col("failing_rows") == 0, F.lit("PASS")).otherwise(F.lit("FAIL")))
    return df.orderBy(F.col("status").desc(), "check_name") if sort else df


def _dup(pk) -> Column:
    cols = pk if isinstance(pk, (list, tuple)) else [pk]
    return F.count(F.lit(1)) - F.countDistinct(*[F.col(c) for c in cols])


def _count_if(cond: Column) -> Column:
    return F.count_if(cond)


def _anti_count(fact: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Rows of ``fact`` whose ``key`` has no match in ``dim`` (NULL keys count).

    The fact side is first reduced to (key, rows) so a hot key is one row.
    """
    per_key = fact.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    keys = dim.select(F.col(dim_key).alias(key))
    return per_key.join(keys, key, "left_anti").agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("_v"))


# -------------------------------------------------------------- V1-V8 (25 checks)

def data_quality_checks(m: Model, sort: bool = False) -> DataFrame:
    """V1-V8: keys, required fields, orphans, value ranges, lead consistency,
    order dates and reconciliations.

    One row of facts (``_check_facts``) holds every count and sum; the checks are
    expressions over it. Orders and leads are scanned twice, all other fact tables once.
    """
    f = F.col
    reconciled = lambda left, right: F.abs(f(left) - f(right))
    df = _rows(_check_facts(m), [
        ("PK uniqueness: channels", f("channel_dups")),
        ("PK uniqueness: campaigns", f("campaign_dups")),
        ("PK uniqueness: customers", f("customer_dups")),
        ("PK uniqueness: leads", f("lead_rows") - f("lead_ids")),
        ("PK uniqueness: orders", f("order_dups")),
        ("Required fields: customers (first_campaign_id/signup_date)", f("customers_incomplete")),
        ("Required fields: orders (customer_id/order_date/order_amount)", f("orders_incomplete")),
        ("Required fields: campaigns (channel_id/dates)", f("campaigns_incomplete")),
        ("Orphans: campaigns.channel_id -> channels", f("campaign_orphans")),
        ("Orphans: leads.campaign_id -> campaigns", f("lead_orphans")),
        ("Orphans: customers.first_campaign_id -> campaigns", f("customer_orphans")),
        ("Orphans: orders.customer_id -> customers", f("order_orphans")),
        ("Campaign dates: end >= start", f("campaigns_reversed")),
        ("Spend dates within campaign window", f("spend_outside")),
        ("Non-negative spend", f("spend_negative")),
        ("Positive order amounts", f("orders_not_positive")),
        ("Lead conversion flag consistency", f("leads_inconsistent")),
        ("Converted leads map to exactly one customer each (no duplicate customer reuse)", f("customers_reused")),
        ("Converted lead campaign matches customer first_campaign_id", f("lead_campaign_differs")),
        ("Converted lead date matches customer signup_date", f("lead_date_differs")),
        ("Order date >= customer signup_date", f("orders_early")),
        ("Reconciliation: campaign-level leads sum = table total", reconciled("leads_by_campaign", "lead_rows")),
        ("Reconciliation: campaign-level acquired customers sum = customers table total",
         F.when(f("leads_by_campaign").isNotNull(), reconciled("acquired", "customer_rows"))),
        ("Reconciliation: campaign-level spend sum = daily_campaign_spend total", reconciled("spend_by_campaign", "spend_total")),
        ("Reconciliation: customer-level revenue sum = orders total", reconciled("staged_revenue", "orders_total")),
    ])
    return _finish([df], sort)


def _total(column: str, value: str, zero: str = "0L") -> str:
    """SQL: the sum of ``value`` (over x) for the elements x of an array."""
    return f"aggregate({column}, {zero}, (sum, x) -> sum + coalesce({value}, {zero}))"


def _customer_pass(m: Model) -> DataFrame:
    """Orders, customers and converted leads met on the customer's key in one grouping.

    Every side is first reduced to the values that checks compare - (customer, day),
    (customer, campaign, signup), (customer, campaign, day, flag) - so the lists of
    a hot customer are bounded by days and campaigns. Rows: for every customer record its
    campaign with the record's count and revenue, and for every key the check counts (campaign NULL).
    """
    days = m.orders.groupBy("customer_id", "order_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("order_amount").cast(SUM_MONEY).alias("amount")).select(
        F.col("customer_id").alias("key"), F.struct(F.col("order_date").alias("day"), "n", "amount").alias("o"))
    records = m.customers.groupBy("customer_id", "first_campaign_id", "signup_date").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("customer_id").alias("key"), F.struct(F.col("first_campaign_id").alias("campaign"), F.col("signup_date").alias("signup"), "n").alias("c"))
    leads = m.leads.where(F.col("converted_customer_id").isNotNull()).groupBy(
        "converted_customer_id", "campaign_id", "lead_date", "converted_flag").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("converted_customer_id").alias("key"),
        F.struct(F.col("campaign_id").alias("campaign"), F.col("lead_date").alias("day"), F.col("converted_flag").alias("flag"), "n").alias("l"))
    met = days.unionByName(records, allowMissingColumns=True).unionByName(leads, allowMissingColumns=True).groupBy("key").agg(
        *(F.collect_list(c).alias(c) for c in "ocl"))
    zero = "cast(0 as decimal(28, 2))"
    counted = met.withColumns({
        "records": F.expr(_total("c", "x.n")), "orders": F.expr(_total("o", "x.n")), "leads": F.expr(_total("l", "x.n")),
        "revenue": F.expr(f"aggregate(o, {zero}, (sum, x) -> cast(sum + coalesce(x.amount, {zero}) as decimal(28, 2)))"),
    }).withColumns({
        "known": F.expr("key is not null and records > 0"),
        "early": F.expr(_total("c", "x.n * " + "aggregate(o, 0L, (t, y) -> t + if(y.day < x.signup, y.n, 0L))")),
        "campaign_differs": F.expr(_total("c", "x.n * aggregate(l, 0L, (t, y) -> t + if(y.flag and y.campaign <> x.campaign, y.n, 0L))")),
        "date_differs": F.expr(_total("c", "x.n * aggregate(l, 0L, (t, y) -> t + if(y.flag and y.day <> x.signup, y.n, 0L))")),
    })
    return counted.select(F.inline(F.expr(f"""concat(
        transform(c, x -> struct(x.campaign as campaign_id, x.n as records, cast(if(key is null, {zero}, revenue) * x.n as decimal(28, 2)) as revenue,
          0L as customer_dups, 0L as customers_incomplete, 0L as order_orphans, 0L as orders_early, 0L as customers_reused,
          0L as lead_campaign_differs, 0L as lead_date_differs, 0L as acquired)),
        array(struct(cast(null as int) as campaign_id, 0L as records, {zero} as revenue,
          records - if(known, 1L, 0L) as customer_dups,
          {_total("c", "if(x.campaign is null or x.signup is null, x.n, 0L)")} as customers_incomplete,
          if(known, 0L, orders) as order_orphans, if(known, early, 0L) as orders_early, if(leads > 1, 1L, 0L) as customers_reused,
          if(known, campaign_differs, 0L) as lead_campaign_differs, if(known, date_differs, 0L) as lead_date_differs,
          cast(size(array_distinct(transform(l, y -> y.campaign))) as bigint) as acquired)))""")))


def _check_facts(m: Model) -> DataFrame:
    """All counts and sums of V1-V8 in one row.

    The customer pass, the leads (grouped by id and by campaign in one scan), the spend
    per campaign and day and the campaigns themselves meet on the campaign's key in
    one grouping; sums are partial before that shuffle, lists hold a campaign's records and days.
    """
    flag, cid = F.col("converted_flag"), F.col("converted_customer_id")
    leads = m.leads.withColumn("bad", F.coalesce((flag & cid.isNull()) | (~flag & cid.isNotNull()), F.lit(False)).cast("bigint")).select(
        "lead_id", "campaign_id", "bad").groupingSets([["lead_id"], ["campaign_id"]], "lead_id", "campaign_id").agg(
        F.grouping("campaign_id").alias("by_id"), F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    by_id = F.col("by_id") == 1
    lead_rows = leads.select(
        "campaign_id", F.when(by_id, F.col("n")).alias("lead_rows"),
        F.when(by_id & F.col("lead_id").isNotNull(), F.lit(1).cast("bigint")).alias("lead_ids"),
        F.when(by_id, F.col("bad")).alias("leads_inconsistent"), F.when(~by_id, F.col("n")).alias("leads_by_campaign"))
    spend = m.daily_campaign_spend.groupBy("campaign_id", "spend_date").agg(
        F.count(F.lit(1)).alias("n"), _count_if(F.col("spend_amount") < 0).alias("spend_negative"),
        F.sum("spend_amount").cast(SUM_MONEY).alias("spend_total")).select(
        "campaign_id", F.struct(F.col("spend_date").alias("day"), "n").alias("s"), "spend_negative", "spend_total")
    named = m.channels.groupBy("channel_id").agg(F.count(F.lit(1)).alias("there"), F.count("channel_name").alias("named"))
    campaigns = m.campaigns.groupBy("campaign_id", "channel_id", "start_date", "end_date").agg(F.count(F.lit(1)).alias("n")).join(
        named, "channel_id", "left").select("campaign_id", F.struct(
            "n", "channel_id", "start_date", "end_date", F.coalesce("there", F.lit(0)).alias("there"), F.coalesce("named", F.lit(0)).alias("named")).alias("k"))

    met = _customer_pass(m)
    sums = [c for c in met.columns if c != "campaign_id"]
    for side in (lead_rows, spend, campaigns):
        sums += [c for c in side.columns if c not in ("campaign_id", "s", "k")]
        met = met.unionByName(side, allowMissingColumns=True)
    met = met.groupBy("campaign_id").agg(F.collect_list("s").alias("s"), F.collect_list("k").alias("k"), *(F.sum(c).alias(c) for c in sums))
    known = F.expr("campaign_id is not null and size(k) > 0")
    outside = "aggregate(s, 0L, (t, y) -> t + if(y.day < x.start_date or y.day > x.end_date, y.n, 0L))"
    own = {
        "campaign_dups": F.expr(_total("k", "x.n") + " - if(campaign_id is not null and size(k) > 0, 1L, 0L)"),
        "campaigns_incomplete": F.expr(_total("k", "if(x.channel_id is null or x.start_date is null or x.end_date is null, x.n, 0L)")),
        "campaigns_reversed": F.expr(_total("k", "if(x.end_date < x.start_date, x.n, 0L)")),
        "campaign_orphans": F.expr(_total("k", "if(x.there = 0, x.n, 0L)")),
        "customer_orphans": F.when(~known, F.col("records")),
        "lead_orphans": F.when(~known, F.col("leads_by_campaign")),
        "spend_outside": F.when(known, F.expr(_total("k", f"x.n * {outside}"))),
        "staged": F.when(known & (F.col("records") > 0), F.expr(_total("k", "x.n * x.named"))),
    }
    per_campaign = met.withColumns(own)
    nullable = ("leads_by_campaign", "spend_total")  # sums over no rows are NULL, as the reconciliations want them
    zero = F.lit(0)
    row = per_campaign.agg(
        *(F.coalesce(F.sum(c), zero).alias(c) for c in [*sums, *own] if c not in (*nullable, "staged", "records", "revenue")),
        *(F.sum(c).alias(c) for c in nullable),
        F.sum("spend_total").alias("spend_by_campaign"),
        F.coalesce(F.sum("records"), zero).alias("customer_rows"),
        F.sum(F.when(F.col("staged") > 0, F.col("revenue") * F.col("staged"))).alias("staged_revenue"))
    orders = m.orders.agg(
        _dup("order_id").alias("order_dups"),
        _count_if(F.col("customer_id").isNull() | F.col("order_date").isNull() | F.col("order_amount").isNull()).alias("orders_incomplete"),
        _count_if(F.col("order_amount") <= 0).alias("orders_not_positive"), F.sum("order_amount").alias("orders_total"))
    return row.crossJoin(one_row(orders)).crossJoin(one_row(m.channels.agg(_dup("channel_id").alias("channel_dups"))))


# -------------------------------------------------------------- V9-V13 (11 checks)

def analytics_checks(m: Model, sort: bool = False) -> DataFrame:
    """Cohort, RFM, LTV, LTV:CAC and profitability invariants, as expressions over one row (``_invariant_facts``)."""
    f = F.col
    gap = lambda left, right: F.abs(f(left) - f(right))
    entry = lambda entries, key: f"coalesce(element_at(transform(filter({entries}, x -> x.{key} = c.{key}), x -> x.money), 1), 0)"
    apart = f"abs({entry('customer_side', 'channel_name')} - {entry('campaign_side', 'channel_id')})"
    by_channel = F.expr(f"aggregate(channels, cast(0 as decimal(38, 2)), (t, c) -> cast(t + {apart} as decimal(38, 2)))")
    df = _rows(_invariant_facts(m), [
        ("Cohort: every customer maps to exactly one cohort_month", f("cohort_conflicts")),
        ("Cohort: retention_rate_pct never exceeds 100", f("rates_above")),
        ("Cohort: sum of cohort sizes = total customers", gap("cohort_size", "customer_records")),
        ("RFM: every customer appears exactly once", f("scored_repeatedly")),
        ("RFM: no null recency/frequency/monetary values", f("scored_incomplete")),
        ("RFM: segment counts sum to total customers", gap("scored", "customer_records")),
        ("LTV: sum of customer lifetime LTV = sum of order revenue", F.round(gap("lifetime_value", "order_amount"), 2)),
        ("LTV: channel-level revenue (customer mart) = channel-level revenue (campaign mart)", F.round(by_channel, 2)),
        ("LTV:CAC: total customers across channels = total customers table", gap("acquired_customer_count", "customer_records")),
        ("Profitability: total revenue_lifetime reconciles with Phase 2 mart", F.round(gap("campaign_revenue", "lifetime_value"), 2)),
        ("Profitability: total spend reconciles with Phase 2 mart", F.round(gap("total_spend", "spend_amount"), 2)),
    ])
    return _finish([df], sort)


def _customer_levels(m: Model) -> DataFrame:
    """Customers summed by customer and by channel in one grouping (``customer_level`` tells which).

    A customer's rows in the RFM mart are its copies with an order: scoring adds
    columns by comparing with cut keys and neither adds nor drops a row, so nobody is ranked here.
    """
    month = F.trunc("signup_date", "month")
    scored = F.col("copy_order_rows") > 0
    incomplete = F.col("last_order_date").isNull() | F.col("reference_date").isNull() | F.col("copy_revenue").isNull()
    rows = stg_customer_totals(m).crossJoin(reference_row(m)).select(
        "customer_id", "channel_name",
        F.when(month <= F.col("reference_month"), month).alias("cohort"),
        F.when(scored, F.col("copies")).otherwise(F.lit(0)).alias("scored"),
        F.when(scored & incomplete, F.col("copies")).otherwise(F.lit(0)).alias("incomplete"),
        F.coalesce("revenue", F.lit(0).cast(SUM_MONEY)).alias("money"))
    return rows.groupingSets([["customer_id"], ["channel_name"]], "customer_id", "channel_name").agg(
        (F.grouping("customer_id") == 0).alias("customer_level"),
        (F.min("cohort") != F.max("cohort")).alias("conflict"),
        F.sum("scored").alias("scored"), F.sum("incomplete").alias("incomplete"), F.sum("money").cast(SUM_MONEY).alias("money"))


def _invariant_facts(m: Model) -> DataFrame:
    """All counts and sums of the invariants as one row: partial rows of every mart and table, united and summed once.

    The marts that are compared are computed apart (customer totals, campaign
    revenue), so that a difference shows. Lists hold one entry per channel.
    """
    at_customer, at_channel = F.col("customer_level"), ~F.col("customer_level")
    one = lambda condition: F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    parts = [
        _customer_levels(m).select(
            one(at_customer & F.col("conflict")).alias("cohort_conflicts"),
            one(at_customer & (F.col("scored") > 1)).alias("scored_repeatedly"),
            F.when(at_customer, F.col("incomplete")).alias("scored_incomplete"),
            F.when(at_customer, F.col("scored")).alias("scored"),
            F.when(at_customer, F.col("money")).alias("lifetime_value"),
            F.when(at_channel, F.struct("channel_name", "money")).alias("customer_side")),
        mart_campaign_revenue(m).groupBy("channel_id").agg(F.sum("revenue_lifetime_to_date").cast(SUM_MONEY).alias("money")).select(
            F.col("money").alias("campaign_revenue"), F.struct("channel_id", "money").alias("campaign_side")),
        m.channels.select(F.struct("channel_id", "channel_name").alias("channels")),
        mart_channel_retention(m).select(one(F.col("retention_rate_pct") > 100).alias("rates_above")),
        cohort_sizes(m).select("cohort_size"),
        m.customers.select(F.lit(1).cast("bigint").alias("customer_records")),
        mart_campaign_funnel(m).select("acquired_customer_count"),
        mart_campaign_spend(m).select("total_spend"),
        m.daily_campaign_spend.select("spend_amount"),
        m.orders.select("order_amount"),
    ]
    met = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    listed = ("customer_side", "campaign_side", "channels")
    counts = ("cohort_conflicts", "scored_repeatedly", "scored_incomplete", "scored", "rates_above", "customer_records")
    return met.agg(
        *(F.collect_list(c).alias(c) for c in listed),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts),  # sums of no rows are NULL elsewhere, as reconciliations want them
        *(F.sum(c).alias(c) for c in met.columns if c not in (*listed, *counts)))


# -------------------------------------------------------------- V14-V15 (informational)

def month0_retention_info(m: Model) -> DataFrame:
    """Month-0 retention weighted over all cohorts (not a pass/fail check)."""
    return mart_channel_retention(m).where(F.col("months_since_acquisition") == 0).agg(
        F.sum("active_customers").alias("_a"), F.sum("customers_in_scope").alias("_s"),
    ).select(F.lit("Month 0 retention (all cohorts, weighted)").alias("info"), pct2("_a", "_s").alias("pct"))


def zero_customer_campaigns(m: Model) -> DataFrame:
    """Campaigns with spend and leads but no acquired customer (CAC is NULL)."""
    return stg_campaigns(m).join(mart_campaign_funnel(m), "campaign_id").join(
        mart_campaign_spend(m), "campaign_id"
    ).where(F.col("acquired_customer_count") == 0).select(
        "campaign_name", "acquired_customer_count",
        rounded_ratio("total_spend", "acquired_customer_count", 2, 2, 0).alias("cac"))


# -------------------------------------------------------------- V16 (declared constraints)

def constraint_checks(m: Model, sort: bool = False) -> DataFrame:
    """The schema's declared constraints not covered by V1-V8, as checks."""
    parts = []
    parts.append(_rows(m.channels.agg(
        _dup("channel_name").alias("a"),
        _count_if(F.col("channel_id").isNull() | F.col("channel_name").isNull()).alias("b"),
    ), [("UNIQUE: channels.channel_name", F.col("a")),
        ("NOT NULL: channels", F.col("b"))]))
    parts.append(_rows(m.campaigns.agg(
        _count_if(F.col("campaign_id").isNull() | F.col("campaign_name").isNull()
                  | F.col("objective").isNull()).alias("a"),
    ), [("NOT NULL: campaigns (campaign_id/campaign_name/objective)", F.col("a"))]))
    parts.append(_rows(m.daily_campaign_spend.agg(
        _dup(["campaign_id", "spend_date"]).alias("a"),
        _count_if(F.col("impressions") < 0).alias("b"),
        _count_if(F.col("clicks") < 0).alias("c"),
        _count_if(F.col("campaign_id").isNull() | F.col("spend_date").isNull()
                  | F.col("spend_amount").isNull() | F.col("impressions").isNull()
                  | F.col("clicks").isNull()).alias("d"),
    ), [("PK uniqueness: daily_campaign_spend (campaign_id, spend_date)", F.col("a")),
        ("Non-negative impressions", F.col("b")),
        ("Non-negative clicks", F.col("c")),
        ("NOT NULL: daily_campaign_spend", F.col("d"))]))
    parts.append(_rows(m.leads.agg(
        _count_if(F.col("lead_id").isNull() | F.col("campaign_id").isNull() | F.col("lead_date").isNull()
                  | F.col("converted_flag").isNull()).alias("a"),
    ), [("NOT NULL: leads (lead_id/campaign_id/lead_date/converted_flag)", F.col("a"))]))
    parts.append(_rows(m.customers.agg(_count_if(F.col("customer_id").isNull()).alias("a")),
                       [("NOT NULL: customers.customer_id", F.col("a"))]))
    parts.append(_rows(m.orders.agg(_count_if(F.col("order_id").isNull()).alias("a")),
                       [("NOT NULL: orders.order_id", F.col("a"))]))
    parts.append(_single("Orphans: daily_campaign_spend.campaign_id -> campaigns",
                         _anti_count(m.daily_campaign_spend, "campaign_id", m.campaigns, "campaign_id"),
                         F.first("_v")))
    converted = m.leads.where(F.col("converted_customer_id").isNotNull())
    parts.append(_single("Orphans: leads.converted_customer_id -> customers",
                         _anti_count(converted, "converted_customer_id", m.customers, "customer_id"),
                         F.first("_v")))
    return _finish(parts, sort)
