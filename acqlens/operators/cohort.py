"""Cohort operators: M6-M8, Q9-Q11, Q18, X3 and the D4 retention matrix.

Two paths with identical results (asserted in the tests):

* **Row path** - M6 ``mart_customer_cohort_spine`` (one row per customer per
  month from the cohort month to the reference month) and M7
  ``mart_customer_month_activity`` (the spine left-joined to monthly orders).
  These are the reference's row-level marts, offered as operators.
* **Compact path** - nothing that only reports aggregates expands customers into
  months. Counts of customers (M8, Q10, Q11, X3, D4, V9, V14) come from an
  activity histogram: a customer's months with orders are bits, and customers of equal
  channel, cohort and bits are one row with a count (``activity_histogram``). Months are
  expanded there, after customers are gone, and a cell's active customers are a sum
  over set bits. One pass over the customers and one over the orders (and one over
  the order dates for the reference month) give scope and activity together.
  Revenue per cohort month (Q9, Q18) is the per-(customer, month) order aggregate
  joined once to customer attributes. At 100M customers x 18 months the spine would be
  ~1.8B rows.

Customers are counted distinct: the compact path reduces customer rows to one
per (customer, channel, cohort month) before it counts, and keeps the number of
copies for the revenue, which a join of every copy to the orders multiplies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import SUM_MONEY, month_start, months_between_cal, pct2, rounded_ratio
from ..sources.model import Model
from .marts import orders_monthly, reference_row
from .staging import stg_customers


def _cohort_customers(m: Model) -> DataFrame:
    """Distinct (customer, channel, cohort month) of stg_customers with the number of ``copies``,
    restricted to cohorts the spine covers; partitioned by ``customer_id`` for the joins."""
    keys = ["customer_id", "channel_id", "channel_name", "cohort_month", "reference_month"]
    return stg_customers(m).repartition("customer_id").crossJoin(reference_row(m)).select(
        "customer_id",
        F.col("acquisition_channel_id").alias("channel_id"),
        F.col("acquisition_channel_name").alias("channel_name"),
        month_start("signup_date").alias("cohort_month"),
        "reference_month",
    ).where(F.col("cohort_month") <= F.col("reference_month")).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))


def _month_series(start, stop):
    """Months from ``start`` to ``stop``; empty (NULL -> no rows) when start > stop."""
    return F.when(start <= stop, F.sequence(start, stop, F.expr("INTERVAL 1 MONTH")))


# ---------------------------------------------------------------- row path

def mart_customer_cohort_spine(m: Model) -> DataFrame:
    """M6: one row per customer per month, cohort month through reference month."""
    sc = stg_customers(m).crossJoin(reference_row(m))
    cohort = month_start("signup_date")
    return sc.select(
        "customer_id",
        cohort.alias("cohort_month"),
        F.col("acquisition_channel_id").alias("channel_id"),
        F.col("acquisition_channel_name").alias("channel_name"),
        F.explode(_month_series(cohort, F.col("reference_month"))).alias("activity_month"),
    ).withColumn("months_since_acquisition", months_between_cal("activity_month", "cohort_month"))


def mart_customer_month_activity(m: Model) -> DataFrame:
    """M7: the spine left-joined to monthly orders; ``is_active`` = a match exists.

    The exploded spine is never shuffled: each customer's months with orders
    are first gathered into a map (bounded by the calendar months of the data,
    also for a customer that owns a third of all orders), joined to the
    customer at customer grain, and the spine is generated after the join,
    reading its month's entry from the map.
    """
    months = orders_monthly(m).groupBy("customer_id").agg(F.map_from_entries(F.collect_list(
        F.struct("order_month", F.struct("orders_count", "revenue")))).alias("_months"))
    spine = stg_customers(m).crossJoin(reference_row(m)).join(months, "customer_id", "left")
    cohort = month_start("signup_date")
    exploded = spine.select(
        "customer_id",
        cohort.alias("cohort_month"),
        F.col("acquisition_channel_id").alias("channel_id"),
        F.col("acquisition_channel_name").alias("channel_name"),
        "_months",
        F.explode(_month_series(cohort, F.col("reference_month"))).alias("activity_month"),
    )
    hit = F.col("_months")[F.col("activity_month")]
    return exploded.select(
        "customer_id", "cohort_month", "channel_id", "channel_name", "activity_month",
        months_between_cal("activity_month", "cohort_month").alias("months_since_acquisition"),
        F.coalesce(hit["orders_count"], F.lit(0)).cast("bigint").alias("orders_count"),
        F.coalesce(hit["revenue"], F.lit(0).cast(SUM_MONEY)).alias("revenue"),
        hit.isNotNull().alias("is_active"),
    )


# ---------------------------------------------------------------- compact path

def active_cells(m: Model) -> DataFrame:
    """Per (customer, month) with orders inside the spine: channel, cohort, month index.

    One row per active customer-month; the input of every numerator.
    """
    def build():
        cust = _cohort_customers(m)
        return orders_monthly(m).join(cust, "customer_id").where(
            (F.col("order_month") >= F.col("cohort_month"))
            & (F.col("order_month") <= F.col("reference_month"))
        ).select(
            "customer_id", "channel_id", "channel_name", "cohort_month",
            months_between_cal("order_month", "cohort_month").alias("months_since_acquisition"),
            (F.col("revenue") * F.col("copies")).cast(SUM_MONEY).alias("revenue"),
        )
    return m.memo("active_cells", build)


WORD_MONTHS = 64  # months in one 64-bit word


def _month_number(column) -> F.Column:
    """Months since year 0, so that a month has a fixed word and bit."""
    return F.year(column) * 12 + F.month(column) - 1


def activity_histogram(m: Model) -> DataFrame:
    """(channel_id, channel_name, cohort_month, reference_month, words, customers).

    ``words`` are the (word, bits) of the months in which a customer ordered, in order;
    ``customers`` counts the distinct customers with that channel, cohort and activity.
    """
    def build():
        number = _month_number(F.col("order_date"))
        bits = m.orders.select("customer_id", F.floor(number / WORD_MONTHS).cast("int").alias("word"), (number % WORD_MONTHS).alias("bit")).groupBy(
            "customer_id", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        keys = ["channel_id", "channel_name", "cohort_month", "reference_month"]
        per_customer = _cohort_customers(m).join(bits, "customer_id", "left").groupBy("customer_id", *keys).agg(
            F.sort_array(F.collect_list(F.when(F.col("bits").isNotNull(), F.struct("word", "bits")))).alias("words"))
        return per_customer.groupBy(*keys, "words").agg(F.count(F.lit(1)).alias("customers"))
    return m.shared("activity_histogram", build)


def activity_grid(m: Model, keys: list[str]) -> DataFrame:
    """(keys, months_since_acquisition, customers_in_scope, active_customers) of all months up to the reference month."""
    cells = activity_histogram(m).select(
        *keys, "words", "customers", _month_number(F.col("cohort_month")).alias("begin"),
        F.explode(F.sequence(F.lit(0), months_between_cal("reference_month", "cohort_month"))).alias("months_since_acquisition"),
    ).withColumn("at", F.col("begin") + F.col("months_since_acquisition"))
    active = F.expr(f"exists(words, x -> x.word = at div {WORD_MONTHS} and getbit(x.bits, at % {WORD_MONTHS}) = 1)")
    return cells.groupBy(*keys, "months_since_acquisition").agg(
        F.sum("customers").alias("customers_in_scope"),
        F.sum(F.when(active, F.col("customers")).otherwise(F.lit(0))).alias("active_customers"))


def _cohort_grid(m: Model, keys: list[str]) -> DataFrame:
    """Customers per (keys, cohort_month) expanded into (keys, months_since_acquisition).

    ``customers_in_scope`` of a cell = customers whose cohort reached that month.
    """
    sizes = _cohort_customers(m).groupBy(*keys, "cohort_month", "reference_month").agg(
        F.count(F.lit(1)).alias("_cohort_customers"))
    return sizes.select(
        *keys, "cohort_month", "_cohort_customers",
        F.explode(F.sequence(F.lit(0), months_between_cal("reference_month", "cohort_month")))
        .alias("months_since_acquisition"),
    )


def mart_channel_retention(m: Model) -> DataFrame:
    """M8: per channel and month since acquisition: in-scope, active, retention %."""
    def build():
        return activity_grid(m, ["channel_id", "channel_name"]).withColumn(
            "retention_rate_pct", pct2("active_customers", "customers_in_scope"))
    return m.shared("mart_channel_retention", build)


def cohort_sizes(m: Model) -> DataFrame:
    """Customers per signup month over the whole customers table."""
    return m.memo("cohort_sizes", lambda: m.customers.groupBy(
        month_start("signup_date").alias("cohort_month")).agg(F.count(F.lit(1)).alias("cohort_size")))


def cohort_monthly(m: Model) -> DataFrame:
    """(cohort_month, months_since_acquisition) cells of the spine with active customers
    and revenue (0 where nobody ordered)."""
    def build():
        cells = _cohort_grid(m, []).select("cohort_month", "months_since_acquisition").distinct()
        active = active_cells(m).groupBy("cohort_month", "months_since_acquisition").agg(
            F.count(F.lit(1)).alias("_active"),
            F.sum("revenue").cast(SUM_MONEY).alias("_rev"),
        )
        return cells.join(active, ["cohort_month", "months_since_acquisition"], "left").select(
            "cohort_month", "months_since_acquisition",
            F.coalesce("_active", F.lit(0)).alias("active_customers"),
            F.coalesce("_rev", F.lit(0).cast(SUM_MONEY)).alias("monthly_revenue"),
        )
    return m.memo("cohort_monthly", build)


def _with_cumulative(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("cohort_month").orderBy("months_since_acquisition") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("cumulative_revenue", F.sum("monthly_revenue").over(w).cast(SUM_MONEY))


def cohort_retention(m: Model, sort: bool = False) -> DataFrame:
    """Q9: cohort grid with retention against the full cohort size and cumulative LTV."""
    df = _with_cumulative(cohort_monthly(m).join(cohort_sizes(m), "cohort_month")).select(
        "cohort_month", "months_since_acquisition", "cohort_size", "active_customers",
        pct2("active_customers", "cohort_size").alias("retention_rate_pct"),
        "monthly_revenue", "cumulative_revenue",
        rounded_ratio("cumulative_revenue", "cohort_size", 2, 2, 0).alias("cumulative_ltv_per_customer"),
    )
    return df.orderBy("cohort_month", "months_since_acquisition") if sort else df


CHECKPOINT_MONTHS = (0, 1, 3, 6)


def channel_retention_checkpoints(m: Model, sort: bool = False) -> DataFrame:
    """Q10: channel retention at months 0, 1, 3 and 6."""
    df = channel_retention_grid(m).where(F.col("months_since_acquisition").isin(*CHECKPOINT_MONTHS))
    return df.orderBy("channel_name", "months_since_acquisition") if sort else df


def channel_retention_grid(m: Model, sort: bool = False) -> DataFrame:
    """Q11: channel retention at every month since acquisition."""
    df = mart_channel_retention(m).select(
        "channel_name", "months_since_acquisition", "customers_in_scope",
        "active_customers", "retention_rate_pct")
    return df.orderBy("channel_name", "months_since_acquisition") if sort else df


def cohort_ltv_checkpoints(m: Model, sort: bool = False) -> DataFrame:
    """Q18: cumulative LTV per customer at months 0, 1, 3, 6 (window first, then filter)."""
    df = _with_cumulative(cohort_monthly(m).join(cohort_sizes(m), "cohort_month")).where(
        F.col("months_since_acquisition").isin(*CHECKPOINT_MONTHS)
    ).select(
        "cohort_month", "months_since_acquisition", "cohort_size",
        rounded_ratio("cumulative_revenue", "cohort_size", 2, 2, 0).alias("cumulative_ltv_per_customer"),
    )
    return df.orderBy("cohort_month", "months_since_acquisition") if sort else df


def pbi_cohort_retention(m: Model) -> DataFrame:
    """Cohort x month retention grid for the heatmap."""
    return activity_grid(m, ["cohort_month"]).join(cohort_sizes(m), "cohort_month").select(
        "cohort_month", "months_since_acquisition", "cohort_size", "active_customers",
        pct2("active_customers", "cohort_size").alias("retention_rate_pct"),
    )


def retention_matrix(m: Model) -> DataFrame:
    """One row per cohort month; its retention percentages from month 0 on, in order, as one
    comma-separated text. Any number of months fits, as the table has no column per month."""
    cells = F.sort_array(F.collect_list(F.struct("months_since_acquisition", "retention_rate_pct")))
    return pbi_cohort_retention(m).groupBy("cohort_month").agg(
        F.array_join(F.transform(cells, lambda c: c["retention_rate_pct"].cast("string")), ",").alias("retention_by_month"))


MATRIX_MONTHS = 12


def retention_matrix_by_year(m: Model) -> DataFrame:
    """D4 as numbers: one row per cohort month and year since acquisition (``from_month`` 0, 12, ...),
    with the percentages of its months in columns plus_0 to plus_11 (NULL where the cohort has no such month)."""
    age = F.col("months_since_acquisition")
    return pbi_cohort_retention(m).groupBy(
        "cohort_month", (F.floor(age / MATRIX_MONTHS) * MATRIX_MONTHS).cast("bigint").alias("from_month")).agg(
        *(F.max(F.when(age % MATRIX_MONTHS == k, F.col("retention_rate_pct"))).alias(f"plus_{k}") for k in range(MATRIX_MONTHS)))


def retention_pivot(m: Model) -> DataFrame:
    """The retention matrix laid out for display: one column per month since acquisition.

    Reads the widest cohort's length first (one-row job).
    """
    grid = pbi_cohort_retention(m)
    widest = grid.agg(F.max("months_since_acquisition").alias("mx")).first()["mx"]
    return grid.groupBy("cohort_month").pivot("months_since_acquisition", list(range((widest or 0) + 1))).agg(
        F.first("retention_rate_pct"))
