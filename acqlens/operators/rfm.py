"""RFM operators: M9, Q25-Q27 and the X6 export.

Scores are exact ``NTILE(5)`` over all customers with orders, with
``customer_id`` as the tiebreak, computed by ``ranking.ntiles`` (exact cut keys;
customers are neither sorted nor shuffled).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import SUM_MONEY, avg_round, pct2, rounded_ratio
from ..plans.session import spread
from ..sources.model import Model
from .marts import reference_row, stg_customer_totals
from .ranking import SortKey, ntiles

# Segment names in rule order (first match wins).
SEGMENTS = ["Champions", "New", "Lapsed", "At Risk", "Loyal", "Needs Attention"]

TILES = 5
COPY_CHUNK = 100_000  # copies of one customer row that one task lays out at a time
SCORES = [
    ("recency_score", SortKey("recency_days", ascending=False)),
    ("frequency_score", SortKey("frequency")),
    ("monetary_score", SortKey("monetary")),
]


def rfm_base(m: Model, chunk: int = COPY_CHUNK) -> DataFrame:
    """Customers with at least one order: recency, frequency, monetary.

    One row per customer row (a duplicated customer row stays duplicated, each
    copy with the customer's own order measures, as the join it mirrors does). Copies
    are numbered in chunks, spread by (customer, chunk) before they are laid out, so that a
    customer row repeated over a third of the table becomes neither one array nor one task.
    """
    def build():
        chunks = spread(stg_customer_totals(m).where(F.col("copy_order_rows") > 0).crossJoin(reference_row(m)).select(
            "customer_id",
            "channel_id", "channel_name", "signup_date",
            F.col("copy_order_rows").alias("frequency"),
            F.col("copy_revenue").alias("monetary"),
            "last_order_date",
            F.datediff("reference_date", "last_order_date").alias("recency_days"),
            "copies",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(copies - 1) div {chunk}"))).alias("_chunk"),
        ), "customer_id", "_chunk")
        first = F.col("_chunk") * chunk + 1
        return chunks.withColumn("_copy", F.explode(F.sequence(first, F.least(F.col("copies"), first + (chunk - 1))))).drop("copies", "_chunk")
    return m.memo(f"rfm_base {chunk}", build)


def segment_rule() -> F.Column:
    r, f, mo = F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")
    return (
        F.when((r >= 4) & (f >= 4) & (mo >= 4), SEGMENTS[0])
        .when((F.col("frequency") == 1) & (r >= 4), SEGMENTS[1])
        .when((r <= 2) & (f <= 2) & (mo <= 2), SEGMENTS[2])
        .when((r <= 2) & ((f >= 3) | (mo >= 3)), SEGMENTS[3])
        .when((f >= 3) & (mo >= 3), SEGMENTS[4])
        .otherwise(SEGMENTS[5])
    )


def mart_customer_rfm(m: Model) -> DataFrame:
    """M9: R/F/M quintile scores and segment per customer with orders."""
    def build():
        # a duplicated customer's copies are told apart by their number
        scored = ntiles(rfm_base(m), TILES, {name: [key] for name, key in SCORES}, ["customer_id", "_copy"])
        return scored.select(
            "customer_id", "channel_id", "channel_name", "signup_date", "recency_days",
            "frequency", "monetary", "recency_score", "frequency_score", "monetary_score",
            segment_rule().alias("segment"),
        )
    return m.shared("mart_customer_rfm", build)


def _segment_measures(m: Model) -> DataFrame:
    return mart_customer_rfm(m).groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("recency_days").alias("_rs"), F.count("recency_days").alias("_rn"),
        F.sum("frequency").alias("_fs"), F.count("frequency").alias("_fn"),
        F.sum("monetary").cast(SUM_MONEY).alias("segment_revenue"),
        F.count("monetary").alias("_mn"),
    )


def _segment_table(m: Model, total_customers: F.Column) -> DataFrame:
    totals = F.broadcast(mart_customer_rfm(m).agg(
        F.sum("monetary").cast(SUM_MONEY).alias("_total_revenue"),
        F.count(F.lit(1)).alias("_total_customers")))
    return _segment_measures(m).crossJoin(totals).select(
        "segment", "customers",
        pct2("customers", total_customers).alias("pct_of_customers"),
        avg_round("_rs", "_rn", 1, scale=0).alias("avg_recency_days"),
        avg_round("_fs", "_fn", 2, scale=0).alias("avg_frequency"),
        avg_round("segment_revenue", "_mn", 2).alias("avg_monetary"),
        "segment_revenue",
        rounded_ratio("segment_revenue", "_total_revenue", 2, 2, 2, factor=100).alias("pct_of_revenue"),
    )


def rfm_segment_summary(m: Model, sort: bool = False) -> DataFrame:
    """Q25: customers, shares and averages per segment."""
    df = _segment_table(m, F.col("_total_customers"))
    return df.orderBy(F.col("segment_revenue").desc_nulls_first()) if sort else df


def pbi_rfm_segments(m: Model) -> DataFrame:
    """The segment table exported for the dashboard."""
    return _segment_table(m, F.col("_total_customers"))


def rfm_segment_by_channel(m: Model, sort: bool = False) -> DataFrame:
    """Q26: customers per (channel, segment)."""
    df = mart_customer_rfm(m).groupBy("channel_name", "segment").agg(
        F.count(F.lit(1)).alias("customers"))
    return df.orderBy("channel_name", F.col("customers").desc()) if sort else df


def rfm_sample(m: Model, per_segment: int = 3, sort: bool = False) -> DataFrame:
    """Q27: the ``per_segment`` smallest customer ids of every segment.

    ``row_number() <= k`` per segment plans as a partial WindowGroupLimit before
    the shuffle, so a segment holding a third of all customers still ships only
    k rows per map task.
    """
    w = Window.partitionBy("segment").orderBy("customer_id")
    df = mart_customer_rfm(m).withColumn("_rn", F.row_number().over(w)).where(
        F.col("_rn") <= per_segment).select(
        "customer_id", "channel_name", "recency_days", "frequency", "monetary",
        "recency_score", "frequency_score", "monetary_score", "segment")
    return df.orderBy("segment", "customer_id") if sort else df
