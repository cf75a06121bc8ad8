"""Incremental monthly partials: M1 and X5 from sums that are kept per calendar month.

``refresh`` reads a model that is laid out by month (``write_model(partition_months=True)``).
A month's mark comes from the files of its folder (path, size, time of change), read from
file metadata without any column. Only months whose mark is new are scanned again; months
that are gone leave the list. Partials are additive (sums, least and greatest dates), so
M1 and X5 are sums of partial rows: one row per month and campaign, whatever the number
of spend rows and orders.

A refresh writes its partials to a folder of its own and then adds one row, the list
of all months with the folder that holds each, so one that fails leaves the last
complete list as it was. Month lists are bounded by the calendar; they alone pass the driver.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import SUM_MONEY, money_sum, month_start
from ..sources.files import MONTHLY
from ..sources.model import TABLES

LISTS = "number bigint, months array<struct<name: string, month: string, mark: string, folder: string>>"
PARTIALS = {
    "daily_campaign_spend": "folder string, month string, campaign_id int, total_spend decimal(28,2), total_impressions bigint, "
                            "total_clicks bigint, first_spend_date date, last_spend_date date",
    "orders": "folder string, month string, total_revenue decimal(28,2), first_order_date date, last_order_date date",
}
NO_DATE = "none"  # the month of rows without a date


def _facts(spark: SparkSession, model_dir: str, name: str) -> DataFrame:
    """A fact table with the month of its folder as text."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES[name].fields)
    df = spark.read.schema(f"{columns}, month string").parquet(os.path.join(model_dir, name))
    return df.withColumn("month", F.coalesce("month", F.lit(NO_DATE)))


def month_marks(spark: SparkSession, model_dir: str, name: str) -> dict[str, str]:
    """Month to a digest of its files."""
    files = _facts(spark, model_dir, name).select(
        "month", *(F.col(f"_metadata.{c}").cast("string").alias(c) for c in ("file_path", "file_size", "file_modification_time")))
    each = files.distinct().select("month", F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)").alias("h"))
    rows = each.groupBy("month").agg(F.concat_ws(":", F.count(F.lit(1)), F.sum("h")).alias("mark")).collect()
    return {r.month: r.mark for r in rows}


def partials(facts: DataFrame, name: str) -> DataFrame:
    """One row per month (and campaign, for spend) of a fact table with its month."""
    if name == "orders":
        return facts.groupBy("month").agg(
            F.sum("order_amount").cast(SUM_MONEY).alias("total_revenue"),
            F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date"))
    return facts.groupBy("month", "campaign_id").agg(
        F.sum("spend_amount").cast(SUM_MONEY).alias("total_spend"),
        F.sum("impressions").alias("total_impressions"), F.sum("clicks").alias("total_clicks"),
        F.min("spend_date").alias("first_spend_date"), F.max("spend_date").alias("last_spend_date"))


def changed_facts(spark: SparkSession, model_dir: str, name: str, months: list[str]) -> DataFrame:
    """The rows of these months; other folders are pruned."""
    return _facts(spark, model_dir, name).where(F.col("month").isin(months))


def _last(spark: SparkSession, store: str):
    """The last complete list, or None."""
    try:
        lists = spark.read.schema(LISTS).parquet(os.path.join(store, "lists"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return lists.orderBy(F.col("number").desc()).first()


def refresh(spark: SparkSession, model_dir: str, store: str) -> dict[str, list[str]]:
    """Bring the partials in ``store`` up to date; returns the months that were scanned, per table."""
    last = _last(spark, store)
    known = {(e.name, e.month): e for e in last.months} if last else {}
    folder = f"refresh-{uuid.uuid4().hex}"
    entries, scanned = [], {}
    for name in MONTHLY:
        marks = month_marks(spark, model_dir, name)
        scanned[name] = sorted(m for m, mark in marks.items() if (name, m) not in known or known[name, m].mark != mark)
        if scanned[name]:
            partials(changed_facts(spark, model_dir, name, scanned[name]), name).withColumn("folder", F.lit(folder)).write.parquet(
                os.path.join(store, folder, name))
        entries += [(name, m, mark, folder if m in scanned[name] else known[name, m].folder) for m, mark in marks.items()]
    spark.createDataFrame([((last.number if last else 0) + 1, entries)], LISTS).coalesce(1).write.mode("append").parquet(
        os.path.join(store, "lists"))
    return scanned


def _current(spark: SparkSession, store: str, name: str) -> DataFrame:
    """The partial rows that the last complete list names."""
    last = _last(spark, store)
    if last is None:
        raise ValueError(f"no complete refresh in {store}")
    mine = [(e.folder, e.month) for e in last.months if e.name == name]
    if not mine:
        return spark.createDataFrame([], PARTIALS[name])
    rows = spark.read.schema(PARTIALS[name]).parquet(*sorted({os.path.join(store, f, name) for f, _ in mine}))
    return rows.join(F.broadcast(spark.createDataFrame(mine, "folder string, month string")), ["folder", "month"])


def campaign_spend(spark: SparkSession, store: str) -> DataFrame:
    """M1 from the partials."""
    return _current(spark, store, "daily_campaign_spend").groupBy("campaign_id").agg(
        money_sum("total_spend").alias("total_spend"),
        F.sum("total_impressions").alias("total_impressions"),
        F.sum("total_clicks").alias("total_clicks"),
        F.min("first_spend_date").alias("first_spend_date"),
        F.max("last_spend_date").alias("last_spend_date"))


def monthly_trend(spark: SparkSession, store: str) -> DataFrame:
    """X5 from the partials."""
    spend = _current(spark, store, "daily_campaign_spend").groupBy(month_start("first_spend_date").alias("month")).agg(
        F.sum("total_spend").cast(SUM_MONEY).alias("_spend"))
    revenue = _current(spark, store, "orders").select(month_start("first_order_date").alias("month"), F.col("total_revenue").alias("_revenue"))
    zero = F.lit(0).cast(SUM_MONEY)
    return spend.join(revenue, "month", "full_outer").select(
        "month", F.coalesce("_spend", zero).alias("total_spend"), F.coalesce("_revenue", zero).alias("total_revenue"))


def reference_date(spark: SparkSession, store: str) -> DataFrame:
    """M5 from the partials."""
    return _current(spark, store, "orders").agg(F.max("last_order_date").alias("reference_date")).select(
        "reference_date", month_start("reference_date").alias("reference_month"))
