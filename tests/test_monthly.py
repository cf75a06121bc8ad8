"""Incremental monthly partials: equal to the full run, and only changed months are read."""

import os

import pytest
from pyspark.sql import functions as F

from acqlens.operators import exports, marts, monthly
from acqlens.sources.driver import model_from_driver
from acqlens.sources.files import read_parquet_model, write_model
from acqlens.sources.model import TABLES
from fixtures import make_model


def rows(df):
    return sorted(map(repr, df.collect()))


def equal_to_full_run(spark, place, store):
    m = read_parquet_model(spark, place)
    pairs = [(monthly.campaign_spend(spark, store), marts.mart_campaign_spend(m)),
             (monthly.monthly_trend(spark, store), exports.pbi_monthly_trend(m)),
             (monthly.reference_date(spark, store), marts.mart_reference_date(m))]
    for part, full in pairs:
        assert part.columns == full.columns and [f.dataType for f in part.schema] == [f.dataType for f in full.schema]
        assert rows(part) == rows(full)


def rewritten(spark, place, name, month, change):
    """One month's folder written anew."""
    folder = os.path.join(place, name, f"month={month}")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES[name].fields)
    data = change(spark.read.schema(columns).parquet(folder)).collect()
    spark.createDataFrame(data, columns).coalesce(1).write.mode("overwrite").parquet(folder)


def test_only_changed_months_are_scanned(spark, tmp_path):
    place, store = str(tmp_path / "model"), str(tmp_path / "partials")
    write_model(model_from_driver(spark, "/root/testdata/sf0.001"), place, partition_months=True)
    first = monthly.refresh(spark, place, store)
    months = {name: sorted(d[6:] for d in os.listdir(os.path.join(place, name)) if d.startswith("month=")) for name in first}
    assert first == months and len(months["orders"]) > 12
    equal_to_full_run(spark, place, store)

    assert monthly.refresh(spark, place, store) == {"orders": [], "daily_campaign_spend": []}
    equal_to_full_run(spark, place, store)

    month = months["orders"][3]
    rewritten(spark, place, "orders", month, lambda df: df.withColumn("order_amount", (F.col("order_amount") * 2).cast("decimal(18,2)")))
    before = rows(monthly.monthly_trend(spark, store))
    read = monthly.changed_facts(spark, place, "orders", [month])
    assert {r.p.split("/month=")[1][:7] for r in read.select(F.col("_metadata.file_path").alias("p")).distinct().collect()} == {month}
    plan = monthly.partials(read, "orders")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and month in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert monthly.refresh(spark, place, store) == {"orders": [month], "daily_campaign_spend": []}
    assert rows(monthly.monthly_trend(spark, store)) != before
    equal_to_full_run(spark, place, store)

    # a month without any row left is off the list
    rewritten(spark, place, "daily_campaign_spend", months["daily_campaign_spend"][0], lambda df: df.limit(0))
    monthly.refresh(spark, place, store)
    equal_to_full_run(spark, place, store)


def test_failed_refresh_leaves_the_last_one(spark, tmp_path, monkeypatch):
    place, store = str(tmp_path / "model"), str(tmp_path / "partials")
    with pytest.raises(ValueError, match="no complete refresh"):
        monthly.campaign_spend(spark, store)
    write_model(model_from_driver(spark, "/root/testdata/sf0.001"), place, partition_months=True)
    monthly.refresh(spark, place, store)
    before = rows(monthly.monthly_trend(spark, store))
    month = sorted(os.listdir(os.path.join(place, "orders")))[-1][6:]
    rewritten(spark, place, "orders", month, lambda df: df.withColumn("order_amount", F.lit(1).cast("decimal(18,2)")))
    whole = monthly.partials
    monkeypatch.setattr(monthly, "partials", lambda facts, name: whole(facts, name).withColumn(
        "total_revenue", F.raise_error(F.lit("lost")).cast("decimal(28,2)")))
    with pytest.raises(Exception, match="lost"):
        monthly.refresh(spark, place, store)
    assert rows(monthly.monthly_trend(spark, store)) == before
    monkeypatch.setattr(monthly, "partials", whole)
    assert monthly.refresh(spark, place, store)["orders"] == [month]
    equal_to_full_run(spark, place, store)


def test_empty_tables(spark, tmp_path):
    place, store = str(tmp_path / "model"), str(tmp_path / "partials")
    write_model(make_model(spark), place, partition_months=True)
    assert monthly.refresh(spark, place, store) == {"orders": [], "daily_campaign_spend": []}
    assert monthly.campaign_spend(spark, store).collect() == [] and monthly.monthly_trend(spark, store).collect() == []
