"""Plan shape: the choices that matter at scale are visible in the physical plan."""

from acqlens.operators import cohort, exports, marts, metrics, quality, rfm
from acqlens.sources.driver import model_from_driver
from acqlens.sources.files import read_parquet_model, write_model


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def fresh(spark, sf="/root/testdata/sf0.001"):
    """A model whose shared marts are not persisted, so plans show the full tree."""
    spark.catalog.clearCache()
    m = model_from_driver(spark, sf)
    m.persist = False
    return m


def test_projection_and_filter_reach_the_scan(spark, tmp_path):
    m = fresh(spark)
    write_model(m, str(tmp_path / "model"), partition_months=True)
    pm = read_parquet_model(spark, str(tmp_path / "model"))
    ref = plan(marts.mart_reference_date(pm))
    assert "ReadSchema: struct<order_date:date>" in ref
    q = plan(pm.orders.where("order_date >= date'1997-01-01'").select("order_id"))
    assert "PushedFilters: [IsNotNull(order_date), GreaterThanOrEqual(order_date,1997-01-01)]" in q


def _without_aqe(spark, build):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan(build())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_customer_grain_has_no_single_partition_window(spark):
    text = _without_aqe(spark, lambda: rfm.mart_customer_rfm(fresh(spark)))
    assert "Window" not in text and "Exchange" not in text  # tiles are comparisons with cut keys
    ranked = _without_aqe(spark, lambda: metrics.customer_revenue_ranked(fresh(spark)))
    # what is left after the checkpoint: windows over the few per-range rows, partitioned by channel
    assert "SinglePartition" not in ranked and "Window" in ranked


def scans(text):
    """How often each table's files are read in a plan."""
    import collections
    import re

    return collections.Counter(re.findall(r"FileScan [^\n]*?/(\w+)\]", text))


def test_check_suites_read_no_table_more_than_twice(spark, tmp_path):
    write_model(fresh(spark), str(tmp_path / "model"))
    m = read_parquet_model(spark, str(tmp_path / "model"))
    m.persist = False
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # whole paths in plans
    text = _without_aqe(spark, lambda: quality.data_quality_checks(m))
    assert scans(text) == {"orders": 2, "leads": 2, "customers": 1, "daily_campaign_spend": 1, "campaigns": 1, "channels": 2}
    assert text.count("Exchange hashpartitioning") <= 12 and "SortMergeJoin" in text
    assert max(scans(_without_aqe(spark, lambda: quality.constraint_checks(m))).values()) <= 2


def test_invariants_rank_nobody(spark, tmp_path):
    write_model(fresh(spark), str(tmp_path / "model"))
    m = read_parquet_model(spark, str(tmp_path / "model"))
    m.persist = False
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    spark.sparkContext.setJobGroup("invariants", "building the plan")
    text = _without_aqe(spark, lambda: quality.analytics_checks(m))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("invariants")  # no checkpoint, no cut keys
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    found = scans(text)
    assert found["leads"] == 1 and found["daily_campaign_spend"] == 2
    assert text.count("Exchange hashpartitioning") <= 30 and "Window" not in text


def test_retention_reads_customers_and_orders_once(spark, tmp_path):
    write_model(fresh(spark), str(tmp_path / "model"))
    m = read_parquet_model(spark, str(tmp_path / "model"))
    m.persist = False
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    for build in (cohort.mart_channel_retention, cohort.channel_retention_grid, quality.month0_retention_info):
        text = _without_aqe(spark, lambda build=build: build(m))
        found = scans(text)
        assert found["customers"] == 1 and found["orders"] == 2  # once for the activity, once for the latest order date
        dates = [x for x in text.splitlines() if "FileScan" in x and "/orders]" in x and "ReadSchema: struct<order_date:date>" in x]
        assert len(dates) == 1


def test_windowed_revenue_shuffles_ordinary_orders_once(spark, tmp_path):
    import re

    write_model(fresh(spark), str(tmp_path / "model"))
    m = read_parquet_model(spark, str(tmp_path / "model"))
    m.persist = False
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    for build in (marts.mart_campaign_revenue, marts.mart_ltv_90d):
        text = _without_aqe(spark, lambda build=build: build(m))
        daily = re.findall(r"Exchange hashpartitioning\(customer_id#\d+L?, order_date#", text)
        by_customer = re.findall(r"Exchange hashpartitioning\(customer_id#\d+L?, \d+\)", text)
        # one exchange of (customer, day) for the heavy customers; one of customers and one of orders by customer
        assert len(daily) == 1 and len(by_customer) == 2
        assert "BroadcastExchange" in text and "approx_top_k" in text


def test_channel_tables_come_from_one_grouping_by_campaign(spark, tmp_path):
    write_model(fresh(spark), str(tmp_path / "model"))
    m = read_parquet_model(spark, str(tmp_path / "model"))
    m.persist = False
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    for build in (exports.pbi_channel_performance, metrics.budget_allocation):
        text = _without_aqe(spark, lambda build=build: build(m))
        found = scans(text)
        assert found["daily_campaign_spend"] == found["leads"] == found["customers"] == 1
        # the sketch of heavy customers, their orders by day, the other orders, the latest date
        assert found["orders"] == 4
        assert text.count("Exchange hashpartitioning") <= 15
    assert scans(_without_aqe(spark, lambda: metrics.funnel_by_channel(m))) == {"leads": 1, "campaigns": 1, "channels": 1}
    assert "orders" not in scans(_without_aqe(spark, lambda: metrics.cac_by_channel(m)))


def test_customer_totals_shuffle_orders_once(spark, tmp_path):
    write_model(fresh(spark), str(tmp_path / "model"))
    m = read_parquet_model(spark, str(tmp_path / "model"))
    m.persist = False
    lines = _without_aqe(spark, lambda: marts.mart_customer_revenue(m)).splitlines()
    scan = next(i for i, x in enumerate(lines) if "order_amount" in x and "FileScan" in x)
    depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-*()0123456789"))
    above, level = [], depth
    for x in reversed(lines[:scan]):  # the scan's ancestors
        d = len(x) - len(x.lstrip(" :+-*()0123456789"))
        if d < level:
            above.append(x)
            level = d
    exchanges = [x for x in above if "Exchange" in x]
    assert len(exchanges) == 1 and "hashpartitioning(customer_id" in exchanges[0], exchanges
    assert any("partial_sum" in x for x in above)


def test_top_k_per_segment_uses_group_limit(spark):
    m = fresh(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(rfm.rfm_sample(m))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in text


def test_cohort_aggregates_do_not_explode_the_spine(spark):
    m = fresh(spark)
    text = plan(cohort.mart_channel_retention(m))
    # the only Generate is over the tiny (channel, cohort) size table
    assert text.count("Generate") == 1
