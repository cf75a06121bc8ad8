"""Sources and sinks: typed CSV load (S1, S2), full refresh (S3), Parquet model (S4),
view registry (S5) and dashboard exports (S6)."""

import os

import pytest
from pyspark.sql import functions as F

from acqlens.operators import exports
from acqlens.plans.registry import register_views
from acqlens.sources.driver import model_from_driver
from acqlens.sources.files import read_csv_model, read_parquet_model, write_model
from acqlens.sources.model import TABLES


@pytest.fixture(scope="module")
def model(spark):
    return model_from_driver(spark, "/root/testdata/sf0.001")


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_csv_round_trip_keeps_types_and_nulls(spark, model, tmp_path):
    for name in TABLES:
        model.table(name).write.option("header", True).csv(str(tmp_path / f"{name}.csv"))
    loaded = read_csv_model(spark, str(tmp_path))
    for name in TABLES:
        # file readers mark every field nullable; names and types must match
        got = [(f.name, f.dataType) for f in loaded.table(name).schema.fields]
        assert got == [(f.name, f.dataType) for f in TABLES[name].fields]
        assert _same(loaded.table(name), model.table(name)), name
    # unconverted leads keep a NULL customer id (empty CSV field)
    assert loaded.leads.where(F.col("converted_customer_id").isNull()).count() > 0


def test_csv_malformed_row_fails_the_load(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.mkdir()
    (path / "part-0.csv").write_text("order_id,customer_id,order_date,order_amount\n1,2,not-a-date,3.00\n")
    from acqlens.sources.files import read_csv_table
    with pytest.raises(Exception):
        read_csv_table(spark, str(path), "orders").collect()


def test_parquet_full_refresh(spark, model, tmp_path):
    target = str(tmp_path / "model")
    write_model(model, target, partition_months=True)
    write_model(model, target, partition_months=True)  # overwrite, not append
    loaded = read_parquet_model(spark, target)
    for name in TABLES:
        assert _same(loaded.table(name), model.table(name)), name
    months = os.listdir(os.path.join(target, "orders"))
    assert any(d.startswith("month=") for d in months)


def test_view_registry(spark, model):
    names = register_views(model, ["roas_by_channel", "mart_reference_date"])
    assert names == ["roas_by_channel", "mart_reference_date"]
    assert spark.sql("SELECT COUNT(*) AS n FROM roas_by_channel").first()["n"] > 0


def test_dashboard_exports(spark, model, tmp_path):
    exports.write_dashboard_exports(model, str(tmp_path / "bi"))
    written = sorted(os.listdir(tmp_path / "bi"))
    assert written == sorted(exports.export_frames(model))
    assert len(written) == 7
    assert spark.read.parquet(str(tmp_path / "bi" / "pbi_executive_summary")).count() == 1


def test_csv_with_reordered_header_fails(spark, tmp_path):
    import pytest

    from acqlens.sources.files import read_csv_table

    path = tmp_path / "leads.csv"
    path.write_text("campaign_id,lead_id,lead_date,converted_flag,converted_customer_id\n7,1,1996-01-01,true,5\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv_table(spark, str(path), "leads").collect()


def test_monthly_layout_writes_few_files(spark, tmp_path):
    import os

    from acqlens.sources.driver import model_from_driver
    from acqlens.sources.files import write_model

    write_model(model_from_driver(spark, "/root/testdata/sf0.001"), str(tmp_path / "m"), partition_months=True)
    files = sum(f.endswith(".parquet") for _, _, names in os.walk(tmp_path / "m/orders") for f in names)
    months = sum(name.startswith("month=") for name in os.listdir(tmp_path / "m/orders"))
    assert files <= months + int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_every_line_reaches_the_spend_table(spark):
    from pyspark.sql import functions as F

    from acqlens.sources.driver import model_from_driver

    m = model_from_driver(spark, "/root/testdata/sf0.01")
    assert m.daily_campaign_spend.agg(F.sum("clicks")).first()[0] == spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()


def test_cluster_without_checkpoint_folder_is_an_error():
    from types import SimpleNamespace

    import pytest

    from acqlens.plans.session import checkpoint_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))


def test_versioned_load_is_all_or_nothing(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from acqlens.sources.driver import model_from_driver
    from acqlens.sources.files import load_version, read_version
    from acqlens.sources.model import TABLES

    place = str(tmp_path / "model")
    m = model_from_driver(spark, "/root/testdata/sf0.001")
    counts = {name: m.table(name).count() for name in TABLES}
    assert load_version(m, place, partition_months=True) == counts
    assert {name: df.count() for name, df in read_version(spark, place).tables().items()} == counts

    broken = m.replace(customers=m.customers.limit(3), orders=m.orders.withColumn("order_amount", F.raise_error(F.lit("broken row")).cast("decimal(18,2)")))
    with pytest.raises(Exception, match="broken row"):
        load_version(broken, place)
    assert read_version(spark, place).customers.count() == counts["customers"]  # not the three of the load that failed

    old = read_version(spark, place)
    assert load_version(old.replace(orders=old.orders.where("order_id % 2 = 0")), place)["orders"] < counts["orders"]  # over its own folder
    assert read_version(spark, place).orders.where("order_id % 2 = 1").count() == 0
    assert read_version(spark, place, number=1).orders.count() == counts["orders"]
    with pytest.raises(ValueError, match="no complete load"):
        read_version(spark, place, number=9)


def test_versioned_load_of_empty_tables(spark, tmp_path):
    from acqlens.sources.files import load_version, read_version
    from acqlens.sources.model import TABLES
    from fixtures import make_model

    assert load_version(make_model(spark), str(tmp_path / "m"), partition_months=True) == dict.fromkeys(TABLES, 0)
    assert all(df.count() == 0 for df in read_version(spark, str(tmp_path / "m")).tables().values())
