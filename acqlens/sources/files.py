"""File sources and sinks for the model.

* ``read_csv_model`` - typed CSV scan with a header; the header must name the
  schema's columns in order (a reordered file fails instead of loading swapped
  values), empty fields are NULL and malformed rows fail the load.
* ``read_parquet_model`` / ``write_model`` - columnar storage of the model; a
  write is a full refresh (overwrite) of all six tables.
* ``load_version`` / ``read_version`` - the same as an all-or-nothing load: tables of a
  load are written beside the older ones and count when the load is complete.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .model import TABLES, Model, conform

MONTHLY = {"orders": ("order_date", "order_id"), "daily_campaign_spend": ("spend_date", "campaign_id")}
LOADS = "number bigint, folder string, rows map<string, bigint>"


def read_csv_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return (
        spark.read.schema(TABLES[name])
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("nullValue", "")
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )


def read_csv_model(spark: SparkSession, directory: str, suffix: str = ".csv") -> Model:
    frames = {
        name: read_csv_table(spark, os.path.join(directory, name + suffix), name)
        for name in TABLES
    }
    return Model(**frames)


def read_parquet_model(spark: SparkSession, directory: str) -> Model:
    frames = {
        name: conform(spark.read.parquet(os.path.join(directory, name)), TABLES[name])
        for name in TABLES
    }
    return Model(**frames)


def _laid_out(df: DataFrame, name: str, partition_months: bool) -> tuple[DataFrame, list[str]]:
    """A table as it is written, with its partition columns (see ``write_model``)."""
    if not partition_months or name not in MONTHLY:
        return df, []
    date_col, id_col = MONTHLY[name]
    return df.withColumn("month", F.date_format(date_col, "yyyy-MM")).repartitionByRange(date_col, id_col), ["month"]


def write_model(model: Model, directory: str, mode: str = "overwrite",
                partition_months: bool = False) -> None:
    """Full-refresh load of all six tables, parents first.

    With ``partition_months`` the two date-grain fact tables are laid out by
    calendar month, so month filters prune whole directories. Rows are first
    range-partitioned by date and id: a task writes few months, and a month with
    many rows is written by several tasks. The folders are overwritten one after the
    other; ``load_version`` never leaves a mixed model.
    """
    for name in TABLES:
        df, by = _laid_out(conform(model.table(name), TABLES[name]), name, partition_months)
        df.write.mode(mode).partitionBy(*by).parquet(os.path.join(directory, name))


def _loads(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.schema(LOADS).parquet(os.path.join(directory, "loads"))


def load_version(model: Model, directory: str, partition_months: bool = False) -> dict[str, int]:
    """All-or-nothing full refresh; returns the rows written per table.

    The tables go to a folder of their own, and one row is added to ``directory/loads``
    when all of them are complete. ``read_version`` reads the last load named there, so a
    load that fails midway leaves the old model as it was, and a model may be loaded over
    the folder that it is read from. Row counts are observed while writing, without
    another scan. Of two loads at a time, both stay whole and one of them is the last.
    """
    spark = model.spark
    try:
        number = _loads(spark, directory).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0] + 1
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        number = 1
    folder = f"version-{number}-{uuid.uuid4().hex}"
    rows = {}
    for name in TABLES:
        df, by = _laid_out(conform(model.table(name), TABLES[name]), name, partition_months)
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*by).parquet(os.path.join(directory, folder, name))
        rows[name] = seen.get["rows"]
    spark.createDataFrame([(number, folder, rows)], LOADS).coalesce(1).write.mode("append").parquet(os.path.join(directory, "loads"))
    return rows


def read_version(spark: SparkSession, directory: str, number: int | None = None) -> Model:
    """The model of the last complete load, or of load ``number``."""
    loads = _loads(spark, directory)
    if number is not None:
        loads = loads.where(F.col("number") == number)
    last = loads.orderBy(F.col("number").desc(), F.col("folder").desc()).first()
    if last is None:
        raise ValueError(f"no complete load in {directory}")
    # the schema is the one that was written; an empty table by months has no file to tell it
    return Model(**{name: conform(spark.read.schema(schema).parquet(os.path.join(directory, last.folder, name)), schema)
                    for name, schema in TABLES.items()})


def write_exports(frames: dict[str, DataFrame], directory: str, mode: str = "overwrite") -> None:
    """Write flat export objects (one Parquet folder each) for BI import."""
    for name, df in frames.items():
        df.write.mode(mode).parquet(os.path.join(directory, name))
