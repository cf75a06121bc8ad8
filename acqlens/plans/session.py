"""Session construction and lineage-cutting helpers.

Everything here is plain Spark configuration. The settings that matter at
scale are adaptive execution (runtime coalescing, skew-join splitting and
shuffle-to-broadcast conversion), a UTC session clock (every model column is a
DATE, so the zone only matters when driver TIMESTAMP_NTZ columns are cast) and a
shared checkpoint folder taken from the cluster's own ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings applied to every session this package builds. Partition counts are
# left to the caller: on a cluster they come from spark-defaults, in tests the
# caller passes a small number.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # files go with their DataFrame
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "acqlens",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The context's checkpoint directory (initialised from ``spark.checkpoint.dir``)
    is used as is. In local mode without one (tests) a private folder under the
    system temp dir is set on the context; on a cluster that is an error, as
    executors do not share such a folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="acqlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used where a plan would otherwise be recomputed from the raw tables after
    an executor loss; never ``localCheckpoint`` (its blocks die with the
    executor).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), "tables", name)


def spread(df, *columns):
    """``df`` dealt by ``columns`` over all shuffle partitions, for rows that grow after the shuffle.

    The count is given, so adaptive execution does not join the partitions by
    the small size that they have before they grow.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
