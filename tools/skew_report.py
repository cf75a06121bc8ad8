"""Measure task balance under a hot key from Spark's event log.

One customer is made to own a third of all orders (derived from the driver
tables), each query runs with partition coalescing off (so a task reads one
hash partition), and the event log in a scratch folder is read back: for every
shuffle-reading stage the largest single task's share of the stage's records
is reported. Balanced stages show ~1/partitions; a stage that funnels the hot
customer into one task shows >= 1/3.

    python tools/skew_report.py [--sf /root/testdata/sf0.1] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DEFAULT = ["mart_customer_revenue", "mart_campaign_revenue", "mart_customer_rfm", "customer_revenue_ranked",
           "ltv_by_channel", "mart_channel_retention", "mart_customer_month_activity",
           "data_quality_checks", "legacy_user_revenue_tiers", "legacy_churn_buckets"]


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--partitions", type=int, default=16)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    names = args.names or DEFAULT

    from pyspark.sql import functions as F

    from acqlens.plans.registry import OPERATORS

    from acqlens.plans.session import build_session
    from acqlens.sources.driver import model_from_driver

    logdir = tempfile.mkdtemp(prefix="run-skewlog-", dir="/tmp")
    spark = build_session("local[8]", app_name="acqlens-skew", shuffle_partitions=args.partitions, conf={
        "spark.eventLog.enabled": "true",
        "spark.eventLog.dir": logdir,
        "spark.eventLog.compress": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    })
    base = model_from_driver(spark, args.sf)
    hot_id = base.orders.agg(F.min("customer_id")).first()[0]
    orders = base.orders.withColumn(
        "customer_id", F.when(F.col("order_id") % 3 == 0, F.lit(hot_id)).otherwise(F.col("customer_id")))
    total = orders.count()
    hot = orders.where(F.col("customer_id") == hot_id).count()
    sc = spark.sparkContext
    for name in names:
        spark.catalog.clearCache()
        m = base.replace(orders=orders)
        sc.setJobGroup(name, name)
        OPERATORS[name](m).write.format("noop").mode("overwrite").save()
    spark.stop()

    stage_group: dict[int, str] = {}
    tasks: dict[int, list[int]] = defaultdict(list)
    paths = [p for p in glob.glob(os.path.join(logdir, "**", "*"), recursive=True) if os.path.isfile(p)]
    for path in paths:
        if path.endswith((".inprogress.crc", ".crc")) or os.path.basename(path).startswith("appstatus"):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    metrics = ev.get("Task Metrics") or {}
                    read = (metrics.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    tasks[ev["Stage ID"]].append(read)
    report = {}
    for sid, reads in tasks.items():
        group = stage_group.get(sid)
        total_read = sum(reads)
        if group not in names or total_read < 1000:
            continue
        share = max(reads) / total_read
        worst = report.get(group)
        if worst is None or share > worst["max_task_share"]:
            report[group] = {"max_task_share": round(share, 3), "stage": sid, "stage_records": total_read,
                             "tasks": len(reads)}
    print(json.dumps({"hot_customer_share_of_orders": round(hot / total, 3),
                      "partitions": args.partitions,
                      "worst_stage_per_query": report}))


if __name__ == "__main__":
    main()
