"""Broadcast policy.

* Joins against dimension-grain inputs (channels, campaigns, campaign-grain
  marts) carry **no** hint: Spark's planner broadcasts a side only when its
  estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` (a size
  check on plan statistics), and otherwise plans a sort-merge join; adaptive
  execution re-checks with the real shuffle size at runtime. So a campaign
  table that unexpectedly grows is never forced into executor memory.
* ``one_row`` marks global aggregates (no grouping keys): they have exactly
  one row by construction.
* ``few_rows`` marks the heavy keys of a frequent-items sketch: at most the
  sketch's fixed number of items, whatever the data. These two are the only
  explicit broadcasts in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row(df: DataFrame) -> DataFrame:
    """Broadcast hint for a global aggregate (provably one row)."""
    return F.broadcast(df)


def few_rows(df: DataFrame) -> DataFrame:
    """Broadcast hint for a sketch's heavy keys (bounded by the sketch's size)."""
    return F.broadcast(df)
