"""The six-table funnel model: schemas, conformance and the ``Model`` holder.

Types follow the reference DDL, with entity ids widened to 64-bit (a customer
table at cluster scale overflows int32), as are impressions and clicks. Money is
exact ``DECIMAL(18,2)`` (a day's spend of one campaign grows with the data);
every sum of it is ``DECIMAL(28,2)`` in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

CHANNELS = T.StructType([
    T.StructField("channel_id", T.IntegerType(), False),
    T.StructField("channel_name", T.StringType(), False),
])

CAMPAIGNS = T.StructType([
    T.StructField("campaign_id", T.IntegerType(), False),
    T.StructField("channel_id", T.IntegerType(), False),
    T.StructField("campaign_name", T.StringType(), False),
    T.StructField("start_date", T.DateType(), False),
    T.StructField("end_date", T.DateType(), False),
    T.StructField("objective", T.StringType(), False),
])

DAILY_CAMPAIGN_SPEND = T.StructType([
    T.StructField("campaign_id", T.IntegerType(), False),
    T.StructField("spend_date", T.DateType(), False),
    T.StructField("spend_amount", MONEY, False),
    T.StructField("impressions", T.LongType(), False),
    T.StructField("clicks", T.LongType(), False),
])

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("first_campaign_id", T.IntegerType(), False),
    T.StructField("signup_date", T.DateType(), False),
    T.StructField("region", T.StringType(), True),
])

LEADS = T.StructType([
    T.StructField("lead_id", T.LongType(), False),
    T.StructField("campaign_id", T.IntegerType(), False),
    T.StructField("lead_date", T.DateType(), False),
    T.StructField("converted_flag", T.BooleanType(), False),
    T.StructField("converted_customer_id", T.LongType(), True),
])

ORDERS = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("order_date", T.DateType(), False),
    T.StructField("order_amount", MONEY, False),
])

# Load order of the full refresh (parents before children), with schemas.
TABLES: dict[str, T.StructType] = {
    "channels": CHANNELS,
    "campaigns": CAMPAIGNS,
    "daily_campaign_spend": DAILY_CAMPAIGN_SPEND,
    "customers": CUSTOMERS,
    "leads": LEADS,
    "orders": ORDERS,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: column order, names and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


@dataclass
class Model:
    """The six input tables plus a per-model memo of shared intermediate plans.

    Operators that share a mart ask the memo for it, so one Python object (and
    hence one logical subplan, reusable as a ``ReusedExchange``) backs every use
    inside a session.
    """

    channels: DataFrame
    campaigns: DataFrame
    daily_campaign_spend: DataFrame
    customers: DataFrame
    leads: DataFrame
    orders: DataFrame
    persist: bool = True
    _memo: dict = field(default_factory=dict, repr=False, compare=False)

    @property
    def spark(self) -> SparkSession:
        return self.orders.sparkSession

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLES}

    def memo(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    def shared(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Memoised compact intermediate that several operators (or several
        branches of one plan) read.

        Catalyst prunes each consumer's columns differently, so identical
        subplans rarely become one ``ReusedExchange``. On the second request
        the intermediate is persisted (memory, spilling to disk); the cache
        manager then substitutes one materialisation into every branch, also
        into plans built from the first request. A single consumer pays
        nothing. Only compact results go through here (customer grain and
        smaller), never order-grain data. Lost blocks are recomputed from
        lineage, so executor loss costs time, not correctness. ``release()``
        unpersists; ``persist=False`` disables it.
        """
        uses = self._memo.get(("uses", key), 0) + 1
        self._memo[("uses", key)] = uses
        df = self.memo(key, build)
        if self.persist and uses == 2:
            df.persist(StorageLevel.MEMORY_AND_DISK)
        return df

    def release(self) -> None:
        for value in self._memo.values():
            if isinstance(value, DataFrame) and value.storageLevel.useMemory | value.storageLevel.useDisk:
                value.unpersist()
        self._memo.clear()

    def replace(self, **tables: DataFrame) -> "Model":
        current = self.tables()
        current.update(tables)
        return Model(**current, persist=self.persist)


def model_from_frames(**tables: DataFrame) -> Model:
    missing = set(TABLES) - set(tables)
    if missing:
        raise ValueError(f"missing model tables: {sorted(missing)}")
    return Model(**{name: conform(tables[name], TABLES[name]) for name in TABLES})
