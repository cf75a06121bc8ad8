"""Intermediate results in the shared checkpoint folder, and bitmap filters of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acqlens.plans.session import cut_lineage

BITMAP_BITS = 26  # 2^26 bits are 8 MB, whatever the number of keys
BUCKET = 32768  # bits in one of Spark's bitmaps


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that the cluster names (never localCheckpoint)."""
    return cut_lineage(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filter_bits(keys: int) -> int:
    """Address bits of a bitmap that so many keys fill to 1/32 at most, between 2^16 bits (8 kB) and 2^29 (64 MB)."""
    return min(29, max(16, (32 * keys).bit_length()))


def bitmap(keys: DataFrame, column: str, address: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap over the low bits of 64-bit keys, built by partial aggregation in Spark.

    It has 2^address bits, whatever the number of keys, so sending it to the driver
    and to the executors is bounded; more keys only let more rows through, and every
    use joins the rows that pass with the keys themselves.
    """
    low = F.col(column).bitwiseAND(F.lit((1 << address) - 1))
    parts = (
        keys.where(F.col(column).isNotNull())
        .groupBy((low / BUCKET).cast("long").alias("part"))
        .agg(F.bitmap_construct_agg((low % BUCKET).cast("long")).alias("bits"))
        .collect()
    )
    bits = np.zeros((1 << address) // 8, dtype=np.uint8)
    for row in parts:
        bits[row.part * BUCKET // 8 : (row.part + 1) * BUCKET // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    return bits


def held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the bitmap may contain."""
    low = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names renamed, and how to rename them back (for ``withColumnsRenamed``)."""
    taken = {c.lower() for c in docs.columns} | set(names)
    moved = {}
    for column in docs.columns:
        if column.lower() in names:
            other = next(x for x in (f"{column}_{i}" for i in range(len(taken) + 1)) if x.lower() not in taken)
            taken.add(other.lower())
            moved[column] = other
    return docs.withColumnsRenamed(moved), {b: a for a, b in moved.items()}


def now_named(back: dict[str, str], column: str) -> str:
    """What a column of the caller is called after ``set_aside``."""
    return {a: b for b, a in back.items()}.get(column, column)


def list_of(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and n + 1 bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))


def blank(column: Column) -> Column:
    """Null text as empty text."""
    return F.coalesce(column, F.lit(""))


BROADCAST_ROWS = 200_000  # rows of one key column that may be broadcast (a few MB)


def few(keys: DataFrame) -> DataFrame:
    """A settled key column, marked for broadcast only if its counted rows are few; else joined by shuffle."""
    keys = settle(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
