"""Exact ordered positions without a single-partition sort.

Two methods, neither of which grows a plan with the data:

* **Cut keys** (``order_statistics``; NTILE and medians). ``NTILE(5)`` over a
  total order needs only the four keys at the tile borders, a median the one or
  two middle ones. Each wanted position is bracketed by two keys of a small
  sample, one aggregate pass counts the rows below and inside every bracket
  (map-side partial sums), and the bracket is narrowed until few distinct keys
  remain, which are collected. The number of rounds is logarithmic in the row
  count, the sample and the collected keys have fixed sizes, and rows are never
  shuffled or sorted: a row's tile is a comparison with four literal keys.
* **Range partitions** (``ranked``; RANK). The rows are range-partitioned by
  (partition columns, rank key, tiebreak) with Spark's own sampler, so a key
  shared by a third of all rows is split by the tiebreak, and windowed inside
  each range. Per-range counts and border keys, a few rows, give every range's
  offset and the ties that began in earlier ranges. Any number of ranges works.

Keys are structs in which descending numeric and date columns are negated and
NULL placement is a leading flag, so ascending struct order is the wanted order.
The input is checkpointed first (in the cluster's ``spark.checkpoint.dir``):
the passes read the same rows, and a lost executor costs a re-read. These
functions therefore run jobs when they are called.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import cut_lineage

SAMPLE = 4096   # sampled keys per wanted position and round
FINISH = 2048   # a bracket with at most so many rows is read out
SEED = 1729


@dataclass(frozen=True)
class SortKey:
    column: str
    ascending: bool = True
    nulls_first: bool | None = None  # None: Postgres default (ASC last, DESC first)

    @property
    def nulls_go_first(self) -> bool:
        return (not self.ascending) if self.nulls_first is None else self.nulls_first


def _directed(c: Column, dtype: T.DataType, ascending: bool) -> Column:
    if ascending:
        return c
    if isinstance(dtype, T.DateType):
        return -F.datediff(c, F.lit("1970-01-01").cast("date"))
    if isinstance(dtype, T.TimestampType | T.TimestampNTZType):
        return -F.unix_micros(c.cast("timestamp"))
    if isinstance(dtype, T.NumericType):
        return -c
    raise TypeError(f"descending order on {dtype} is not supported")


def sort_struct(df: DataFrame, order: list[SortKey]) -> Column:
    """One struct whose ascending order is ``order``."""
    fields = []
    for i, key in enumerate(order):
        c = F.col(key.column)
        first = key.nulls_go_first
        fields.append(F.when(c.isNull(), F.lit(0 if first else 1))
                      .otherwise(F.lit(1 if first else 0)).alias(f"f{i}"))
        fields.append(_directed(c, df.schema[key.column].dataType, key.ascending).alias(f"v{i}"))
    return F.struct(*fields)


def _sql(value, dtype: T.DataType) -> str:
    """A typed SQL literal (one parsed text instead of many nested Column calls)."""
    kind = dtype.simpleString()
    if isinstance(dtype, T.StructType):
        fields = ", ".join(f"'{f.name}', {_sql(None if value is None else value[f.name], f.dataType)}" for f in dtype.fields)
        return f"named_struct({fields})"
    if value is None:
        return f"CAST(NULL AS {kind})"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"CAST('{text}' AS {kind})"


def _comparable(value):
    """Python image of Spark's ascending order on (nested) structs: NULL fields first."""
    if value is None:
        return (0,)
    if hasattr(value, "__fields__"):
        return (1, tuple(_comparable(v) for v in value))
    return (1, value)


# ------------------------------------------------------------------ cut keys

@dataclass
class _Target:
    """A wanted 0-based position of one key column in one group, and its bracket."""
    group: object
    key: str
    position: int
    rows: int                  # rows inside the bracket
    below: int = 0             # rows before it
    low: object = None         # inclusive ends; None is open
    high: object = None
    stalled: bool = False
    round: int = 0

    def inside(self, group_col: tuple[str, T.DataType] | None, dtype: T.DataType) -> str:
        """SQL condition: a row of the target's group with a key in the bracket."""
        parts = ["true"] if group_col is None else [f"`{group_col[0]}` <=> {_sql(self.group, group_col[1])}"]
        if self.low is not None:
            parts.append(f"`{self.key}` >= {_sql(self.low, dtype)}")
        if self.high is not None:
            parts.append(f"`{self.key}` <= {_sql(self.high, dtype)}")
        return "(" + " AND ".join(parts) + ")"


def _collect_inside(base: DataFrame, targets: list[_Target], group_col, dtypes: dict, sampled: bool) -> list[list]:
    """One job: per target the sorted keys of its bracket, or of a sample of it (one draw per row for all targets)."""
    keys = list(dict.fromkeys(t.key for t in targets))
    marks = {key: [] for key in keys}
    for i, t in enumerate(targets):
        draw = f" AND _draw < {min(1.0, SAMPLE / t.rows)!r}D" if sampled else ""
        marks[t.key].append(f"CASE WHEN {t.inside(group_col, dtypes[t.key])}{draw} THEN {i} END")
    found = base.withColumn("_draw", F.rand(SEED + targets[0].round)).selectExpr(
        *[f"array_compact(array({', '.join(marks[key])})) AS `t_{key}`" for key in keys], *keys)
    any_hit = " OR ".join(f"size(`t_{key}`) > 0" for key in keys)
    out: list[list] = [[] for _ in targets]
    for row in found.where(any_hit).collect():
        for key in keys:
            for i in row[f"t_{key}"]:
                out[i].append(row[key])
    return [sorted(x, key=_comparable) for x in out]


def _key_counts(base: DataFrame, t: _Target, group_col, dtype) -> list[tuple]:
    """The (key, count) pairs of a bracket of few distinct keys, in order."""
    rows = base.where(t.inside(group_col, dtype)).groupBy(F.col(t.key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return sorted(((r["k"], r["n"]) for r in rows.collect()), key=lambda p: _comparable(p[0]))


def _narrow(base: DataFrame, targets: list[_Target], group_col, dtypes: dict) -> None:
    """One round in two jobs: sample every bracket and propose a narrower one, then count and accept it."""
    proposals = []
    for t, keys in zip(targets, _collect_inside(base, targets, group_col, dtypes, sampled=True)):
        s = len(keys)
        share = (t.position - t.below) / t.rows
        margin = 3 * math.sqrt(s * share * (1 - share)) + 2
        lo, hi = math.floor(share * s - margin), math.ceil(share * s + margin)
        proposals.append((keys[lo] if 0 <= lo < s else t.low, keys[hi] if 0 <= hi < s else t.high))
    counts = []
    for i, (t, (low, high)) in enumerate(zip(targets, proposals)):
        here = t.inside(group_col, dtypes[t.key])
        under = "false" if low is None else f"`{t.key}` < {_sql(low, dtypes[t.key])}"
        over = "false" if high is None else f"`{t.key}` > {_sql(high, dtypes[t.key])}"
        counts += [f"count_if({here} AND {under}) AS u{i}", f"count_if({here} AND {over}) AS o{i}"]
    row = base.selectExpr(*counts).first()
    for i, (t, (low, high)) in enumerate(zip(targets, proposals)):
        under, over = row[f"u{i}"], row[f"o{i}"]
        at, before = t.position - t.below, (t.low, t.high)
        if under <= at < t.rows - over:
            t.below, t.rows, t.low, t.high = t.below + under, t.rows - under - over, low, high
            t.stalled = (t.low, t.high) == before
        # else the sample missed the position (rare): the next round draws another sample of the same bracket
        t.round += 1


def order_statistics(df: DataFrame, keys: list[str], wanted, group_col: str | None = None) -> dict:
    """Keys at wanted positions: ``{(group, key column, position): key}``.

    ``df`` is materialised (checkpointed) and holds the struct columns ``keys``;
    ``wanted(n)`` gives the 0-based positions for a group of n rows (positions
    outside 0..n-1 are left out). ``group_col`` must have few values.
    """
    if group_col is None:
        sizes = {None: df.count()}
    else:
        sizes = {r[0]: r[1] for r in df.groupBy(group_col).count().collect()}
    dtypes = {key: df.schema[key].dataType for key in keys}
    group = None if group_col is None else (group_col, df.schema[group_col].dataType)
    base = df.select(*([group_col] if group_col else []), *keys)
    targets = [_Target(g, key, p, n) for key in keys for g, n in sizes.items() for p in sorted(set(wanted(n))) if 0 <= p < n]
    done = {}
    while targets:
        small = [t for t in targets if t.rows <= FINISH]
        if small:
            for t, found in zip(small, _collect_inside(base, small, group, dtypes, sampled=False)):
                done[(t.group, t.key, t.position)] = found[t.position - t.below]
        repeated = [t for t in targets if t.rows > FINISH and t.stalled]
        for t in repeated:
            at = t.position - t.below
            for value, n in _key_counts(base, t, group, dtypes[t.key]):
                if at < n:
                    done[(t.group, t.key, t.position)] = value
                    break
                at -= n
        targets = [t for t in targets if (t.group, t.key, t.position) not in done]
        if targets:
            _narrow(base, targets, group, dtypes)
    return done


def tile_starts(n: int, k: int) -> list[int]:
    """0-based positions at which tiles 2..k of ``NTILE(k)`` begin (the first n % k tiles have one row more)."""
    q, r = divmod(n, k)
    return [t * q + min(t, r) for t in range(1, k)]


def ntiles(df: DataFrame, k: int, orders: dict[str, list[SortKey]], tiebreak: list[str]) -> DataFrame:
    """``df`` with one column per entry of ``orders``: ``NTILE(k) OVER (ORDER BY order, tiebreak)``.

    ``df`` is checkpointed; all orderings share it. Rows that agree in order and
    tiebreak share a tile.
    """
    df = cut_lineage(df)
    structs = {name: F.struct(sort_struct(df, order).alias("o"), *[F.col(c) for c in tiebreak]) for name, order in orders.items()}
    keyed = df.select("*", *[s.alias(f"_k_{name}") for name, s in structs.items()])
    cuts = order_statistics(keyed, [f"_k_{name}" for name in orders], lambda n: tile_starts(n, k))
    out = []
    for name in orders:
        column = f"_k_{name}"
        dtype = keyed.schema[column].dataType
        above = [f"int(`{column}` >= {_sql(value, dtype)})" for (_, key, _), value in cuts.items() if key == column]
        out.append(" + ".join(["1", *above]) + f" AS `{name}`")
    return keyed.selectExpr(*[f"`{c}`" for c in df.columns], *out)


def group_median(df: DataFrame, group: str, value: str, tiebreak: str) -> DataFrame:
    """Exact ``PERCENTILE_CONT(0.5)`` of ``value`` per ``group`` (NULLs ignored).

    Returns (group, median) with the median as an exact decimal midpoint.
    """
    src = cut_lineage(df.select(group, F.struct(F.col(value).alias("v"), F.col(tiebreak).alias("t")).alias("_k"))
                      .where(F.col(value).isNotNull()))
    found = order_statistics(src, ["_k"], lambda n: [(n - 1) // 2, n // 2], group)
    by_group: dict = {}
    for (g, _, position), key in sorted(found.items(), key=lambda x: x[0][2]):
        by_group.setdefault(g, []).append(key["v"])
    spark = df.sparkSession
    schema = T.StructType([T.StructField(group, df.schema[group].dataType), T.StructField("lo", df.schema[value].dataType),
                           T.StructField("hi", df.schema[value].dataType)])
    rows = spark.createDataFrame([(g, v[0], v[-1]) for g, v in by_group.items()], schema)
    return rows.select(group, ((F.col("lo") + F.col("hi")) / 2).alias("median"))


# ------------------------------------------------------------------ range partitions

def ranked(df: DataFrame, partition_by: list[str], order: list[SortKey], tiebreak: list[str], name: str,
           ranges: int | None = None) -> DataFrame:
    """``RANK() OVER (PARTITION BY partition_by ORDER BY order)`` as column ``name``.

    ``partition_by`` columns must be low-cardinality (channels): the bookkeeping
    has one row per (partition value, range).
    """
    part = list(partition_by)
    df = cut_lineage(df)  # the range sampler and the shuffle read the same rows
    keyed = df.withColumn("_rk", sort_struct(df, order))
    by = [*part, "_rk", *tiebreak]
    spread = keyed.repartitionByRange(ranges, *by) if ranges else keyed.repartitionByRange(*by)
    local = Window.partitionBy(*part, "_range").orderBy("_rk")
    # The range number is a row's partition after the range shuffle; it is fixed by the checkpoint.
    windowed = cut_lineage(spread.withColumn("_range", F.spark_partition_id()).select("*", F.rank().over(local).alias("_lr")))

    per_part = Window.partitionBy(*part).orderBy("_range")
    stats = windowed.groupBy(*part, "_range").agg(
        F.count(F.lit(1)).alias("_cnt"), F.max("_lr").alias("_maxlr"),
        F.min("_rk").alias("_kmin"), F.max("_rk").alias("_kmax"),
    ).select(
        *part, "_range", "_kmin", "_kmax",
        F.coalesce(F.sum("_cnt").over(per_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        (F.col("_cnt") - F.col("_maxlr") + 1).alias("_tail"),
    )
    # Rows of earlier ranges tied with this range's first key: keys are monotone over
    # ranges, so a running sum of tie tails per last key, read from the range before.
    run = Window.partitionBy(*part, "_kmax").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ties = stats.withColumn("_run", F.sum("_tail").over(run)).select(
        *part, "_range", "_off", "_kmin",
        F.when(F.lag("_kmax").over(per_part) == F.col("_kmin"), F.lag("_run").over(per_part)).otherwise(F.lit(0)).alias("_tied"))
    small = ties.select("_off", "_kmin", "_tied", *[F.col(c).alias(f"_to_{c}") for c in [*part, "_range"]])
    same = [F.col(c).eqNullSafe(F.col(f"_to_{c}")) for c in [*part, "_range"]]
    return windowed.join(small, same).select(
        *df.columns,
        (F.col("_off") + F.col("_lr") - F.when(F.col("_rk") == F.col("_kmin"), F.col("_tied")).otherwise(F.lit(0)))
        .cast("bigint").alias(name))
