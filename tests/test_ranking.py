"""Distributed exact NTILE / RANK / median against Spark's single-partition windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from acqlens.operators import ranking
from acqlens.operators.ranking import SortKey, group_median, ntiles, ranked, tile_starts

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lines(spark):
    # l_quantity has 50 distinct values over 60k rows: heavy ties everywhere
    return spark.read.parquet(f"{SF}/lineitem.parquet").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_quantity").cast("int").alias("q"),
        F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_linenumber") == 3, None).otherwise(F.col("l_discount")).alias("d"),
    ).cache()


def _diff(a, b, cols):
    return a.select(*cols).exceptAll(b.select(*cols)).count() + b.select(*cols).exceptAll(a.select(*cols)).count()


@pytest.mark.parametrize("finish", [4, 2048, 10**9])  # many narrowing rounds, some, none
def test_ntiles_match_windows(spark, lines, monkeypatch, finish):
    monkeypatch.setattr(ranking, "FINISH", finish)
    monkeypatch.setattr(ranking, "SAMPLE", 300 if finish == 4 else 4096)
    expected = lines.withColumn("t", F.ntile(5).over(Window.orderBy(F.col("q").desc(), "id"))).withColumn(
        "u", F.ntile(5).over(Window.orderBy(F.col("d").asc_nulls_last(), "id")))
    got = ntiles(lines, 5, {"t": [SortKey("q", ascending=False)], "u": [SortKey("d")]}, ["id"])
    assert _diff(expected, got, ["id", "t", "u"]) == 0


def test_ntiles_neither_sort_nor_shuffle_rows(spark, lines):
    text = ntiles(lines, 5, {"t": [SortKey("q")]}, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Window" not in text and "Sort" not in text


@pytest.mark.parametrize("ranges", [1, 64, 1500])
def test_rank_per_partition_with_nulls(spark, lines, ranges):
    w = Window.partitionBy("flag").orderBy(F.col("d").desc_nulls_first())
    expected = lines.withColumn("r", F.rank().over(w))
    assert _diff(expected, ranked(lines, ["flag"], [SortKey("d", ascending=False)], ["id"], "r", ranges), ["id", "r"]) == 0


def test_rank_with_default_ranges_and_null_partitions(spark, lines):
    some = lines.withColumn("flag", F.when(F.col("flag") != "R", F.col("flag")))
    expected = some.withColumn("r", F.rank().over(Window.partitionBy("flag").orderBy(F.col("q").desc())))
    assert _diff(expected, ranked(some, ["flag"], [SortKey("q", ascending=False)], ["id"], "r"), ["id", "r"]) == 0


@pytest.mark.parametrize("finish", [4, 2048])
def test_median_matches_percentile(spark, lines, monkeypatch, finish):
    monkeypatch.setattr(ranking, "FINISH", finish)
    src = lines.withColumn("v", (F.col("q") * F.lit(1.25)).cast("decimal(12,2)"))
    expected = src.groupBy("flag").agg(F.percentile("v", 0.5).alias("m")).select(
        "flag", F.round(F.col("m"), 2).cast("double").alias("m"))
    got = group_median(src, "flag", "v", "id").select("flag", F.round("median", 2).cast("double").alias("m"))
    assert _diff(expected, got, ["flag", "m"]) == 0


def test_median_of_repeated_rows_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FINISH", 8)  # equal rows cannot be narrowed: they are counted
    rows = [("a", 1, 7)] * 500 + [("a", 1, 9)] * 501 + [("b", 2, 5), ("b", 3, 6), (None, 4, 1), ("c", 5, None)]
    df = spark.createDataFrame(rows, "g string, id int, v int")
    got = {r.g: float(r.median) for r in group_median(df, "g", "v", "id").collect()}
    assert got == {"a": 9.0, "b": 5.5, None: 1.0}


@pytest.mark.parametrize("n,expected", [(7, [1, 1, 2, 2, 3, 4, 5]), (3, [1, 2, 3]), (5, [1, 2, 3, 4, 5])])
def test_ntile_small_groups_f11_f12(spark, n, expected):
    df = spark.range(n).select(F.col("id"), F.lit(1).alias("frequency"))
    got = ntiles(df, 5, {"t": [SortKey("frequency")]}, ["id"]).orderBy("id")
    assert [r["t"] for r in got.collect()] == expected


def test_tile_starts():
    for n in range(30):
        sizes = [b - a for a, b in zip([0, *tile_starts(n, 5)], [*tile_starts(n, 5), n])]
        assert sum(sizes) == n and sizes == sorted(sizes, reverse=True) and sizes[0] - sizes[-1] <= 1


def test_empty_input(spark):
    df = spark.range(0).select(F.col("id"), F.lit(1).alias("k"), F.lit("x").alias("g"))
    assert ntiles(df, 5, {"t": [SortKey("k")]}, ["id"]).count() == 0
    assert ranked(df, ["g"], [SortKey("k")], ["id"], "r").count() == 0
    assert group_median(df, "g", "k", "id").count() == 0
