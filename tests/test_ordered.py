"""Prefix sums over ranges against plain windows, with a key that most rows have."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldnotes.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    key = F.when(n % 10 < 7, 7).when(n % 10 == 8, F.lit(None).cast("int")).otherwise((n % 50).cast("int"))
    return spark.range(4000).select(key.alias("k"), F.when(n % 91 != 0, F.xxhash64(n) % 400).alias("t"), F.when(n % 5 != 0, n % 13).alias("v"), n.alias("id"), F.lit("x").alias("_x"))


def test_running_equals_windows(rows):
    w = Window.partitionBy("k").orderBy("t", "id")
    want = rows.withColumns(
        {"total": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), "rank": F.row_number().over(w).cast("long"), "previous": F.lag("v").over(w)}
    )
    got = ordered.running(rows, "k", ["t", "id"], {"total": F.col("v")}, "rank", {"previous": "v"})
    assert got.columns == want.columns
    key = lambda r: r["id"]
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_ranges_split_a_key(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ordered.ranged(rows, ["k", "t"], [F.col("k")])
        sizes = [r["n"] for r in placed.groupBy(ordered.range_of(F.col("_place"))).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)  # though one key has seven tenths of the rows


def test_equal_rows_and_none(spark):
    same = spark.range(500).select(F.lit(1).alias("k"), F.lit(2).alias("t"))
    assert sorted(r["n"] for r in ordered.running(same, "k", ["t"], rank="n").collect()) == list(range(1, 501))
    assert ordered.running(same.limit(0), "k", ["t"], rank="n").collect() == []
