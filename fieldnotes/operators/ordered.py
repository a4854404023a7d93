"""Ordered work on keys of any size: ranks, running sums and the row before, as distributed prefix sums.

Rows are dealt by ranges of (key, order), so a key with most of the rows lies in many ranges.  Each range
adds up its rows by key; what a key has in the ranges before comes from those few totals (one row for each
range that begins within a key, so they are broadcast), and a window within the range does the rest.
The ranges are a written table: they are drawn from a sample, and must be the same for all that follows.

Equal rows are dealt by where they were read, so that ties don't make a range large; they are in any order
among themselves.  Null keys are one key; nulls come first in an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldnotes import scratch

#: A place is the number of a range and the row's number in it, as ``monotonically_increasing_id`` has them.
PLACE_BITS = 33


def range_of(place: Column) -> Column:
    return F.shiftright(place, PLACE_BITS)


def ranged(rows: DataFrame, by: list[str], keep: list[Column], place: str = "_place") -> DataFrame:
    """``keep`` of all rows in the order of ``by``, written in ranges, with each row's ``place``.  Columns that
    only the order needs aren't written."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    order = [F.col(f"`{c}`") for c in [*by, "_tie"]]
    dealt = tied.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.cut(dealt.select(*keep, F.monotonically_increasing_id().alias(place)), "ranges")


def running(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column] | None = None, rank: str | None = None, before: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with the running sums of ``sums``, the row's number ``rank`` and the values ``before`` of the row
    before, by ``key`` in the order of ``order``."""
    added = {f"_s{i}": value for i, value in enumerate((sums or {}).values())} | ({"_one": F.lit(1).cast("long")} if rank else {})
    names = [*(sums or {}), *([rank] if rank else [])]
    cols = [F.col(f"`{c}`") for c in rows.columns]
    placed = ranged(rows.withColumns(added), [key, *order], [*cols, *map(F.col, added)]).withColumn("_range", range_of(F.col("_place")))
    last = F.max_by(F.struct(*[F.col(f"`{c}`").alias(f"_b{i}") for i, c in enumerate((before or {}).values())], F.lit(0).alias("_none")), "_place")
    totals = placed.groupBy("_range", key).agg(*[F.sum(c).alias(c) for c in added], last.alias("_last"))
    earlier = Window.partitionBy(key).orderBy("_range")  # as many rows as the key has ranges
    upto = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_range").alias("_at"),
        F.col(f"`{key}`").alias("_key"),
        F.lag("_last").over(earlier).alias("_carried"),
        *[F.sum(c).over(upto).alias(f"{c}_c") for c in added],
    ).filter(F.col("_carried").isNotNull())
    within = Window.partitionBy("_range", key).orderBy("_place")
    here = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = placed.join(F.broadcast(carried), (F.col("_range") == F.col("_at")) & F.col(f"`{key}`").eqNullSafe(F.col("_key")), "left")
    out = found.withColumns({f"_o{i}": F.sum(c).over(here) for i, c in enumerate(added)} | {"_n": F.row_number().over(within)} | {f"_p{i}": F.lag(f"`{c}`").over(within) for i, c in enumerate((before or {}).values())})
    made = [F.coalesce(F.col(f"_o{i}") + F.col(f"{c}_c"), F.col(f"_o{i}"), F.col(f"{c}_c")).alias(n) for i, (c, n) in enumerate(zip(added, names, strict=True))]
    held = [F.when(F.col("_n") > 1, F.col(f"_p{i}")).otherwise(F.col(f"_carried._b{i}")).alias(n) for i, n in enumerate(before or {})]
    return out.select(*cols, *made, *held)
