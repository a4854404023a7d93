"""Outreach sequences: which steps are due, and when steps fall.

A conversion or pause of a sequence stops its steps; sends stay within business hours of the zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "Asia/Dubai"
OPENS, CLOSES = 9, 18


def schedule(sequences: DataFrame, cadence: DataFrame) -> DataFrame:
    """(sequence_id, step_index, channel, scheduled_for): start plus the cadence's day offsets."""
    days = F.make_interval(days=F.col("day_offset").cast("int"))
    return sequences.join(cadence, "cadence").select("sequence_id", "status", "step_index", "channel", (F.col("started_at") + days).alias("scheduled_for"))


def in_hours(at: Column, zone: str = ZONE, opens: int = OPENS, closes: int = CLOSES) -> Column:
    local = F.hour(F.from_utc_timestamp(at, zone))
    return (local >= opens) & (local < closes)


def due(steps: DataFrame, as_of: Column) -> DataFrame:
    """The first unsent step of each active sequence, if its time has come and the hour is right."""
    open_ = steps.filter((F.col("status") == "active") & ~F.col("sent"))
    nxt = open_.groupBy("sequence_id").agg(F.min(F.struct("step_index", "channel", "scheduled_for")).alias("n")).select("sequence_id", "n.*")
    return nxt.filter((F.col("scheduled_for") <= as_of) & in_hours(as_of))
