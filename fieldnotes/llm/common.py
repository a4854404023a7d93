"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to Python: texts may be long, and a batch is held in memory.
ARROW_ROWS = 1000
#: Rows of a narrow table that may be broadcast.
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of a Python worker by the number of texts in a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def others(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` but those that a result replaces."""
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in {n.lower() for n in names}]


def fetched(df: DataFrame) -> pd.DataFrame:
    """A bounded result at the driver, by Arrow whatever the session's settings are: row by row it would
    take many times the memory."""
    return df.toArrow().to_pandas()


def binaries(strings: pa.Array) -> list[bytes]:
    """The values of an array of large binaries without nulls, many times faster than one by one."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1].tolist()
    data = strings.buffers()[2].to_pybytes() if strings.buffers()[2] else b""
    return [data[lo:hi] for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]


def bounded(few: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table that is cheap to count, to be broadcast while it has at most ``most`` rows."""
    return F.broadcast(few) if few.count() <= most else few


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the ids that no model may learn from; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone (52 bits of an MD5 digest)."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)
