"""Tables that cut lineage: written once into the shared folder, then read like any input.

The folder is ``spark.checkpoint.dir`` of the session (see ``shared_folder`` where that is unset).
A written table survives the loss of executors.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from fieldnotes.session import shared_folder

_made: list[tuple[SparkSession, str]] = []

#: Shuffle files go as soon as a table is written: else they stay until the driver collects its garbage, and
#: a job of many tables holds the shuffles of all of them at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, deleted when this process ends."""
    path = f"{shared_folder(spark)}/fieldnotes-{uuid.uuid4().hex}/{name}"
    if not _made:
        atexit.register(clear)
    _made.append((spark, path.rsplit("/", 1)[0]))
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and return a DataFrame that reads the files."""
    spark = df.sparkSession
    path = folder(spark, name)
    # for this write alone: a frame of the caller's that runs twice may need its shuffles again
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Delete the tables written so far; results that still read them must be consumed first."""
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended; the folder's owner sweeps what is left
            break
    _made.clear()
