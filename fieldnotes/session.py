"""A session with the settings the operators assume."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_local: list[str] = []

#: UTC everywhere; adaptive plans coalesce, split skewed joins and demote sorts to hashes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: On a cluster, partitions are sized by the input: about this much shuffled data each.
CLUSTER = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m", "spark.sql.files.maxPartitionBytes": "256m", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000"}


def session(name: str = "fieldnotes", **extra: str) -> SparkSession:
    """The running session or a new one; keyword arguments are settings with ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables and stream checkpoints go: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a cluster's executors share the warehouse, if it isn't a folder of one machine;
    only a session whose executors are threads of this process gets a temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if warehouse.partition(":")[0] in ("file", warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return warehouse + "/_scratch"
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="fieldnotes-"))
    return _local[0]


def packed(root: Path) -> bytes:
    """The package's sources as a zip archive."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted((root / "fieldnotes").rglob("*.py")):
            z.writestr(str(path.relative_to(root)), path.read_bytes())
    return out.getvalue()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors of a cluster this package, through the shared folder."""
    sc = spark.sparkContext
    if sc.master.startswith("local") or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    path = f"{shared_folder(spark)}/{sc.applicationId}/fieldnotes.zip"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where, True)
    stream.write(packed(Path(__file__).resolve().parent.parent))
    stream.close()
    sc.addPyFile(path)
