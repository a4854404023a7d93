"""A versioned store of keyed tables in plain Parquet files: copy-on-write by hash bucket, switched by snapshots.

A key belongs to a bucket by its hash.  A commit reads and rewrites only the buckets that its changes touch, in
a folder of its own, for any number of tables; then one small file, the snapshot, is put in place by a rename
that fails if it is there already.  The snapshot names the files of every bucket of every table.  So readers
see all of a commit or none of it, a commit that dies before the switch leaves nothing that is read, two writers
can't both switch, and earlier snapshots can be read until they are vacuumed.

A row is the one with the greatest version of its key; of equal versions the later commit's, and within a
commit the greatest by the other columns.  A deleted key keeps a row that says so, so that an older version
can't bring it back.  A snapshot remembers the last batch of each stream, so that a repeated batch is no change.

A store is derived: ``commit`` of its source's rows to an empty path builds it anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
_INNER = ("_bucket", "_deleted", "_changed")


class Conflict(RuntimeError):
    """Another writer has switched first; read again and repeat the commit."""


@dataclass(frozen=True)
class Table:
    key: str
    version: str


@dataclass(frozen=True)
class Store:
    """A store at a path that driver and executors share, with its tables' keys and versions."""

    path: str
    tables: dict[str, Table]
    buckets: int = BUCKETS

    def _files(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        where = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        return where, where("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def snapshots(self, spark: SparkSession) -> list[int]:
        where, fs = self._files(spark)
        if not fs.exists(where("snapshots")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where("snapshots"))]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit())

    def snapshot(self, spark: SparkSession, number: int | None = None) -> dict:
        """What a snapshot says, of the latest one without a number; an empty store has number 0."""
        known = self.snapshots(spark)
        number = (known[-1] if known else 0) if number is None else number
        if number == 0:
            return {"number": 0, "buckets": self.buckets, "tables": {}, "batches": {}}
        where, fs = self._files(spark)
        stream = fs.open(where(f"snapshots/{number:010}.json"))
        try:
            return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, spark: SparkSession, table: str, number: int | None = None) -> DataFrame | None:
        """The rows of a table at a snapshot; None if it had no such table."""
        held = self.snapshot(spark, number)["tables"].get(table)
        if held is None:
            return None
        return self._stored(spark, held, sorted(held["files"])).filter(~F.col("_deleted")).drop(*_INNER)

    def _stored(self, spark: SparkSession, held: dict, buckets: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(held["schema"])
        paths = [f"{self.path}/{held['files'][b]}" for b in buckets if b in held["files"]]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def commit(self, spark: SparkSession, changes: dict[str, DataFrame], batch: tuple[str, int] | None = None, deleted: str | None = None, before_switch: Callable[[], None] | None = None) -> int:
        """Upsert rows into tables, all or none; gives the number of the snapshot that holds them.

        ``batch``: a stream's name and the number of its micro-batch; one that a snapshot has is no change.
        ``deleted``: a boolean column of the changes that says that a key goes.
        """
        last = self.snapshot(spark)
        if batch and last["batches"].get(batch[0], -1) >= batch[1]:
            return last["number"]
        new = {"number": last["number"] + 1, "buckets": last["buckets"], "tables": dict(last["tables"]), "batches": dict(last["batches"])}
        if batch:
            new["batches"][batch[0]] = batch[1]
        folder = f"data/{new['number']:010}-{uuid.uuid4().hex}"
        for name, rows in changes.items():
            held = self._merged(spark, name, rows, last, f"{folder}/{name}", deleted)
            if held:
                new["tables"][name] = held
        if before_switch:
            before_switch()
        self._switch(spark, new)
        return new["number"]

    def _merged(self, spark: SparkSession, name: str, rows: DataFrame, last: dict, folder: str, deleted: str | None) -> dict | None:
        table, held = self.tables[name], last["tables"].get(name)
        bucket = F.pmod(F.xxhash64(table.key), F.lit(last["buckets"])).cast("int")
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted in rows.columns else F.lit(False)
        # written first: what is touched and what is merged must be the same rows
        changed = rows.filter(F.col(table.key).isNotNull()).select("*", gone.alias("_deleted"), bucket.alias("_bucket"), F.lit(1).alias("_changed"))
        changed = changed.drop(deleted) if deleted else changed
        staged = f"{self.path}/{folder}/changes"
        changed.write.parquet(staged)
        changed = spark.read.schema(changed.schema).parquet(staged)
        touched = sorted(str(r[0]) for r in changed.select("_bucket").distinct().collect())  # at most as many as there are buckets
        if not touched:
            return held
        both = changed
        if held:
            both = self._stored(spark, held, touched).withColumn("_changed", F.lit(0)).unionByName(changed)
        rest = [c for c in both.columns if c not in (table.key, table.version, "_changed", "_bucket")]
        first = F.max(F.struct(table.version, "_changed", *rest))
        merged = both.groupBy("_bucket", table.key).agg(first.alias("r")).select(table.key, F.col(f"r.{table.version}"), *[F.col(f"r.{c}") for c in rest], "_bucket")
        out = f"{folder}/rows"
        merged.repartition("_bucket").withColumn("_part", F.col("_bucket")).write.partitionBy("_part").parquet(f"{self.path}/{out}")
        schema = merged.schema.jsonValue()
        files = dict(held["files"] if held else {}) | {b: f"{out}/_part={b}" for b in touched}
        return {"schema": schema, "files": files}

    def _switch(self, spark: SparkSession, new: dict) -> None:
        where, fs = self._files(spark)
        draft = where(f"snapshots/_{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(json.dumps(new).encode())
        finally:
            stream.close()
        jvm = spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(where(f"snapshots/{new['number']:010}.json")), none)
        except Exception as error:
            fs.delete(draft, False)
            if "exist" in str(error).lower():
                raise Conflict(f"snapshot {new['number']} is there already") from None
            raise

    def vacuum(self, spark: SparkSession, keep: int = 2) -> int:
        """Delete snapshots but the last ``keep`` and the files that none of these names, those of commits that
        never switched too; gives the number of folders deleted.  No commit may run meanwhile."""
        where, fs = self._files(spark)
        known = self.snapshots(spark)
        live = {f for n in known[-keep:] for held in self.snapshot(spark, n)["tables"].values() for f in held["files"].values()}
        for n in known[:-keep]:
            fs.delete(where(f"snapshots/{n:010}.json"), False)
        gone = 0
        for commit in fs.listStatus(where("data")) if fs.exists(where("data")) else []:
            name = commit.getPath().getName()
            for table in fs.listStatus(commit.getPath()):
                of = f"data/{name}/{table.getPath().getName()}"
                fs.delete(where(f"{of}/changes"), True)
                parts = fs.listStatus(where(f"{of}/rows")) if fs.exists(where(f"{of}/rows")) else []
                for part in parts:
                    path = f"{of}/rows/{part.getPath().getName()}"
                    if path not in live and part.isDirectory():
                        fs.delete(where(path), True)
                        gone += 1
            if not any(f.startswith(f"data/{name}/") for f in live):
                fs.delete(commit.getPath(), True)
        return gone


def sink(store: Store, stream: str, tables: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: a micro-batch's tables, such as artifacts and the events that announce them,
    are one commit, and a repeated batch is none."""

    def write(batch: DataFrame, number: int) -> None:
        store.commit(batch.sparkSession, tables(batch), (stream, number))

    return write
