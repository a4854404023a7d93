"""The event log as a data source of Spark: ``format("event_log")``, batch and stream.

A log is a folder of Parquet segments and numbered commits, each a small file that names its segments with
their least and greatest id and their types.  A write adds segments, then its commit; segments of a write that
fails aren't read.  Readers skip segments by id and type, and Parquet's row groups within them.  A stream's
offset is the number of a commit, so a restart goes on with the commit after the last one that was processed.

Options: ``path``, any place that Arrow can open; ``types``, comma-separated; ``after``, an id.  They are options,
since filters that Spark pushes into a Python source stay with its DataFrame: a later query without them
would get the narrowed rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from fieldnotes.sources.files import EVENT


@dataclass(frozen=True)
class Segment(ds.InputPartition):
    name: str
    least: str
    greatest: str
    types: tuple[str, ...]


class Log:
    """A log's files."""

    def __init__(self, path: str):
        self.fs, self.base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def commits(self) -> list[int]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.base}/commits", allow_not_found=True))
        return sorted(int(f.base_name.split(".")[0]) for f in found if f.base_name.endswith(".json"))

    def segments(self, after: int, upto: int) -> list[Segment]:
        out = []
        for n in self.commits():
            if after < n <= upto:
                with self.fs.open_input_stream(f"{self.base}/commits/{n:010}.json") as f:
                    out += [Segment(s["name"], s["least"], s["greatest"], tuple(s["types"])) for s in json.loads(f.read())]
        return out

    def add(self, segments: list[Segment]) -> None:
        """One writer at a time: the log has a single one, as its queue has."""
        self.fs.create_dir(f"{self.base}/commits")
        n = (self.commits() or [0])[-1] + 1
        draft = f"{self.base}/commits/_{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps([{"name": s.name, "least": s.least, "greatest": s.greatest, "types": s.types} for s in segments]).encode())
        self.fs.move(draft, f"{self.base}/commits/{n:010}.json")

    def write(self, table: pa.Table) -> Segment:
        self.fs.create_dir(f"{self.base}/segments")
        name = f"segments/{uuid.uuid4().hex}.parquet"
        with self.fs.open_output_stream(f"{self.base}/{name}") as f:
            pq.write_table(table.sort_by("id"), f, row_group_size=10_000)
        bounds = pc.min_max(table.column("id"))
        return Segment(name, bounds["min"].as_py(), bounds["max"].as_py(), tuple(sorted(t for t in pc.unique(table.column("type")).to_pylist() if t is not None)))

    def rows(self, segment: Segment, wanted: Wanted, columns: list[str]) -> Iterator[pa.RecordBatch]:
        parts = [pc.field("type").isin(sorted(wanted.types))] if wanted.types is not None else []
        parts += [pc.field("id") > wanted.after] if wanted.after is not None else []
        keep = None
        for part in parts:
            keep = part if keep is None else keep & part
        table = pq.read_table(f"{self.base}/{segment.name}", filesystem=self.fs, columns=columns, filters=keep)
        yield from table.to_batches(max_chunksize=10_000)


@dataclass(frozen=True)
class Wanted:
    """What a reader is asked for: types, and ids after one."""

    types: frozenset[str] | None = None
    after: str | None = None

    def has(self, s: Segment) -> bool:
        return (self.after is None or s.greatest > self.after) and (self.types is None or bool(self.types & set(s.types)))


class BatchReader(ds.DataSourceReader):
    def __init__(self, path: str, columns: list[str], wanted: Wanted):
        self.path, self.columns, self.wanted = path, columns, wanted

    def partitions(self) -> list[Segment]:
        log = Log(self.path)
        return [s for s in log.segments(0, (log.commits() or [0])[-1]) if self.wanted.has(s)]

    def read(self, partition: Segment | None) -> Iterator[pa.RecordBatch]:
        return Log(self.path).rows(partition, self.wanted, self.columns) if partition else iter(())


class StreamReader(ds.DataSourceStreamReader):
    def __init__(self, path: str, columns: list[str], wanted: Wanted):
        self.path, self.columns, self.wanted = path, columns, wanted

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": (Log(self.path).commits() or [0])[-1]}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return [s for s in Log(self.path).segments(start["commit"], end["commit"]) if self.wanted.has(s)]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return Log(self.path).rows(partition, self.wanted, self.columns)


@dataclass
class Written(ds.WriterCommitMessage):
    segment: Segment | None


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        batches = [b for b in iterator if b.num_rows]
        return Written(Log(self.path).write(pa.Table.from_batches(batches)) if batches else None)

    def commit(self, messages: list[Written | None]) -> None:
        segments = [m.segment for m in messages if m and m.segment]
        if segments:
            Log(self.path).add(segments)

    def abort(self, messages: list[Written | None]) -> None:
        log = Log(self.path)
        for m in messages:
            if m and m.segment:
                log.fs.delete_file(f"{log.base}/{m.segment.name}")


class EventLog(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return EVENT

    def _asked(self, schema: StructType) -> tuple[str, list[str], Wanted]:
        types = self.options.get("types")
        return self.options["path"], schema.names, Wanted(frozenset(types.split(",")) if types else None, self.options.get("after"))

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(*self._asked(schema))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(*self._asked(schema))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLog)


def append(log: DataFrame, path: str) -> None:
    """Add events to a log, as one commit; a task's events are one segment, so dealing them out by id lets
    readers skip segments."""
    register(log.sparkSession)
    columns = [c.split()[0] for c in EVENT.split(", ")]
    log.repartitionByRange("id").select(*columns).write.format("event_log").option("path", path).mode("append").save()


def _asked(reader, path: str, types: list[str] | None, after: str | None = None) -> DataFrame:
    given = {"path": path} | ({"types": ",".join(types)} if types else {}) | ({"after": after} if after else {})
    return reader.format("event_log").options(**given).load()


def tail(spark: SparkSession, path: str, types: list[str] | None = None) -> DataFrame:
    """The log, or some types of it, as a stream from its begin, or from a query's checkpoint on."""
    register(spark)
    return _asked(spark.readStream, path, types)


def replay(spark: SparkSession, path: str, types: list[str] | None = None, after: str | None = None) -> DataFrame:
    """The log, or some types of it, as a batch, from an id on."""
    register(spark)
    return _asked(spark.read, path, types, after)
