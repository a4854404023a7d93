"""The event log as a data source: skipped segments, offsets over restarts, failed writes."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fieldnotes import streaming
from fieldnotes.sources import eventlog
from fieldnotes.sources.files import EVENT


def events(spark, lo, hi):
    n = F.col("id")
    kinds = F.element_at(F.array(F.lit("url.submitted"), F.lit("crawl.completed"), F.lit("reply.received")), (n % 3 + 1).cast("int"))
    nothing = F.lit(None).cast("string")
    return spark.range(lo, hi).select(
        F.lpad(n.cast("string"), 8, "0").alias("id"), F.lit("t").alias("tenant_id"), kinds.alias("type"), F.lit(1).alias("version"), nothing.alias("correlation_id"),
        nothing.alias("causation_id"), (n % 5).cast("string").alias("company_id"), F.lit(datetime(2024, 1, 1)).alias("occurred_at"), F.lit("{}").alias("payload"),
    )


@pytest.fixture
def path(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a segment for each range
    yield f"file://{tmp_path}/log"
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_batch_with_filters(spark, path):
    assert eventlog.replay(spark, path).count() == 0
    eventlog.append(events(spark, 0, 400), path)
    eventlog.append(events(spark, 400, 500), path)
    log = eventlog.replay(spark, path)
    assert log.schema.simpleString() == spark.createDataFrame([], EVENT).schema.simpleString()
    some = eventlog.replay(spark, path, ["crawl.completed", "reply.received"], "00000410")
    got = some.filter(F.col("company_id") == "1").select("id").collect()
    assert sorted(r["id"] for r in got) == [f"{i:08}" for i in range(411, 500) if i % 3 and i % 5 == 1]
    assert log.filter("id >= '00000499'").count() == 1 and log.filter("type = 'none'").count() == 0
    assert log.groupBy("type").count().count() == 3 and log.count() == 500


def test_segments_are_skipped(spark, path):
    eventlog.append(events(spark, 0, 400), path)
    every = eventlog.BatchReader(path, ["id"], eventlog.Wanted()).partitions()
    reader = eventlog.BatchReader(path, ["id", "type"], eventlog.Wanted(frozenset({"reply.received"}), "00000250"))
    some = reader.partitions()
    assert len(every) == 4 and 0 < len(some) < 4
    rows = [r for s in some for b in reader.read(s) for r in b.to_pylist()]
    assert sorted(r["id"] for r in rows) == [f"{i:08}" for i in range(251, 400) if i % 3 == 2]
    assert eventlog.BatchReader(path, ["id"], eventlog.Wanted(frozenset({"never"}))).partitions() == []


def test_a_restart_goes_on_from_the_offset(spark, path, tmp_path):
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    seen = []
    for n in range(3):
        eventlog.append(events(spark, n * 50, n * 50 + 50), path)
        found = streaming.drain(eventlog.tail(spark, path, ["reply.received"]).select("id"), out, cp)
        seen.append(found.count())
    assert seen == [16, 33, 50]
    assert found.distinct().count() == 50


def test_a_failed_write_is_not_read(spark, path):
    eventlog.append(events(spark, 0, 10), path)
    log = eventlog.Log(path)
    writer = eventlog.Writer(path)
    lost = writer.write(iter(events(spark, 10, 20).toArrow().to_batches()))
    assert eventlog.replay(spark, path).count() == 10
    writer.abort([lost, None])
    assert len(log.fs.get_file_info(eventlog.fs.FileSelector(f"{log.base}/segments"))) == len(log.segments(0, 9))
    bad = events(spark, 10, 20).withColumn("payload", F.when(F.col("id") == "00000015", F.raise_error(F.lit("no"))).otherwise("{}"))
    with pytest.raises(Exception, match="no"):
        eventlog.append(bad, path)
    assert log.commits() == [1] and eventlog.replay(spark, path).count() == 10
