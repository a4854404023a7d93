"""The versioned store: upserts, failed and repeated commits, conflicts, snapshots, vacuum, streams."""

import pytest
from pyspark.sql import functions as F

from fieldnotes.sources.store import Conflict, Store, Table, sink

ROW = "id long, v long, x string"


@pytest.fixture
def store(tmp_path):
    return Store(f"file://{tmp_path}/store", {"t": Table("id", "v"), "log": Table("id", "v")}, buckets=8)


def rows(spark, store, table="t", number=None):
    found = store.read(spark, table, number)
    return None if found is None else sorted(tuple(r) for r in found.collect())


def df(spark, *given, schema=ROW):
    return spark.createDataFrame(list(given), schema)


def test_upsert_latest_version_and_travel(spark, store):
    assert rows(spark, store) is None
    assert store.commit(spark, {"t": df(spark, *[(i, 1, "a") for i in range(50)])}) == 1
    assert store.commit(spark, {"t": df(spark, (3, 2, "b"), (3, 2, "c"), (4, 0, "old"), (5, 1, "same"), (99, 1, "new"), (None, 1, "no key"))}) == 2
    want = {i: (i, 1, "a") for i in range(50)} | {3: (3, 2, "c"), 5: (5, 1, "same"), 99: (99, 1, "new")}
    assert rows(spark, store) == sorted(want.values())
    assert rows(spark, store, number=1) == [(i, 1, "a") for i in range(50)]
    again = store.commit(spark, {"t": df(spark, (3, 2, "c"), (99, 1, "new"))})
    assert rows(spark, store, number=again) == sorted(want.values())  # twice is once


def test_only_touched_buckets_are_rewritten(spark, store):
    store.commit(spark, {"t": df(spark, *[(i, 1, "a") for i in range(200)])})
    before = store.snapshot(spark)["tables"]["t"]["files"]
    store.commit(spark, {"t": df(spark, (7, 2, "b"))})
    after = store.snapshot(spark)["tables"]["t"]["files"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert store.commit(spark, {"t": df(spark, (7, 2, "b")).limit(0)}) == 3 and store.snapshot(spark)["tables"]["t"]["files"] == after


def test_killed_before_the_switch(spark, store):
    store.commit(spark, {"t": df(spark, (1, 1, "a")), "log": df(spark, (1, 1, "made"))})

    def die():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.commit(spark, {"t": df(spark, (1, 2, "b"), (2, 1, "b")), "log": df(spark, (2, 1, "made"))}, before_switch=die)
    assert rows(spark, store) == [(1, 1, "a")] and rows(spark, store, "log") == [(1, 1, "made")]
    store.commit(spark, {"t": df(spark, (2, 1, "b"))})
    assert rows(spark, store) == [(1, 1, "a"), (2, 1, "b")]


def test_two_writers(spark, store):
    store.commit(spark, {"t": df(spark, (1, 1, "a"))})
    other = lambda: store.commit(spark, {"t": df(spark, (2, 1, "other"))})
    with pytest.raises(Conflict):
        store.commit(spark, {"t": df(spark, (3, 1, "mine"))}, before_switch=other)
    assert rows(spark, store) == [(1, 1, "a"), (2, 1, "other")]


def test_deleted_keys_stay_deleted(spark, store):
    store.commit(spark, {"t": df(spark, (1, 1, "a"), (2, 1, "a"))})
    store.commit(spark, {"t": df(spark, (1, 5, "a", True), (2, 0, "late", True), schema=ROW + ", gone boolean")}, deleted="gone")
    assert rows(spark, store) == [(2, 1, "a")]
    store.commit(spark, {"t": df(spark, (1, 4, "older"))})
    assert rows(spark, store) == [(2, 1, "a")]
    store.commit(spark, {"t": df(spark, (1, 6, "newer"))})
    assert rows(spark, store) == [(1, 6, "newer"), (2, 1, "a")]


def test_rebuilt_from_its_source(spark, store, tmp_path):
    source = df(spark, *[(i % 40, i, f"x{i}") for i in range(120)])
    for k in range(3):
        store.commit(spark, {"t": source.filter(F.col("v") % 3 == k)})
    new = Store(f"file://{tmp_path}/new", store.tables, buckets=3)
    new.commit(spark, {"t": source})
    assert rows(spark, new) == rows(spark, store) and len(rows(spark, new)) == 40


def test_vacuum(spark, store):
    for n in range(4):
        store.commit(spark, {"t": df(spark, *[(i, n, f"{n}") for i in range(20)])})
    with pytest.raises(ZeroDivisionError):
        store.commit(spark, {"t": df(spark, (1, 9, "never"))}, before_switch=lambda: 1 / 0)
    assert store.vacuum(spark, keep=2) > 0
    assert store.snapshots(spark) == [3, 4]
    assert rows(spark, store) == [(i, 3, "3") for i in range(20)] and rows(spark, store, number=3) == [(i, 2, "2") for i in range(20)]


def test_stream_with_its_events_and_a_repeated_batch(spark, store, tmp_path):
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    made = lambda b: {"t": b, "log": b.select("id", "v", F.lit("completed").alias("x"))}
    write = sink(store, "agents", made)
    for n in range(3):
        df(spark, (n, 1, "a"), (n + 10, 1, "b")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(src)
        stream.writeStream.option("checkpointLocation", cp).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    number = store.snapshot(spark)["number"]
    write(df(spark, (77, 1, "repeat")), 1)  # a batch that was committed before
    assert store.snapshot(spark)["number"] == number
    assert [r[0] for r in rows(spark, store)] == [r[0] for r in rows(spark, store, "log")] == [0, 1, 2, 10, 11, 12]
