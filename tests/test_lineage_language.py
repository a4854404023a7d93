"""What follows from a replay over many parents; languages by ranked trigrams; complete streams."""

from datetime import datetime

from fieldnotes import streaming
from fieldnotes.operators import events, language


def reach(spark, edges, start):
    e = spark.createDataFrame(edges, "parent long, child long")
    return sorted((r["id"], r["depth"]) for r in events.downstream(e, spark.createDataFrame([(s,) for s in start], "id long")).collect())


def test_downstream(spark):
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (2, 5), (5, 1), (6, 7), (4, 4), (1, 2), (None, 9), (9, None)]
    assert reach(spark, edges, [1, 1]) == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 2)]
    assert reach(spark, edges, [6, 77, None]) == [(6, 0), (7, 1), (77, 0)]
    assert reach(spark, edges, []) == []


def test_one_parent_of_most(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(i, 5000) for i in range(1, 3000)]
    got = reach(spark, edges, [0])
    assert len(got) == 3001 and (5000, 2) in got


def test_languages(spark):
    known = [("en", "the cat and the dog are in the house with the other animals"), ("fr", "le chat et le chien sont dans la maison avec les autres animaux"), (None, "the the the")]
    profiles = language.profiles(spark.createDataFrame(known, "lang string, text string"))
    rows = [(1, "The dog, and the cat!"), (2, "LE CHIEN dans la maison"), (3, "123 ..."), (4, ""), (5, None), (6, "Ωμέγα"), (7, "the " * 30_000)]
    found = language.languages(spark.createDataFrame(rows, "id long, text string"), profiles, "id").collect()
    got = {r["id"]: r["language"] for r in found}
    assert got == {1: "en", 2: "fr", 6: "en", 7: "en"}  # the least name where nothing is shared
    assert language.languages(spark.createDataFrame([], "id long, text string"), profiles, "id").collect() == []


def test_a_complete_result_is_read_from_its_last_batch(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "company_id long, cost_usd double, occurred_at timestamp"
    for n in range(3):
        spark.createDataFrame([(1, 1.0, datetime(2024, 1, 1, n))], schema).coalesce(1).write.mode("append").parquet(src)
        stream = streaming.cost_daily(spark.readStream.schema(schema).parquet(src))
        rows = streaming.drain(stream, out, cp, "complete").collect()
        assert [(r["company_id"], r["calls"]) for r in rows] == [(1, n + 1)]
