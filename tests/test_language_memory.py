"""Languages in bounded memory: a task counts text by text, not a batch of them."""

import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from fieldnotes.operators import language
from fieldnotes.plans import extraction

WORDS = [f" {a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"]


def test_a_batch_of_texts_becomes_few_counts():
    texts = ["".join(random.Random(i).choices(WORDS, k=500)) + " " for i in range(1_500)]
    batch = pa.record_batch({"lang": ["en", None, "fr"] * 500, "text": texts})
    tracemalloc.start()
    most, total, langs = 0, 0, set()
    for made in language.counted(iter([batch])):
        most, total, langs = max(most, len(made)), total + sum(made["n"].to_pylist()), langs | set(made["lang"].to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == sum(len(t) - 2 for t in texts) and langs == {"en", None, "fr"}
    assert most < 12_000 and peak < 80e6


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        text = F.repeat(F.lit("the dog "), 200_000)
        spark.range(24).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), text.alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
        found = extraction.detected(spark, str(tmp_path))
        assert {(r["language"], r["distance"]) for r in found.collect()} == {("en", 0)}
        sizes = spark.read.parquet(f"{tmp_path}/documents.parquet").select("text").mapInArrow(lambda batches: (pa.record_batch({"n": [b.nbytes]}) for b in batches), "n long").collect()
        assert sum(r["n"] for r in sizes) > 24 * 1_600_000 and max(r["n"] for r in sizes) < 3 * language.ARROW_BYTES
    finally:
        spark.conf.set(name, before)


def test_trigrams_beyond_two_bytes_and_ties(spark):
    known = spark.createDataFrame([("b", "\U00010400\U00010401 жук"), ("a", "\U00010400\U00010401 жук"), ("c", "xyz")], "lang string, text string")
    found = language.languages(spark.createDataFrame([(1, "\U00010428\U00010429 ЖУК"), (2, "xyz")], "id long, text string"), language.profiles(known), "id")
    assert sorted(map(tuple, found.collect())) == [(1, "a", 0), (2, "c", 0)]


def test_no_language_is_known(spark):
    none = spark.createDataFrame([], "lang string, text string")
    found = language.languages(spark.createDataFrame([(1, "xyz")], "id long, text string"), language.profiles(none), "id")
    assert list(map(tuple, found.collect())) == [(1, None, 3 * language.RANKS)]
