"""Languages without a shuffle of trigrams; rows of one key are one text; pages in small batches."""

from pyspark.sql import functions as F

from fieldnotes.functions import html
from fieldnotes.operators import language
from fieldnotes.plans import extraction

KNOWN = [("en", "the cat and the dog are in the house"), ("fr", "le chat et le chien sont dans la maison")]
SCHEMA = "id long, text string"


def test_rows_of_one_key_are_one_text(spark):
    profiles = language.profiles(spark.createDataFrame(KNOWN, "lang string, text string"))
    rows = [(1, "the dog"), (1, "dans la maison avec le chien"), (2, "the cat"), (None, "la maison"), (None, "le chat"), (3, "12")]
    got = {(r["id"], r["language"], r["distance"]) for r in language.languages(spark.createDataFrame(rows, SCHEMA), profiles, "id").collect()}
    # texts that are cut at the same blanks have the trigrams of both
    grams = language.ranked(language.trigrams(spark.createDataFrame(rows, SCHEMA), "id"), "id")
    near = grams.withColumnRenamed("rank", "own").join(profiles, "gram").groupBy("id", "lang").agg(F.count("*").alias("both"), F.sum(F.abs(F.col("own") - F.col("rank"))).alias("apart"))
    sizes = {r["id"]: r["n"] for r in grams.groupBy("id").agg(F.count("*").alias("n")).collect()}
    best = {}
    for r in near.collect():
        at = (r["apart"] + language.RANKS * (sizes[r["id"]] - r["both"]), r["lang"])
        best[r["id"]] = min(best.get(r["id"], at), at)
    assert got == {(k, lang, n) for k, (n, lang) in best.items()} and len(got) == 3


def test_no_trigram_is_shuffled(spark):
    profiles = language.profiles(spark.createDataFrame(KNOWN, "lang string, text string"))
    found = language.languages(spark.createDataFrame([(i, "the cat") for i in range(9)], SCHEMA), profiles, "id")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 9


def test_pages_come_in_small_batches(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.range(3).select(F.col("id").alias("page_id"), F.lit("<p>a</p>").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
        assert extraction.articles(spark, str(tmp_path)).count() == 3
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == html.ARROW_PAGES
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
