"""The pipeline against brute force on a fixture."""

import corpus_pipeline
from oracle import SMALL
from pyspark.sql import functions as F
from test_linededup import brute_texts
from test_operators_llm import DOCS, brute_leaks
from test_similar import brute_kept

from fieldnotes.llm import mixing


def tables(spark, tmp_path, extra=()):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 60")
    more = [(900, None, "en", "src0", 0), (901, "123 !", "en", None, 5), (902, "", None, None, 0), (903, "a lonely clean line about nothing in particular", "en", None, 47)]
    docs = docs.unionByName(spark.createDataFrame(more, DOCS))
    for name in extra:
        docs = docs.withColumn(name, F.lit(name))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_equal_brute_force(spark, tmp_path):
    d = tables(spark, tmp_path)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    docs = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    docs = dict(brute_texts(list(docs.items())))
    kept = brute_kept(docs)
    docs = {i: t for i, t in docs.items() if i in kept}
    docs = {i: t for i, t in docs.items() if not brute_leaks(t, items)[1]}
    frame, kept = spark.read.parquet(f"{d}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        kept = frame
        frame = stage(spark, frame, d)
        if name != "mix":
            assert frame.columns == kept.columns
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == docs and 903 in docs
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(kept).select("doc_id", "mix.copies").collect()}
    got = corpus_pipeline.run(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("last")).collect()
    assert {r["doc_id"]: (r["n"], r["last"]) for r in got} == {i: (n, n) for i, n in copies.items() if n}


def test_clashing_columns_and_empty_input(spark, tmp_path):
    names = ("language", "leak", "mix", "copy", "gone", "gone_id", "drop_id", "mix_source")
    d = tables(spark, tmp_path / "a", names)
    out = corpus_pipeline.run(spark, d)
    assert set(names) <= set(out.columns) and "_copy" in out.columns and out.count() > 0
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []
