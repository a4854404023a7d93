"""Random indexing against a plain count, the network's gradient, and the classifier on held-out rows."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from oracle import SMALL
from pyspark.sql import functions as F

from fieldnotes.llm import quality
from fieldnotes.llm.common import held_out

TEXTS = ["The cat, the dog!", "", None, "a", "Größe 12 %%% a_b", " \n\t ", "one two one two one"]


def naive_tokens(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20\x7f]+", (text or "").encode())


def test_tokens():
    encoded = [(t or "").encode() for t in TEXTS]
    tokens = quality.tokens_of(encoded)
    want = [(i, w) for i, t in enumerate(TEXTS) for w in naive_tokens(t)]
    assert tokens.text.tolist() == [i for i, _ in want]
    assert tokens.hashes[tokens.word].tolist() == [xxhash.xxh64_intdigest(w, 12) for _, w in want]


@pytest.mark.parametrize("piece", [50_000, 3])
def test_table_equals_plain_count(spark, monkeypatch, piece):
    rows = 64
    monkeypatch.setattr(quality, "PIECE", piece)
    monkeypatch.setattr(quality, "BLOCK", 16)
    table = np.zeros((rows, quality.DIMS + 1), np.int64)
    for text in TEXTS * 3:
        words = naive_tokens(text)
        hashes = np.array([xxhash.xxh64_intdigest(w, 12) for w in words], np.uint64)
        at, sign = quality.index_vectors(hashes)
        two = quality.rows_of(hashes, rows)
        for i in range(len(words)):
            for row in two[:, i]:
                table[row, -1] += 1
                for j in range(max(0, i - quality.REACH), min(len(words), i + quality.REACH + 1)):
                    if j != i:
                        for d, s in zip(at[j], sign[j], strict=True):
                            table[row, d] += s
    batches = [pa.RecordBatch.from_arrays([pa.array(TEXTS)], names=["text"])] * 3
    got = np.zeros_like(table)
    for b in quality._add(iter([*quality._indexer(rows)(iter(batches[:1])), *quality._indexer(rows)(iter(batches[1:]))])):
        block = b.column("block")[0].as_py()
        got[block * 16 : block * 16 + 16] = np.frombuffer(zlib.decompress(b.column("sums")[0].as_py()), np.int64).reshape(16, -1)
    assert (got == table).all()


def test_pooled_equals_plain_moments(monkeypatch):
    seed = np.random.default_rng(1)
    words = quality.Words(seed.normal(size=(32, quality.DIMS)).astype(np.float32), seed.integers(1, 50, 32), 500)
    encoded = [(t or "").encode() for t in TEXTS]
    whole = words.pooled(encoded)
    monkeypatch.setattr(quality, "PIECE", 2)
    assert np.allclose(whole, words.pooled(encoded), atol=1e-5)
    for text, row in zip(TEXTS, whole, strict=True):
        hashes = np.array([xxhash.xxh64_intdigest(w, 12) for w in naive_tokens(text)], np.uint64)
        if not len(hashes):
            assert not row.any()
            continue
        two = quality.rows_of(hashes, 32)
        less = np.where(words.counts[two[0]] <= words.counts[two[1]], two[0], two[1])
        x, w = words.vectors[less], quality.FREQUENT / (quality.FREQUENT + words.counts[less] / 500)
        mean = np.average(x, axis=0, weights=w)
        spread = np.sqrt(np.maximum(np.average(x**2, axis=0, weights=w) - mean**2, 0))
        step = np.sqrt((np.diff(x, axis=0) ** 2).sum(axis=0) / max(1, len(x) - 1))
        assert np.allclose(row, np.concatenate([mean, spread, step]), atol=1e-3)


def test_gradient():
    seed = np.random.default_rng(2)
    x, y = seed.normal(size=(20, 5)), seed.integers(0, 2, 20).astype(float)
    net = quality.Network(np.zeros(5), np.ones(5), [seed.normal(size=(5, 3)), seed.normal(size=3), seed.normal(size=3), np.array(0.2)])

    def loss():
        w1, _, w2, _ = net.parts
        return quality.log_loss(net.logits(x), y) + quality.DECAY * ((w1**2).sum() + (w2**2).sum()) / 2

    for part, g in zip(net.parts, net.gradient(x, y), strict=True):
        for at in np.ndindex(part.shape):
            was = float(part[at])
            part[at] = was + 1e-6
            up = loss()
            part[at] = was - 1e-6
            down = loss()
            part[at] = was
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5


def test_temperature_lowers_the_loss():
    seed = np.random.default_rng(3)
    x = seed.normal(size=(600, 4))
    y = (x[:, 0] + seed.normal(size=600) > 0).astype(int)
    keep = np.arange(600) % 5 == 0
    net = quality.Network.fit(x, y, keep, steps=100)
    best = quality.log_loss(net.logits(x[keep]) / net.temperature, y[keep])
    assert all(best <= quality.log_loss(net.logits(x[keep]) / t, y[keep]) + 1e-9 for t in (net.temperature * 0.8, net.temperature * 1.25))


def test_held_out_rows_and_awkward_ones(spark):
    """Junk has marks glued to words; the classifier learns that from three quarters of the rows."""
    good = [(i, f"the small word number {i} is here and so is word {i * 7 % 50} too", 1) for i in range(300)]
    junk = [(300 + i, f"w{i % 9}$$$ x%%% the### w{i % 5}&&& here%%%", 0) for i in range(150)]
    extra = [(900, None, None), (901, "", None), (902, "long " * 60_000, None), (None, "no id", None), (5, good[5][1], None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in [*good, *junk, *extra]], "doc_id long, text string, QUALITY string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in [*good, *junk]] + [(1, 1), (None, 0), (7, 9), (100_000, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, rows=1024)
    found = quality.quality(docs, model).withColumn("held", held_out(F.col("doc_id")))
    assert found.columns == ["doc_id", "text", "quality", "held"]
    rows = found.collect()
    assert len(rows) == len(good) + len(junk) + len(extra) and all(0 <= r["quality"] <= 1 for r in rows)
    held = [(r["quality"] >= 0.5) == (r["doc_id"] < 300) for r in rows if r["held"] and r["doc_id"] is not None and r["doc_id"] < 450]
    assert len(held) > 80 and np.mean(held) > 0.95


def test_labels_of_held_out_rows_dont_matter(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    other = labels.withColumn("quality", (held_out(labels["doc_id"]).cast("int") + labels["quality"]) % 2)
    same = [quality.quality(docs, quality.train(docs, given, rows=4096)).select("doc_id", "quality").collect() for given in (labels, other)]
    assert sorted(same[0]) == sorted(same[1])


def test_one_kind_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for given, want in (([(1, 1)], 1.0), ([(1, 0)], 0.0), ([], 0.0)):
        labels = spark.createDataFrame(given, "doc_id long, quality int")
        assert [r["quality"] for r in quality.quality(docs, quality.train(docs, labels, rows=64)).collect()] == [want, want]
    none = docs.limit(0)
    assert quality.quality(none, quality.train(none, labels, rows=64)).collect() == []
