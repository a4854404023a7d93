"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every token has an index vector, ``DIMS`` numbers of which ``ONES`` are +1 or -1, drawn from its hash.  A
word's vector is the sum of the index vectors of its neighbours, up to ``REACH`` tokens away, over all
documents.  Sums are integers, so the vectors don't depend on how rows are split or ordered.

No word is left out, and the table doesn't grow with the vocabulary: a word is kept in two of ``ROWS`` rows,
by two hashes, and read from the row that is used less, as in a count-min sketch.  A rare word's vector is
drawn towards zero, and every vector is taken relative to that of the average word.

A document is the mean and the spread of its tokens' vectors, frequent tokens counting less, and the mean
step from one token's vector to the next, which is short where words repeat.  The network
has ``HIDDEN`` units, trained in numpy on labelled rows that may be learned from, at most ``SAMPLE`` of them (the
first by a hash of id and text).  A fifth of them, by another hash, is kept from training: it says when to
stop, and its least loss gives the temperature by which the scores are divided, so that they are
probabilities.  Labels, lang, source and ids are never inputs of a score.

Plan: one pass over all texts in Arrow batches; each task adds up a table of its own and hands it out in
blocks of rows, whose sums are a shuffle of at most a table for each task.  The table (``ROWS`` x ``DIMS``
numbers) is broadcast; a second pass pools and scores.  A long text is taken in pieces of ``PIECE`` tokens.

Defined cases: null and empty texts have the zero vector and are scored as such; repeated labels of a
document count once (the least), and so do repeated rows; labels of no document, null ids and other values
than 0 and 1 aren't learned from; without labels of both kinds every score is the only label's value, or 0
without any; very long texts are read whole; other columns stay, and where ``into`` names one, it is
replaced; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldnotes.llm.common import binaries, bounded, fetched, held_out, read, small_batches, uniform

DIMS = 64
ONES = 8
REACH = 2
ROWS = 1 << 16
#: Rows of the table that are handed out together.
BLOCK = 256
#: A word's vector counts as if it had been seen so many times more with average neighbours.
SHRINK = 20.0
#: A token of this share of all tokens counts half.
FREQUENT = 1e-3
PIECE = 50_000
#: Bytes of text that are read at a time, if no single text is longer.
RUN_BYTES = 4_000_000
SAMPLE = 20_000
HIDDEN = 32
STEPS = 400
RATE = 0.01
DECAY = 1e-4
#: Of five parts of the sample, one calibrates.
FOLDS = 5
THRESHOLD = 0.7


def kinds_of_bytes() -> np.ndarray:
    """0 for blanks and control characters, 1 for letters, digits and what isn't ASCII, 2 for other signs."""
    kind = np.full(256, 2, np.uint8)
    kind[:0x21] = 0
    kind[0x7F] = 0
    for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        kind[lo:hi] = 1
    return kind


_KIND = kinds_of_bytes()


@dataclass
class Tokens:
    """Tokens of some texts: number of the word and of the text of each, and each word's hash."""

    word: np.ndarray
    text: np.ndarray
    hashes: np.ndarray


def tokens_of(texts: list[bytes]) -> Tokens:
    """A token is a run of letters and digits or a run of other signs, letter case kept."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = _KIND[data]
    begins = np.flatnonzero((kind != 0) & (np.concatenate([[0], kind[:-1]]) != kind))
    seen = kind != 0
    upto = np.concatenate([[0], np.cumsum(seen)])
    offsets = np.append(upto[begins], upto[-1])
    letters = data[seen]
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w, 12) for w in binaries(words.dictionary)], np.uint64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return Tokens(words.indices.to_numpy().astype(np.int64), np.searchsorted(ends, begins, side="right"), hashes)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th number drawn from hashes (a splitmix64 step)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def index_vectors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word's index vector has its ones, and their signs."""
    drawn = np.stack([_mixed(hashes, k + 3) for k in range(ONES)], axis=1)
    return (drawn % np.uint64(DIMS)).astype(np.int64), np.where(drawn >> np.uint64(63), 1, -1)


def rows_of(hashes: np.ndarray, rows: int) -> np.ndarray:
    """The two rows of each word."""
    return np.stack([(_mixed(hashes, k) % np.uint64(rows)).astype(np.int64) for k in (1, 2)])


def context_sums(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """How often each word occurs, and the sum of its neighbours' index vectors."""
    (at, sign), n = index_vectors(tokens.hashes), len(tokens.hashes)
    sums = np.zeros((n, DIMS), np.int64)
    flat = sums.ravel()
    for lo in range(0, len(tokens.word), PIECE):
        word, text = tokens.word[lo : lo + PIECE + REACH], tokens.text[lo : lo + PIECE + REACH]
        for k in range(1, REACH + 1):
            same = np.flatnonzero(text[k:][:PIECE] == text[:-k][:PIECE])
            left, right = word[same], word[same + k]
            for one, other in ((left, right), (right, left)):
                np.add.at(flat, (one[:, None] * DIMS + at[other]).ravel(), sign[other].ravel())
    return np.bincount(tokens.word, minlength=n), sums


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    """Numbers and bytes of the texts of a batch, null as empty, about ``RUN_BYTES`` at a time."""
    at, held, size = [], [], 0
    for i, text in enumerate(batch.column("text").to_pylist()):
        at.append(i)
        held.append((text or "").encode())
        size += len(held[-1])
        if size >= RUN_BYTES:
            yield at, held
            at, held, size = [], [], 0
    if at:
        yield at, held


def _indexer(rows: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((rows, DIMS + 1), np.int64)  # the last column counts
        for batch in batches:
            for _, texts in _texts(batch):
                tokens = tokens_of(texts)
                if len(tokens.word):
                    n, sums = context_sums(tokens)
                    both = np.column_stack([sums, n]).ravel()
                    for at in rows_of(tokens.hashes, rows):
                        np.add.at(table.ravel(), (at[:, None] * (DIMS + 1) + np.arange(DIMS + 1)).ravel(), both)
        yield from _blocks(table)

    return index


def _blocks(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(table), BLOCK):
        part = table[lo : lo + BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([lo // BLOCK], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["block", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(sums), np.int64)
            held[block] = held[block] + part if block in held else part
    for block, part in sorted(held.items()):
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["block", "sums"])


@dataclass
class Words:
    """Word vectors by row, and how often each row is used."""

    vectors: np.ndarray
    counts: np.ndarray
    total: int

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Three lists of numbers for each text: the mean of its tokens' vectors, the root of the mean of
        their squares about it, and that of the squares of steps from one token to the next."""
        tokens, n = tokens_of(texts), len(texts)
        two = rows_of(tokens.hashes, len(self.counts))
        less = np.where(self.counts[two[0]] <= self.counts[two[1]], two[0], two[1])
        share = self.counts[less] / max(1, self.total)
        weight = (FREQUENT / (FREQUENT + share)).astype(np.float32)
        bounds = np.searchsorted(tokens.text, np.arange(n + 1))
        out = np.zeros((n, 3 * DIMS), np.float32)
        for i, (lo, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            sums, squares, steps, size = np.zeros(DIMS), np.zeros(DIMS), np.zeros(DIMS), 0.0
            for a in range(lo, end, PIECE):
                word = tokens.word[a : min(end, a + PIECE + 1)]  # one more, for the step to it
                x = self.vectors[less[word]]
                w = weight[word]
                step = x[1:] - x[:-1]
                steps += np.einsum("ij,ij->j", step, step)
                x, w = x[:PIECE], w[:PIECE]
                sums += w @ x
                squares += w @ (x * x)
                size += w.sum(dtype=np.float64)
            if size:
                mean = sums / size
                out[i] = np.concatenate([mean, np.sqrt(np.maximum(squares / size - mean * mean, 0)), np.sqrt(steps / max(1, end - lo - 1))])
        return out


def word_vectors(docs: DataFrame, rows: int = ROWS) -> Words:
    """Random indexing over all texts of ``docs``."""
    parts = docs.select("text").mapInArrow(_indexer(rows), "block long, sums binary")
    sums = parts.repartition("block").mapInArrow(_add, "block long, sums binary")
    table = np.zeros((rows, DIMS + 1), np.int64)
    blocks = fetched(sums)
    for block, packed in zip(blocks["block"], blocks["sums"], strict=True):
        part = np.frombuffer(zlib.decompress(packed), np.int64).reshape(-1, DIMS + 1)
        table[block * BLOCK : block * BLOCK + len(part)] += part
    near, counts = table[:, :DIMS], table[:, DIMS]
    total = int(counts.sum()) // 2
    average = near.sum(axis=0) / max(1, counts.sum())
    vectors = (near - counts[:, None] * average) / (counts[:, None] + SHRINK)
    return Words(vectors.astype(np.float32), counts, total)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def log_loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


@dataclass
class Network:
    """Two layers; scores are probabilities after division by the temperature."""

    middle: np.ndarray
    scale: np.ndarray
    parts: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts
        return np.tanh((x - self.middle) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x.astype(np.float64)) / self.temperature)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean loss and the decay; ``x`` is scaled."""
        w1, b1, w2, b2 = self.parts
        h = np.tanh(x @ w1 + b1)
        d = (_sigmoid(h @ w2 + b2) - y) / len(y)
        back = np.outer(d, w2) * (1 - h * h)
        return [x.T @ back + DECAY * w1, back.sum(axis=0), h.T @ d + DECAY * w2, np.array(d.sum())]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, keep: np.ndarray, steps: int = STEPS) -> Network:
        """Adam on the rows that ``keep`` doesn't name; those that it names choose the step and the temperature."""
        x, y = x.astype(np.float64), y.astype(np.float64)
        seed = np.random.default_rng(12)
        one = [seed.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), seed.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(0.0)]
        net = cls(x[~keep].mean(axis=0), x[~keep].std(axis=0) + 1e-6, one)
        scaled, labels = (x[~keep] - net.middle) / net.scale, y[~keep]
        m, v = [np.zeros_like(p) for p in one], [np.zeros_like(p) for p in one]
        best, least = net.parts, np.inf
        for t in range(1, steps + 1):
            new = []
            for i, (p, g) in enumerate(zip(net.parts, net.gradient(scaled, labels), strict=True)):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                new.append(p - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8))
            net.parts = new
            loss = log_loss(net.logits(x[keep]), y[keep])
            if loss < least:
                best, least = new, loss
        net.parts = best
        # the loss is convex in the reciprocal of the temperature
        logits, lo, hi = net.logits(x[keep]), 0.05, 20.0
        for _ in range(60):
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            lo, hi = (lo, b) if log_loss(logits * a, y[keep]) <= log_loss(logits * b, y[keep]) else (a, hi)
        net.temperature = 2 / (lo + hi)
        return net


@dataclass
class Classifier:
    words: Words
    network: Network | None
    constant: float = 0.0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.constant)
        return self.network.scores(self.words.pooled(texts))


def _labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(doc_id, label, text) of rows that may be learned from."""
    given = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    given = given.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    share = 2 * sample / max(1, given.count())  # twice as many as asked for, so that a join finds enough
    some = bounded(given.filter(uniform(F.lit("quality"), F.col("doc_id")) < share))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(some, "doc_id")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, rows: int = ROWS) -> Classifier:
    words = word_vectors(docs, rows)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at, texts in _texts(batch):
                part = batch.take(pa.array(at))
                vectors = pa.array([v.tobytes() for v in known.pooled(texts)], pa.binary())
                draw = pa.array([xxhash.xxh64_intdigest(t, 5) >> 1 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), draw, vectors], names=["doc_id", "label", "draw", "x"])

    found = _labelled(docs, labels, label, sample).mapInArrow(pool, "doc_id long, label int, draw long, x binary")
    draw = F.xxhash64("doc_id", "draw")
    few = fetched(found.dropDuplicates(["doc_id", "draw"]).withColumn("order", draw).orderBy("order", "doc_id", "draw").limit(sample))
    if few["label"].nunique() < 2:
        return Classifier(words, None, float(few["label"].max()) if len(few) else 0.0)
    x = np.frombuffer(b"".join(few["x"]), np.float32).reshape(len(few), -1)
    keep = np.array([zlib.crc32(f"fold:{i}".encode()) % FOLDS == 0 for i in few["doc_id"]])
    y = few["label"].to_numpy()
    if len(set(y[keep])) < 2 or len(set(y[~keep])) < 2:  # too few to keep some back
        return Classifier(words, _uncalibrated(x, y))
    return Classifier(words, Network.fit(x, y, keep))


def _uncalibrated(x: np.ndarray, y: np.ndarray) -> Network:
    """Of very few labels: all train, and all choose the step."""
    both = np.concatenate([x, x]), np.concatenate([y, y])
    return Network.fit(*both, np.arange(2 * len(y)) >= len(y))


def quality(docs: DataFrame, classifier: Classifier, into: str = "quality") -> DataFrame:
    """All rows and columns of ``docs`` with the probability of label 1 in ``quality`` (or ``into``)."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    rest = [f for f in docs.schema.fields if f.name.lower() != into.lower()]
    row = T.StructType([T.StructField("_kept", T.StructType(rest)), T.StructField("_score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, texts in _texts(batch):
                part = batch.take(pa.array(at)) if len(at) < batch.num_rows else batch
                yield pa.RecordBatch.from_arrays([part.column("_kept"), pa.array(model.scores(texts))], names=["_kept", "_score"])

    held = docs.select(F.struct(*[F.col(f"`{f.name}`") for f in rest]).alias("_kept"), F.col("text"))
    found = held.mapInArrow(score, row)
    return found.select(*[F.col(f"_kept.`{f.name}`") for f in rest], F.col("_score").alias(into))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality(docs, train(docs, read(spark, sf_dir, "labels")), "score")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
