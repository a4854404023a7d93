"""LM scoring: masked pseudo-likelihood of a bidirectional window network.

Every token is predicted from ``SIDE`` tokens on each side of it, the token itself masked.  The
network embeds the neighbours, joins them into one hidden layer (tanh) and ends in a softmax over
token classes; it is written and trained in numpy.  A text's score is the sum of the conditional
log-probabilities of its tokens.

Tokens are words in lower case.  The ``OWN`` most frequent words of the whole corpus are classes
of their own; the others share ``SHARED`` classes by a hash, and a token's probability is its class's
times the word's share of the class in the corpus: of the ``TABLE`` most frequent words by their own
counts; what they leave of a class is dealt evenly to its rarer words, of which there are as many as
were counted.  The shares of a class sum to 1.  The query gives the rarer words their own counts too: those of
a text are joined to the table of counts, and the sum of what that changes is added to the text's score.  Words
that occur once aren't looked up: the logarithm of their count is 0.

Training is distributed, and uses what grows with the input: words are counted over all texts
(combined in each task before the shuffle), and texts are dealt to ``ROUNDS`` rounds by a hash, so
that each text is learned from once.  In a round every task trains a copy of the network on its
documents of that round; the copies are averaged by tokens seen.  Averages are sums by parameter, combined before their shuffle, so the
driver only ever gets one network (about ``parameters()`` numbers) and ``OWN`` words.

Training and scoring read the texts as classes, a byte a token, from a table in the shared folder.
Scoring needs no shuffle.  A text is processed whole, in pieces of ``PIECE`` tokens with their
neighbours, so memory doesn't depend on its length.

A task's copy depends on which texts it reads and in which order, so scores vary a little with how the
input is split into tasks; one split gives one result, whichever executors run it.

Defined cases: null and blank texts have no tokens and score 0; repeated rows get equal scores; very
long texts are taken in pieces; other columns stay, and where ``into`` names one, it is replaced; an
empty corpus leaves the initial network.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldnotes.llm import scratch
from fieldnotes.llm.common import fetched, read, small_batches

SIDE = 2
OWN = 127
SHARED = 32
TABLE = 1 << 17
PAD = OWN + SHARED
CLASSES = PAD + 1
DIM = 12
HIDDEN = 24
ROUNDS = 2
PIECE = 1 << 14
BATCH = 512
#: Tokens a product of the network takes when scoring: what it makes stays in a core's cache.
STEP = 2048
RATE = 0.5
#: Words that a counter holds before it is emptied.
FLUSH = 600_000

_ONES = np.ones(CLASSES, np.float32)
_SPOTS = np.arange(CLASSES * DIM).reshape(CLASSES, DIM)
_SHAPES = {"embed": (CLASSES, DIM), "join": (2 * SIDE * DIM, HIDDEN), "offset": (HIDDEN,), "out": (HIDDEN, CLASSES), "prior": (CLASSES,)}


def parameters() -> int:
    return sum(int(np.prod(s)) for s in _SHAPES.values())


class Network:
    """The window network; ``flat`` holds all parameters."""

    def __init__(self, flat: np.ndarray | None = None, seed: int = 5):
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([rng.normal(0, 0.1, int(np.prod(s))) if n in ("embed", "join", "out") else np.zeros(int(np.prod(s))) for n, s in _SHAPES.items()])
        self.flat = np.array(flat, np.float32)
        at = 0
        for name, shape in _SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + size].reshape(shape))
            at += size
        #: The last layer with its offsets as a last row: they follow each other.
        self.last = self.flat[-(HIDDEN + 1) * CLASSES :].reshape(HIDDEN + 1, CLASSES)

    def hidden(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joined embeddings and the hidden layer, with a 1 at its end, for rows of neighbour classes."""
        x = self.embed.take(near.ravel(), axis=0).reshape(len(near), -1)
        h = np.ones((len(near), HIDDEN + 1), np.float32)
        inner = x @ self.join
        inner += self.offset
        h[:, :HIDDEN] = np.tanh(inner, out=inner)
        return x, h

    def exponentials(self, h: np.ndarray) -> np.ndarray:
        """exp(z) of all classes, up to a factor for each row."""
        z = h @ self.last
        most = max(self.last.max(), -self.last.min())  # a cheap bound first
        # |h| <= 1, so below it neither these nor their sums, times the weights, can overflow
        if not most * (HIDDEN + 1) <= 60 and not np.abs(self.last).sum(axis=0).max() <= 60:
            z -= z.max(axis=1)[:, None]
        return np.exp(z, out=z)

    def forward(self, near: np.ndarray) -> np.ndarray:
        """Log-probabilities of all classes for rows of neighbour classes."""
        e = self.exponentials(self.hidden(near)[1])
        return np.log(e) - np.log(e.sum(axis=1, keepdims=True))

    def chosen(self, near: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Log-probability of each row's token."""
        e = self.exponentials(self.hidden(near)[1])
        return np.log(e[np.arange(len(token)), token] / (e @ _ONES))

    def learn(self, near: np.ndarray, token: np.ndarray, rate: float = RATE) -> None:
        """A step of gradient ascent on a batch."""
        m = len(token)
        x, h = self.hidden(near)
        e = self.exponentials(h)
        total = e @ _ONES
        e[np.arange(m), token] -= total  # the step of the last layer, up to a factor for each row
        step = (-rate / m / total)[:, None].astype(np.float32)
        dh = e @ self.out.T
        slope = h[:, :HIDDEN].copy()
        slope *= slope
        np.subtract(1, slope, out=slope)
        slope *= step
        dh *= slope
        dx = dh @ self.join.T
        h *= step
        self.last += (e.T @ h).T
        self.join += x.T @ dh
        self.offset += np.ones(m, np.float32) @ dh
        self.embed += np.bincount(_SPOTS.take(near.ravel(), axis=0).ravel(), dx.ravel(), CLASSES * DIM).reshape(self.embed.shape)


class Vocabulary(NamedTuple):
    """Classes of the words that have one of their own, log-shares of words in their class, and of a
    word without such by class."""

    own: dict[str, int]
    share: dict[str, float]
    rare: list[float]
    #: Logarithm of the mean count of the rare words of each shared class.
    even: list[float]


def _shared(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % SHARED


class Lexicon(dict):
    """Word -> number; ``cls`` and ``share`` by number.  Words without a share of their own aren't stored:
    those of a class share one number, from ``first`` on."""

    def __init__(self, known: Vocabulary):
        own = {w: known.share.get(w, known.rare[c]) for w, c in known.own.items()}
        others = [w for w in known.share if w not in own]
        super().__init__(zip([*own, *others], range(len(own) + len(others)), strict=True))
        self.first = len(self)
        shared = range(OWN, OWN + SHARED)
        self.cls = np.array([*(known.own[w] for w in own), *(OWN + _shared(w) for w in others), *shared], np.uint8)
        self.share = np.array([*own.values(), *(known.share[w] for w in others), *known.rare[OWN:]])
        self.even = np.array(known.even)

    def __missing__(self, word: str) -> int:
        return self.first + _shared(word)

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def read(self, words: list[str]) -> tuple[np.ndarray, float]:
        """The words' classes, and the sum of their log-shares of them."""
        at = self.numbers(words)
        return self.cls[at].astype(np.int64), float(self.share[at].sum())


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def windows(ids: np.ndarray) -> np.ndarray:
    """The neighbours of every token, a row each."""
    padded = np.full(len(ids) + 2 * SIDE, PAD)
    padded[SIDE : SIDE + len(ids)] = ids
    near = np.empty((len(ids), 2 * SIDE), np.int64)
    for k in range(2 * SIDE):
        d = k + (k >= SIDE)
        near[:, k] = padded[d : d + len(ids)]
    return near


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of all texts, as a table in the shared folder."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(words_of(text))
                if len(seen) > FLUSH:
                    yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
                    seen.clear()
        if seen:
            yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})

    counts = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return scratch.cut(counts, "words")


def vocabulary(docs: DataFrame, own: int = OWN, table: int | None = None, counts: DataFrame | None = None) -> Vocabulary:
    """The most frequent words of all texts (ties by word), numbered, and the shares of all others."""
    counts = word_counts(docs) if counts is None else counts
    table = TABLE if table is None else table
    top = fetched(counts.orderBy(F.desc("n"), "word").limit(max(own, table))).to_dict("records")
    first = {r["word"]: i for i, r in enumerate(top[:own])}
    at = F.pmod(F.crc32(F.encode("word", "UTF-8")), F.lit(SHARED)).cast("int")
    sums = {r["at"]: (r["n"], r["words"]) for r in counts.groupBy(at.alias("at")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    total, left, words = (np.zeros(SHARED) for _ in range(3))
    for i, (n, many) in sums.items():
        total[i], words[i] = n, many
    place = {r["word"]: _shared(r["word"]) for r in top}
    for r in top[:own]:  # words of their own are in no shared class
        total[place[r["word"]]] -= r["n"]
        words[place[r["word"]]] -= 1
    left += total
    for r in top[own:]:
        left[place[r["word"]]] -= r["n"]
        words[place[r["word"]]] -= 1
    share = dict.fromkeys(first, 0.0) | {r["word"]: float(np.log(r["n"] / total[place[r["word"]]])) for r in top[own:]}
    rare = [0.0] * OWN + [float(np.log(left[i] / total[i] / words[i])) if words[i] > 0 else 0.0 for i in range(SHARED)]
    even = [float(np.log(left[i] / words[i])) if words[i] > 0 else 0.0 for i in range(SHARED)]
    return Vocabulary(first, share, rare, even)


def rare_shares(codes: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, more): the sum of the logarithms of the counts of a text's rare words, for rows where it isn't 0.
    Words are joined as they occur, since few occur twice in a text; none of them is frequent."""
    words = codes.select("row", F.explode("rare").alias("word"))
    return words.join(counts.filter("n > 1"), "word").groupBy("row").agg(F.sum(F.log("n")).alias("more"))


def encoded(docs: DataFrame, own: Vocabulary, key: str = "doc_id") -> DataFrame:
    """(row, key, at, classes, share, rare, even) of all rows of ``docs``: a number, a hash, the text's classes, a byte
    a token, the sum of its words' log-shares, its words that have no share of their own, and the sum of what these
    have for the logarithm of a count.  It is a table in the shared folder, since training and scoring read it."""
    shared = docs.sparkSession.sparkContext.broadcast(Lexicon(own))

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lexicon = shared.value
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                at = lexicon.numbers(words)
                beyond = np.flatnonzero(at >= lexicon.first)
                even = float(lexicon.even[at[beyond] - lexicon.first].sum())
                rows.append((lexicon.cls[at].tobytes(), float(lexicon.share[at].sum()), [words[i] for i in beyond.tolist()], even))
            yield pd.DataFrame(rows, columns=["classes", "share", "rare", "even"])

    code = F.pandas_udf(encode, "classes binary, share double, rare array<string>, even double")(F.col("text"))
    rows = docs.select(key, F.xxhash64("text", F.lit("lm")).alias("at"), code.alias("code"))
    return scratch.cut(rows.select(F.monotonically_increasing_id().alias("row"), key, "at", "code.*"), "classes")


def train(codes: DataFrame, rounds: int = ROUNDS, one_in: int | None = None) -> Network:
    """Rounds of local training in every task, averaged by tokens seen.  Texts are dealt to ``one_in``
    parts, a part a round; all are learned from unless that is more than ``rounds``."""
    one_in = one_in or rounds
    net = Network()
    sc = codes.sparkSession.sparkContext
    for number in range(rounds):
        shared = sc.broadcast(net.flat)
        rate = RATE / (1 + number)

        def local(batches: Iterator[pd.DataFrame], shared=shared, rate=rate) -> Iterator[pd.DataFrame]:
            mine, seen = Network(shared.value), 0
            for batch in batches:
                for code in batch["classes"]:
                    ids = np.frombuffer(code, np.uint8).astype(np.int64)
                    for at in range(0, len(ids), PIECE):
                        piece = ids[at : at + PIECE]
                        near = windows(piece)
                        for lo in range(0, len(piece), BATCH):
                            mine.learn(near[lo : lo + BATCH], piece[lo : lo + BATCH], rate)
                    seen += len(ids)
            if seen:
                yield pd.DataFrame({"at": np.arange(len(mine.flat), dtype=np.int32), "v": mine.flat.astype(np.float64) * seen, "seen": seen})

        drawn = codes.filter(F.pmod("at", F.lit(one_in)) == number % one_in).select("classes")
        sums = drawn.mapInPandas(local, "at int, v double, seen long").groupBy("at").agg(F.sum("v").alias("v"), F.sum("seen").alias("seen"))
        rows = fetched(sums).sort_values("at")
        if len(rows):
            net = Network((rows["v"] / rows["seen"]).to_numpy())
        shared.destroy()
    return net


_RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType())])


def scored(codes: DataFrame, net: Network, into: str = "lm") -> DataFrame:
    """Rows with classes and share, as ``encoded`` gives them, with a struct ``lm`` (or ``into``): n_tokens,
    and log_prob (natural logarithm, summed over the tokens)."""
    shared = codes.sparkSession.sparkContext.broadcast(net.flat)

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = Network(shared.value)
        for codes, shares in batches:
            ids = [np.frombuffer(c, np.uint8).astype(np.int64) for c in codes]
            sums = np.zeros(len(ids))
            group: list[int] = []
            size = 0
            for i, x in enumerate([*ids, None]):  # short texts share a product
                if x is None or size + len(x) > PIECE:
                    if group:
                        near, token = np.concatenate([windows(ids[j]) for j in group]), np.concatenate([ids[j] for j in group])
                        logp = np.concatenate([model.chosen(near[lo : lo + STEP], token[lo : lo + STEP]) for lo in range(0, len(token), STEP)])
                        parts = np.repeat(np.arange(len(group)), [len(ids[j]) for j in group])
                        sums[group] = np.bincount(parts, logp, len(group))
                    group, size = [], 0
                if x is not None and len(x):
                    group.append(i)
                    size += len(x)
            yield pd.DataFrame({"n_tokens": [len(x) for x in ids], "log_prob": sums + shares.to_numpy()})

    return codes.withColumn(into, F.pandas_udf(score, _RESULT)(F.col("classes"), F.col("share")))


def lm_score(docs: DataFrame, net: Network, own: Vocabulary, into: str = "lm") -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``lm`` (or ``into``), by a model given."""
    shared = docs.sparkSession.sparkContext.broadcast((net.flat, Lexicon(own)))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        flat, lexicon = shared.value
        model = Network(flat)
        for texts in batches:
            rows = []
            for text in texts:
                ids, share = lexicon.read(words_of(text))
                total = share
                for lo in range(0, len(ids), STEP):
                    around = ids[max(0, lo - SIDE) : lo + STEP + SIDE]
                    at = slice(lo - max(0, lo - SIDE), lo - max(0, lo - SIDE) + min(STEP, len(ids) - lo))
                    total += float(model.chosen(windows(around)[at], ids[lo : lo + STEP]).sum())
                rows.append((len(ids), total))
            yield pd.DataFrame(rows, columns=["n_tokens", "log_prob"])

    return docs.withColumn(into, F.pandas_udf(score, _RESULT)(F.col("text")))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, log_prob, and the mean per token (null without tokens)."""
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counts = word_counts(docs)
    known = vocabulary(docs, counts=counts)
    codes = encoded(docs, known)
    found = scored(codes.drop("rare"), train(codes)).select("row", "doc_id", "even", "lm.n_tokens", "lm.log_prob")
    if counts.count() > len(known.share):
        more = rare_shares(codes, counts)
        found = found.join(more, "row", "left").withColumn("log_prob", F.col("log_prob") - F.col("even") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "log_prob", mean.alias("mean_log_prob"))
