"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to three bytes.  A symbol seen n times in a
context of N occurrences and d different symbols has probability n / (N + d); the rest,
d / (N + d), is the escape to the next shorter context, spread over the symbols not seen in the
longer one (exclusion).  Statistics are frozen after training, so the code length of every
(context, symbol) is a table entry, and the length of a text the sum of its entries: exact, and
additive over pieces of a long text.  The language that codes a text shortest is predicted.

Training takes ``SAMPLE`` documents a language at most, the first by a hash of id and text, and the ``LANGUAGES``
languages with the most rows.  Byte 4-grams are
counted by the executors; shorter contexts are their margins.  The trees of all languages lie in one
table with a row for each context, up to ``TABLE_BYTES`` for the most frequent contexts of three bytes.
The others are kept by what was seen in them: a symbol that was not costs as much as in the shorter
context, and a constant of the longer (its escape less what exclusion frees).  So both forms give the same
lengths, and the model grows with the sample's languages alone.

Symbols are the bytes of the lower-cased text, digits and ASCII punctuation taken as blanks; bytes
never seen in training are one symbol.

Defined cases: a text that is null or has no letter is `und` with score 0; ties between languages
go to the lesser name; rows whose lang is null aren't learned from; a repeated row (id and text) is
learned from once; without any row to learn from, every text is `und`; very long texts are coded whole, in
pieces; other columns stay, and where ``into`` names one, it is replaced; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldnotes.llm.common import fetched, free_name, held_out, read, small_batches, uniform

ORDER = 3
SAMPLE = 400
#: Languages that are learned at most, those with the most rows: the trees of all go to every task.
LANGUAGES = 256
TABLE_BYTES = 32_000_000
UNKNOWN = "und"
_PIECE = 1 << 20
_ASCII_LETTER = re.compile(r"[A-Za-z]")
#: Byte -> byte: digits, controls and ASCII punctuation become blanks.
_BLANK = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_START = b" " * ORDER


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text))


def symbols_of(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_BLANK)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Byte 4-grams by language, summed within each batch."""
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            for text in texts:
                x = np.frombuffer(_START + symbols_of(text), np.uint8).astype(np.int64)
                code, n = np.unique(((x[:-3] << 8 | x[1:-2]) << 8 | x[2:-1]) << 8 | x[3:], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": code, "n": n})


class Trees:
    """Frozen trees of several languages: a row of code lengths for each context, or what was seen in it."""

    def __init__(self, counts: pd.DataFrame, table_bytes: int | None = None):
        table_bytes = TABLE_BYTES if table_bytes is None else table_bytes
        self.langs = sorted(counts["lang"].unique())
        gram = counts["gram"].to_numpy(np.int64)
        seen = np.unique(np.concatenate([gram >> s & 255 for s in (0, 8, 16, 24)] + [np.array([32])]))
        m = self.m = len(seen) + 1  # the last symbol stands for all bytes never seen
        symbol = np.full(256, m - 1, np.int64)
        symbol[seen] = np.arange(len(seen))
        self.symbol = symbol
        self.digits = [symbol[gram >> s & 255] for s in (24, 16, 8, 0)]
        self.lang = counts["lang"].map({x: i for i, x in enumerate(self.langs)}).to_numpy(np.int64)
        self.n, ls = counts["n"].to_numpy(np.float64), len(self.langs)
        # probabilities of a context's symbols, from the order below up; index: the row of a context
        low, index = np.full((1, m, ls), 1.0 / m), np.zeros(1, np.int32)
        for order in range(ORDER):
            ids, ctx = self._contexts(order)
            rows = self._rows(order, ctx, ids, low, index)
            # contexts without a row of their own fall back
            wide = np.tile(index, m) if order else np.zeros(1, np.int32)
            wide[ids] = len(low) + np.arange(len(ids), dtype=np.int32)
            low, index = np.concatenate([low, rows]), wide
        ids, ctx = self._contexts(ORDER)
        order = np.argsort(-np.bincount(np.searchsorted(ids, ctx), self.n), kind="stable")
        room = max(0, table_bytes // (4 * m * ls) - len(low))
        dense, rest = np.sort(ids[order[:room]]), np.sort(ids[order[room:]])
        wide = np.tile(index, m)
        wide[dense] = len(low) + np.arange(len(dense), dtype=np.int32)
        self.cost = self._bits(np.concatenate([low, self._rows(ORDER, ctx, dense, low, index)])).reshape(-1, ls)
        self.index, self.sparse, self.rest = wide, np.zeros(m**ORDER, bool), rest
        self.sparse[rest] = True
        self.more, self.gram, self.gram_cost = np.zeros((len(rest), ls), np.float32), np.zeros(0, np.int64), np.zeros((0, ls), np.float32)
        step = max(1, table_bytes // (32 * m * ls))
        for lo in range(0, len(rest), step):
            self._keep(rest[lo : lo + step], lo, ctx, low, index)
        del self.digits, self.lang, self.n

    @staticmethod
    def _bits(p: np.ndarray) -> np.ndarray:
        return (-np.log2(p)).astype(np.float32)

    def _contexts(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all contexts of an order, sorted, and of each gram's."""
        ctx = np.zeros(len(self.n), np.int64)
        for d in self.digits[ORDER - order : ORDER]:
            ctx = ctx * self.m + d
        return np.unique(ctx), ctx

    def _counted(self, ctx: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """How often each symbol follows some contexts, by language."""
        place = np.minimum(np.searchsorted(ids, ctx), max(0, len(ids) - 1))
        use = ids[place] == ctx if len(ids) else np.zeros(len(ctx), bool)
        count = np.zeros((len(ids), self.m, len(self.langs)), np.float32)
        np.add.at(count, (place[use], self.digits[ORDER][use], self.lang[use]), self.n[use])
        return count

    def _rows(self, order: int, ctx: np.ndarray, ids: np.ndarray, low: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Probabilities of all symbols in some contexts."""
        count = self._counted(ctx, ids)
        shorter = low[index[ids % self.m ** max(order - 1, 0)]] if order else np.repeat(low[:1], len(ids), axis=0)
        total, kinds, spare = self._sums(count, shorter)
        unseen = np.where(count == 0, shorter, 0.0)
        escape = np.where(spare > 0, kinds / np.maximum(total + kinds, 1), 0.0)
        seen = count / np.maximum(total + np.where(spare > 0, kinds, 0), 1)
        return np.where(total > 0, seen + escape * unseen / np.maximum(spare, 1e-300), shorter)

    @staticmethod
    def _sums(count: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By context and language: occurrences, kinds of symbols, what the others have in the shorter one."""
        spare = np.where(count == 0, shorter, 0.0).sum(axis=1, keepdims=True)
        return count.sum(axis=1, keepdims=True), (count > 0).sum(axis=1, keepdims=True), spare

    def _keep(self, ids: np.ndarray, lo: int, ctx: np.ndarray, low: np.ndarray, index: np.ndarray) -> None:
        """Contexts of the highest order by their symbols seen, and the constant of the others."""
        count = self._counted(ctx, ids)
        total, kinds, spare = self._sums(count, low[index[ids % self.m ** (ORDER - 1)]])
        escape = np.where((total > 0) & (spare > 0), kinds / np.maximum(total + kinds, 1) / np.maximum(spare, 1e-300), 1.0)
        self.more[lo : lo + len(ids)] = self._bits(escape)[:, 0, :]
        at, s = np.nonzero(count.any(axis=2))
        self.gram = np.concatenate([self.gram, ids[at] * self.m + s])
        self.gram_cost = np.concatenate([self.gram_cost, self._bits(self._rows(ORDER, ctx, ids, low, index)[at, s])])

    def lengths(self, pieces: list[bytes]) -> np.ndarray:
        """Code length in bits, a row for each text and a column for each language."""
        out = np.zeros((len(pieces), len(self.langs)))
        group: list[int] = []
        size = 0
        for i, p in enumerate(pieces):
            if len(p) > _PIECE:
                for at in range(0, len(p), _PIECE):
                    out[i] += self._sum([p[max(0, at - ORDER) : at + _PIECE]], ORDER if at else 0)[0]
                continue
            group.append(i)
            size += len(p)
            if size > _PIECE:
                out[group] = self._sum([pieces[j] for j in group], 0)
                group, size = [], 0
        if group:
            out[group] = self._sum([pieces[j] for j in group], 0)
        return out

    def _sum(self, pieces: list[bytes], given: int) -> np.ndarray:
        """The same for a few pieces; ``given`` bytes at the front of each are context only."""
        start = _START[given:]
        x = self.symbol[np.frombuffer(b"".join(start + p for p in pieces), np.uint8)]
        m = self.m
        ctx = (x[:-3] * m + x[1:-2]) * m + x[2:-1]
        bits = self.cost[self.index[ctx].astype(np.int64) * m + x[3:]]
        if len(self.rest):
            at = np.flatnonzero(self.sparse[ctx])
            key = ctx[at] * m + x[3:][at]
            spot = np.minimum(np.searchsorted(self.gram, key), len(self.gram) - 1)
            seen = self.gram[spot] == key
            other = bits[at] + self.more[np.searchsorted(self.rest, ctx[at])]
            other[seen] = self.gram_cost[spot[seen]]
            bits[at] = other
        ends = np.cumsum([len(start) + len(p) for p in pieces])
        sums = np.zeros((len(pieces), len(self.langs)))
        lo = 0
        for i, hi in enumerate(ends - ORDER):
            sums[i] = bits[lo:hi].sum(axis=0, dtype=np.float64)
            lo = hi + ORDER
        return sums


def train(docs: DataFrame, sample: int = SAMPLE, table_bytes: int | None = None) -> Trees | None:
    """Trees from the rows of ``docs`` that may be learned from; None if there are none."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    row = F.xxhash64("doc_id", "text")
    # distinct rows are drawn, so that rows that share an id or a text don't stand or fall together
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct(row, 0.02).alias("size")).orderBy(F.desc("rows"), "lang").limit(LANGUAGES)
    # twice as many as asked for, so that only those are sorted; a language of fewer gives all
    drawn = rows.withColumn("draw", uniform(F.lit("langid"), row)).join(F.broadcast(sizes), "lang").filter(F.col("draw") * F.col("size") < 2 * sample)
    first = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    once = drawn.select("lang", "draw", "doc_id", "text").dropDuplicates(["lang", "draw", "doc_id", "text"])
    chosen = once.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= sample).select("lang", "text")
    grams = chosen.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = fetched(grams)
    return Trees(counts, table_bytes) if len(counts) else None


_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame, trees: Trees | None, into: str = "language") -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``language`` (or ``into``): lang_pred, score.

    The score is the posterior probability of the predicted language under equal priors.
    """
    if trees is None:
        return docs.withColumn(into, F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")))
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        names = np.array(model.langs, object)
        for texts in batches:
            known = np.array([has_letter(t) for t in texts], bool)
            bits = model.lengths([symbols_of(t) for t, k in zip(texts, known, strict=True) if k])
            lang, score = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
            if len(bits):
                best = bits.argmin(axis=1)
                lang[known] = names[best]
                score[known] = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return docs.withColumn(into, F.pandas_udf(predict, _RESULT)(F.col("text")))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is in some language: `und` goes, everything else stays."""
    small_batches(docs.sparkSession)
    trees = train(docs)
    if trees is None:  # no model to reject a text that has a letter

        def lettered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([has_letter(t) for t in texts], dtype=bool)

        return docs.filter(F.pandas_udf(lettered, "boolean")(F.col("text")))
    found = free_name(docs, "language")
    return identify(docs, trees, found).filter(F.col(f"{found}.lang_pred") != UNKNOWN).drop(found)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")
