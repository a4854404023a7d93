"""Benchmark decontamination by winnowing.

Of the hashes of all k-grams of words, the smallest in each window of ``width`` consecutive
k-grams is a fingerprint.  Two texts that share ``k + width - 1`` consecutive words share a
whole window and with it a fingerprint: with k = 5 and width = 6 no shared span of 10 words is
missed.  A document's fingerprints are joined to those of the benchmark; each hit is extended
to the spans of 10 words around it, which are compared word by word with the benchmark's.  An
item of fewer than 10 words has no full window, so it is compared as a whole by a hash of its
own length.

Plan: a benchmark of at most ``SLICE_BYTES`` of text is broadcast, each Python worker builds its index
once, and the documents stream past in Arrow batches (an iterator of pandas Series, so the JVM keeps the
other columns): no shuffle.  A larger one is joined: the documents give their fingerprints (only those
that pass a bitmap of the benchmark's, whose size is fixed), a join with the benchmark's tells which
occur, texts with such are read again and extended to the windows around each, and a join of these windows,
as text, with the benchmark's gives the hits.  Texts aren't shuffled, are read three times whatever the
size of the benchmark, and what is found comes back by 128 bits of hash of the text.

Defined cases: null texts have no words; items without words never occur; items with equal
text count each; what an item without an id shares with a document is hit, but the item isn't listed;
repeated documents each get their own row; very long texts are taken whole; an empty benchmark hits
nothing; other columns stay, and where ``into`` names one, it is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldnotes.llm import scratch
from fieldnotes.llm.common import bounded, fetched, free_name, read, small_batches

SPAN = 10
K = 5
SLICE_BYTES = 8_000_000
#: Bits, as a power of two, of the bitmap that prunes fingerprints before their join.
BITMAP = 26

#: Bytes that make up words after lower-casing: 0-9, a-z and all bytes of non-ASCII characters.
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)
_HITS = "array<struct<lo:int,hi:int>>"
_FOUND = f"n_words long, hits {_HITS}, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_TABLE).split() if text else []


def _roll(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive ids."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    x = ids.astype(np.uint64) * _MULT
    x ^= x >> np.uint64(29)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0xBF58476D1CE4E5B9) + x[i : i + len(out)]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def winnow(ids: np.ndarray, k: int = K, width: int = SPAN - K + 1) -> np.ndarray:
    """Positions of the fingerprints: of each ``width`` consecutive k-grams, the rightmost least."""
    h = _roll(ids, k)
    if len(h) < width:
        return np.zeros(0, np.int64)
    at = np.arange(len(h) - width + 1)
    best, least = at.copy(), h[: len(at)].copy()
    for i in range(1, width):
        nxt = h[i : i + len(at)]
        less = nxt <= least
        best[less] = at[less] + i
        least[less] = nxt[less]
    return np.unique(best)


class Index:
    """The benchmark's fingerprints and windows, by ids of its own words (0: any other word)."""

    def __init__(self, items: list[tuple[str | None, str]]):
        self.vocab: dict[bytes, int] = {}
        self.names: list[str | None] = []
        windows: dict[int, dict[bytes, tuple[np.ndarray, set[int]]]] = {}
        prints: list[np.ndarray] = []
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int64)
            n, item = min(SPAN, len(ids)), len(self.names)
            self.names.append(name)
            if n == SPAN:
                prints.append(_roll(ids, K)[winnow(ids)])
            of = windows.setdefault(n, {})
            for i in range(len(ids) - n + 1):
                of.setdefault((w := ids[i : i + n]).tobytes(), (w, set()))[1].add(item)
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.by_length = {}
        for n, of in windows.items():
            hashes = np.array([_roll(w, n)[0] for w, _ in of.values()], np.uint64)
            self.by_length[n] = (np.sort(hashes), {key: sorted(found) for key, (_, found) in of.items()})

    @staticmethod
    def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
        at = np.searchsorted(ordered, values)
        at[at == len(ordered)] = 0
        return ordered[at] == values

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [lo, hi) of hit words, and the items that occur."""
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        spans, items = [], set()
        for n, (hashes, known) in self.by_length.items():
            if len(ids) < n:
                continue
            if n == SPAN:
                at = winnow(ids)
                at = at[self._among(_roll(ids, K)[at], self.prints)] if len(at) else at
                if not len(at):
                    continue
                starts = np.unique((at[:, None] + np.arange(K - SPAN, 1)).ravel())
                starts = starts[(starts >= 0) & (starts <= len(ids) - n)]
                starts = starts[self._among(_roll(ids, n)[starts], hashes)]
            else:
                starts = np.flatnonzero(self._among(_roll(ids, n), hashes))
            for i in starts.tolist():
                found = known.get(ids[i : i + n].tobytes())
                if found:
                    spans.append((i, i + n))
                    items.update(found)
        return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same words."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


_indexes: dict[int, Index] = {}


def _finder(key: int, shared):
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = _indexes.get(key)
        if index is None:
            _indexes.clear()
            index = _indexes[key] = Index(shared.value)
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                spans, items = index.find(words)
                names = sorted(x for x in {index.names[i] for i in items} if x is not None)
                rows.append((len(words), [{"lo": lo, "hi": hi} for lo, hi in spans], names))
            yield pd.DataFrame(rows, columns=["n_words", "hits", "items"])

    return F.pandas_udf(find, _FOUND)


class _Words(dict):
    """Words by a 64-bit hash of each."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _prints(ids: np.ndarray, lengths: list[int], item: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length of the window, positions, hashes): fingerprints for windows of SPAN words, and all runs of
    words as long as a shorter item."""
    for n in [min(SPAN, len(ids))] if item else lengths:
        if n == SPAN:
            at = winnow(ids)
            yield n, at, _roll(ids, K)[at] if len(at) else np.zeros(0, np.uint64)
        elif 0 < n <= len(ids):
            yield n, np.arange(len(ids) - n + 1), _roll(ids, n)


def _spot(n: int, h: np.ndarray, power: int) -> np.ndarray:
    """The bit of a fingerprint in a bitmap of 2 ** power."""
    with np.errstate(over="ignore"):
        return ((h + np.uint64(n) * _MULT) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - power)).astype(np.int64)


def _item_prints(power: int):
    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for batch in batches:
            for text in batch["text"]:
                for n, _, h in _prints(words.ids(words_of(text)), [], True):
                    yield pd.DataFrame({"n": np.full(len(h), n, np.int32), "h": h.view(np.int64), "bit": _spot(n, h, power)})

    return prints


def _item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name, text in zip(batch["item_id"], batch["text"], strict=True):
            words = words_of(text)
            n = min(SPAN, len(words))
            if n:
                found = {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
                yield pd.DataFrame({"item_id": name, "n": n, "w": list(found)})


def _joined(docs: DataFrame, items: DataFrame, into: str, power: int) -> DataFrame:
    """The same for a benchmark that isn't broadcast."""
    sc = docs.sparkSession.sparkContext
    known = scratch.cut(items.select("text").mapInPandas(_item_prints(power), "n int, h long, bit long").distinct(), "prints")
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())
    bits = fetched(known.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("v")))
    bitmap = np.zeros(1 << power - 6, np.int64)
    bitmap[bits["at"].to_numpy(np.int64)] = bits["v"].to_numpy(np.int64)
    shared = sc.broadcast(bitmap)

    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, words = shared.value, _Words()
        for texts in batches:
            rows = []
            for text in texts:
                row = []
                for n, at, h in _prints(words.ids(words_of(text)), lengths, False):
                    bit = _spot(n, h, power)
                    kept = np.flatnonzero(table[bit >> 6] >> (bit & 63) & 1)
                    row += [{"n": n, "at": int(i), "h": int(x)} for i, x in zip(at[kept], h[kept].view(np.int64), strict=True)]
                rows.append(row)
            yield pd.Series(rows)

    def windows(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spots in batches:
            rows = []
            for text, found in zip(texts, spots, strict=True):
                words, starts = words_of(text), set()
                for s in found:
                    starts |= {(lo, SPAN) for lo in range(s["at"] + K - SPAN, s["at"] + 1)} if s["n"] == SPAN else {(s["at"], s["n"])}
                rows.append([{"lo": lo, "n": n, "w": b" ".join(words[lo : lo + n])} for lo, n in sorted(starts) if 0 <= lo <= len(words) - n])
            yield pd.Series(rows)

    def merged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for spans in batches:
            yield pd.Series([[{"lo": lo, "hi": hi} for lo, hi in merge([(s["lo"], s["hi"]) for s in x])] for x in spans])

    own = [F.xxhash64("text").alias("r1"), F.xxhash64(F.lit("#"), F.col("text")).alias("r2")]
    texts = docs.select("text", *own)
    seen = texts.select("r1", "r2", F.explode(F.pandas_udf(prints, "array<struct<n:int,at:int,h:bigint>>")(F.col("text"))).alias("p")).select("r1", "r2", "p.*").distinct()
    spots = seen.join(known.select("n", "h"), ["n", "h"]).groupBy("r1", "r2").agg(F.collect_set(F.struct("n", "at")).alias("spots"))
    spots = bounded(scratch.cut(spots, "spots"))
    around = texts.join(spots, ["r1", "r2"])
    around = around.select("r1", "r2", F.explode(F.pandas_udf(windows, "array<struct<lo:int,n:int,w:binary>>")(F.col("text"), F.col("spots"))).alias("w")).select("r1", "r2", "w.*").distinct()
    of = items.mapInPandas(_item_windows, "item_id string, n int, w binary").distinct()
    hits = around.join(of, ["n", "w"]).groupBy("r1", "r2").agg(F.collect_set(F.struct("lo", (F.col("lo") + F.col("n")).alias("hi"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    hits = scratch.cut(hits.select("r1", "r2", F.pandas_udf(merged, _HITS)(F.col("spans")).alias("hits"), "items"), "hits")
    row, one, two, spans, names = (free_name(docs, n) for n in ("leak_row", "leak_r1", "leak_r2", "leak_hits", "leak_items"))
    hits = bounded(hits.toDF(one, two, spans, names))
    marked = docs.withColumn(row, F.struct(*own))
    joined = marked.join(hits, (F.col(row)["r1"] == F.col(one)) & (F.col(row)["r2"] == F.col(two)), "left")
    n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    found = F.struct(n_words.alias("n_words"), F.coalesce(spans, F.array().cast(_HITS)).alias("hits"), F.coalesce(names, none).alias("items"))
    return joined.withColumn(into, found).drop(*({row, one, two, spans, names} - {into}))


def contamination(docs: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES, into: str = "leak") -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``leak`` (or ``into``).

    It has n_words, hits (spans of word numbers, end exclusive), items (the item_ids whose
    windows occur, sorted as strings) and n_hit.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > slice_bytes:
        out = _joined(docs, items, into, BITMAP)
    else:
        shared = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.collect()])
        out = docs.withColumn(into, _finder(shared._jbroadcast.id(), shared)(F.col("text")))
    n_hit = F.aggregate(f"{into}.hits", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return out.withColumn(into, F.struct(f"{into}.n_words", f"{into}.hits", f"{into}.items", n_hit.alias("n_hit")))


def items_digest(items: Column) -> Column:
    """SHA-256 of the item_ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "leak.n_words",
        "leak.n_hit",
        F.size("leak.items").cast("long").alias("n_items"),
        items_digest(F.col("leak.items")).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


def words_sql(text: str) -> str:
    lowered = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"COALESCE(regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), CAST([] AS VARCHAR[]))"


def leaks_sql(docs: str = "documents") -> str:
    """The common tables up to ``leaks`` (doc_id, n_words, n_hit, n_items, items)."""
    return f"""
d AS (SELECT doc_id, {words_sql("text")} AS w FROM {docs}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words_sql("text")} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), {SPAN}) AS n, array_to_string(list_slice(w, i, i + least(len(w), {SPAN}) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {SPAN}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS o FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit WHERE item IS NOT NULL GROUP BY doc_id),
leaks AS (
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(COALESCE(p.n_hit, 0) AS BIGINT) AS n_hit,
    CAST(COALESCE(len(t.items), 0) AS BIGINT) AS n_items, COALESCE(t.items, CAST([] AS VARCHAR[])) AS items
  FROM d LEFT JOIN pos p ON d.doc_id = p.doc_id LEFT JOIN its t ON d.doc_id = t.doc_id)"""


def op4_sql() -> str:
    return f"""WITH {leaks_sql()}
SELECT doc_id, n_words, n_hit, n_items, sha256(array_to_string(items, ',')) AS items_sha256, n_hit > 0 AS contaminated FROM leaks"""
