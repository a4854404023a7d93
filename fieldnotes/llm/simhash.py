"""SimHash near-duplicates, with candidates by pigeonring filtering.

A fingerprint has a bit for each bit that is set in over half of the XXH64 hashes of a text's
3-word shingles.  Texts whose fingerprints differ in at most ``BITS`` = 2 of 64 bits are linked;
a component is what links reach.

Pigeonring: cut the 64 bits into m = 3 segments on a ring.  If two fingerprints differ in at most
2 bits, there is a segment from which every chain of consecutive segments stays within its
proportional budget: i segments differ in at most 2 i / 3 bits, that is 0, 1 and 2 bits for
chains of one, two and three.  So the first segment of the chain is equal, and of the two halves
of the second (at most one bit differs there) one is equal too: segment and half together are the
32-bit key by which candidates meet, six keys a fingerprint.  Chains over budget are pruned before
the full Hamming check.

Exact copies never pair: fingerprints are made distinct first.  A key that more than
``BUCKET`` distinct fingerprints share isn't paired either: its fingerprints are linked through
the 65 patterns at most one bit away from each, since two fingerprints differ in at most 2 bits
exactly if they share such a pattern.  That costs 65 rows a fingerprint however large the bucket.

Plan: texts are read once, in Arrow batches; only (id, fingerprint) is shuffled and kept, in a
table in the shared folder.

Defined cases: null, empty and blank texts have fingerprint 0 and are linked like any other;
repeated rows each get a row; a text of one or two words has one shingle, its words; very long texts are
taken whole, a slice of shingles at a time; rows without an id give none to a component; columns other
than id and text are ignored by the join and kept by ``keep_one``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldnotes.llm import graphs, scratch, similar
from fieldnotes.llm.common import free_name, read, small_batches

BITS = 2
WORDS = 3
SEED = 42
BUCKET = 64
#: (shift, width) of the segments of the ring.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_CHUNK = 1 << 16


def fingerprint_of(text: str | None) -> int:
    """The 64-bit fingerprint of a text, as a signed integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < WORDS:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
        n = len(words) - WORDS + 1
    digest, seeds = xxhash.xxh64_intdigest, SEED
    count = np.zeros(64, np.int64)
    for start in range(0, n, _CHUNK):
        h = np.fromiter((digest(s, seeds) for s, _ in zip(shingles, range(min(_CHUNK, n - start)), strict=False)), np.uint64, min(_CHUNK, n - start))
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(count * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint_of(t) for t in texts], dtype="int64")


def _bits(x: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(x, shift).bitwiseAND((1 << width) - 1)


def _keys(fp: Column) -> Column:
    """The six (start of the chain, half of the next segment) keys, tagged with their number."""
    keys = []
    for i, (shift, width) in enumerate(SEGMENTS):
        at, wide = SEGMENTS[(i + 1) % len(SEGMENTS)]
        for half, (lo, n) in enumerate(((at, wide // 2), (at + wide // 2, wide - wide // 2))):
            tag = F.lit((2 * i + half) << 40).cast("long")
            keys.append(tag.bitwiseOR(F.shiftleft(_bits(fp, shift, width), 12)).bitwiseOR(_bits(fp, lo, n)))
    return F.array(*keys)


def _within_budgets(a: Column, b: Column) -> Column:
    """The chain from some segment of the ring stays within 0, 1 and 2 bits."""
    x = a.bitwiseXOR(b)
    differ = [F.bit_count(_bits(x, *s)) for s in SEGMENTS]
    chains = [(differ[i] == 0) & (differ[(i + 1) % 3] <= 1) for i in range(3)]
    return (chains[0] | chains[1] | chains[2]) & (F.bit_count(x) <= BITS)


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(fp) distinct fingerprints -> edges (u, v) whose components are those of all links."""
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = scratch.cut(keyed.join(sizes, "key"), "keys")
    few = shared.filter(F.col("n") <= bucket).select("key", "fp")
    a, b = few.select("key", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    near = a.join(b, (a["key"] == b["key"]) & (F.col("u") < F.col("v")) & _within_budgets(F.col("u"), F.col("v"))).select("u", "v")
    ones = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    many = shared.filter(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(F.transform(ones, lambda one: F.col("fp").bitwiseXOR(one))).alias("pattern"))
    centre = many.groupBy("pattern").agg(F.min("fp").alias("u"), F.count("*").alias("n")).filter("n > 1")
    star = many.join(centre, "pattern").filter("fp <> u").select("u", F.col("fp").alias("v"))
    return near.unionAll(star).distinct()


def near_duplicates(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp) -> (fp, component_id): the least doc_id that links reach from fp."""
    groups = scratch.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    parts = graphs.components(links(groups.select("fp"), bucket))
    linked = groups.join(parts, groups["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    firsts = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    return linked.join(firsts, "component").select("fp", "component_id")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of all documents, as a table in the shared folder."""
    return scratch.cut(docs.select("doc_id", fingerprint("text").alias("fp")), "documents")


def keep_one(docs: DataFrame, words: int = similar.WORDS, similarity: tuple[int, int] = similar.SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of their class of near-duplicates (see ``similar``):
    ``WORDS`` and ``BITS`` bind fingerprints alone, which miss most pairs of that similarity.

    Rows without an id come last in their class, and ties of an id go to the lesser hash of the text;
    repeated rows (of one id and text) are one document, and stay or go together.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    made = similar.prints(texts, words, similarity)
    drop = similar.classes(texts, made, words, similarity).filter("NOT first").select(F.col("doc_id").alias("drop_id"), F.col("spot").alias("drop_spot")).distinct()
    drop = similar.bounded(scratch.cut(drop, "drop"))
    gone_id, gone_spot = free_name(docs, "drop_id"), free_name(docs, "drop_spot")
    drop = drop.toDF(gone_id, gone_spot)
    return docs.join(drop, docs["doc_id"].eqNullSafe(drop[gone_id]) & (similar.spot_of(docs) == drop[gone_spot]), "left_anti")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = fingerprints(docs)
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(near_duplicates(prints), "fp").select("doc_id", hex16.alias("fingerprint"), "component_id")
