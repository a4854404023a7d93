"""Language of a text by ranked trigrams: a profile of each language, and the one whose ranks are nearest.

A profile is the ``RANKS`` most frequent trigrams of a language's texts, in lower case, what isn't a letter being
one blank.  A text has a profile of its own; its distance from a language is the sum over its trigrams of the
difference of ranks, ``RANKS`` where the language lacks one.  Profiles are small whatever they are learned from,
and are broadcast.  A row's trigrams are counted and ranked where its text is read, text by text, so that a task
holds the trigrams of one; only rows that share their key, which are one text and few, meet by key.  What a
profile is learned from is counted by a million trigrams at a time, and the counts are added up.  A text without any trigram of a letter has no
language; ties go to the lesser name and, among trigrams, to the lesser trigram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fieldnotes import scratch

RANKS = 300
#: Keys of several rows that may be broadcast.
BROADCAST_KEYS = 1_000_000
#: Trigrams that a task holds while it counts, beside those of a text.
HELD = 1 << 20
#: Bytes of text in an Arrow batch.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of a Python worker by the bytes in a batch, however long its texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def numbered(text: str) -> np.ndarray:
    """The trigrams of a plain text as numbers, three code points of 21 bits, which sort as the trigrams do."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def numbered_each(grams: list[str]) -> np.ndarray:
    return numbered("".join(grams))[::3] if grams else np.empty(0, np.int64)


def spelled(grams: np.ndarray) -> np.ndarray:
    points = np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF], axis=1)
    return points.astype("<u4").view("<U3").ravel()


def ranking(grams: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent trigrams of a text, ties by trigram."""
    each, n = np.unique(grams, return_counts=True)
    return each[np.argsort(-n, kind="stable")[:ranks]]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of trigrams of the texts in the last column by the other columns; a trigram may come several times."""
    for batch in batches:
        *keys, texts = batch.columns
        of: dict[tuple, int] = {}  # the first row of each key
        rows = [of.setdefault(k, i) for i, k in enumerate(zip(*(c.to_pylist() for c in keys), strict=True))]
        held: dict[int, list[np.ndarray]] = {}
        size = 0
        for i, text in enumerate(texts, 1):
            grams = numbered(text.as_py())
            held.setdefault(rows[i - 1], []).append(grams)
            size += len(grams)
            if size < HELD and i < len(texts):
                continue
            each, n = zip(*(np.unique(np.concatenate(parts), return_counts=True) for parts in held.values()), strict=True)
            at = pa.array(np.repeat(list(held), [len(e) for e in each]))
            made = [*(c.take(at) for c in keys), pa.array(spelled(np.concatenate(each))), pa.array(np.concatenate(n), pa.int64())]
            yield pa.RecordBatch.from_arrays(made, [*batch.schema.names[:-1], "gram", "n"])
            held, size = {}, 0


def plain(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def lettered(rows: DataFrame) -> DataFrame:
    """The rows whose text has a letter."""
    return rows.filter(F.regexp_like("text", F.lit(r"\p{L}")))


def trigrams(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, gram, n) of the trigrams of ``text``."""
    texts = lettered(rows).select(*keys, plain(F.col("text")).alias("_plain"))
    made = StructType([*texts.schema.fields[:-1], StructField("gram", StringType()), StructField("n", LongType())])
    return texts.mapInArrow(counted, made).groupBy(*keys, "gram").agg(F.sum("n").alias("n"))


def ranked(grams: DataFrame, key: str, ranks: int = RANKS) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("n"), "gram")
    return grams.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= ranks).drop("n")


def profiles(rows: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(lang, gram, rank) from rows with ``lang`` and ``text``."""
    return ranked(trigrams(rows.filter("lang IS NOT NULL"), "lang"), "lang", ranks)


def languages(rows: DataFrame, known: DataFrame, key: str, ranks: int = RANKS) -> DataFrame:
    """(key, language, distance) of each row with a text that has a trigram."""
    found = known.toArrow().to_pydict()  # a number of rows for each language
    names = sorted(set(found["lang"]))
    number = {lang: i for i, lang in enumerate(names)}
    grams = numbered_each(found["gram"])
    order = np.argsort(grams, kind="stable")
    place = np.array([(number[lang], rank) for lang, rank in zip(found["lang"], found["rank"], strict=True)], np.int64).reshape(-1, 2)
    shared = rows.sparkSession.sparkContext.broadcast((names, grams[order], place[order]))

    def nearest(own: np.ndarray) -> tuple[str | None, int]:
        """The language nearest to trigrams in order of their rank, and its distance."""
        langs, grams, place = shared.value
        if not langs:
            return None, ranks * len(own)
        first, end = np.searchsorted(grams, own), np.searchsorted(grams, own, "right")
        n = end - first  # languages that have the trigram
        at = np.repeat(end - n.cumsum(), n) + np.arange(n.sum())
        apart = np.abs(place[at, 1] - np.repeat(np.arange(1, len(own) + 1), n)) - ranks
        total = ranks * len(own) + np.bincount(place[at, 0], apart, len(langs)).astype(np.int64)
        best = int(total.argmin())
        return langs[best], int(total[best])

    def told(texts: DataFrame, own: Callable[[pa.Scalar], np.ndarray]) -> DataFrame:
        """The key in the first column of ``texts``, and the language nearest to what ``own`` makes of the last."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs, apart = zip(*(nearest(own(v)) for v in batch.column(1)), strict=True) if len(batch) else ((), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(apart, pa.int64())], [key, "language", "distance"])

        return texts.mapInArrow(each, StructType([texts.schema[0], StructField("language", StringType()), StructField("distance", LongType())]))

    texts = lettered(rows).select(key, "text")
    # texts of one key are one text; a null key is one too
    twice = scratch.cut(texts.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_key")), "twice")
    many = twice.count()
    few = F.broadcast(twice) if many <= BROADCAST_KEYS else twice
    same = texts[key].eqNullSafe(few["_key"])
    alone = texts.join(few, same, "left_anti") if many else texts
    out = told(alone.select(key, plain(F.col("text")).alias("plain")), lambda v: ranking(numbered(v.as_py()), ranks))
    if not many:
        return out
    own = ranked(trigrams(texts.join(few, same, "left_semi"), key), key, ranks).groupBy(key)
    grams = F.transform(F.array_sort(F.collect_list(F.struct("rank", "gram"))), lambda g: g["gram"])
    return out.unionAll(told(own.agg(grams.alias("grams")), lambda v: numbered_each(v.as_py())))
