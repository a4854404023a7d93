"""Exact nearest neighbours over embeddings, and what is built on them.

Queries are a stated set.  Vectors and queries are packed into blocks as they are read, with unit length;
blocks of vectors are dealt to groups, and every block of queries is given to every group by number, so
that the join has as many even keys as groups, whichever side Spark broadcasts.  A pair of blocks is one
matrix product and gives at most k rows a query; the k best of those are a window with a limit before
its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldnotes import scratch

BLOCK = 4096
QUERY_BLOCK = 512
GROUP = 16
_BLOCKS = "dim int, ids binary, labels binary, xs binary"


def _pack(size: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, int, np.ndarray]]] = {}

        def block(dim: int) -> pd.DataFrame:
            ids, labels, xs = zip(*held.pop(dim), strict=True)
            return pd.DataFrame({"dim": [dim], "ids": [np.array(ids, np.int64).tobytes()], "labels": [np.array(labels, np.int64).tobytes()], "xs": [np.array(xs).tobytes()]})

        for batch in batches:
            for i, label, x in zip(batch["vec_id"], batch["label"], batch["embedding"], strict=True):
                x = np.asarray(x, np.float64)
                norm = np.sqrt(x @ x)
                if norm > 0 and np.isfinite(norm):
                    rows = held.setdefault(len(x), [])
                    rows.append((i, label, x / norm))
                    if len(rows) >= size:
                        yield block(len(x))
        for dim in list(held):
            yield block(dim)

    return pack


def _nearest(k: int):
    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids, labels, own = (np.frombuffer(b, np.int64) for b in (r.ids, r.labels, r.qids))
                score = np.frombuffer(r.qs).reshape(-1, r.dim) @ np.frombuffer(r.xs).reshape(-1, r.dim).T
                score[own[:, None] == ids[None, :]] = -np.inf
                # ties at six digits go to the smaller id, so all that reach the k-th best stay
                shown = np.round(score, 6)
                bar = np.partition(shown, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)] - 1e-6
                q, v = np.nonzero((shown >= bar[:, None]) & np.isfinite(shown))
                yield pd.DataFrame({"query_id": own[q], "vec_id": ids[v], "label": labels[v], "score": score[q, v]})

    return nearest


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score, label): the k nearest others of each query by cosine, rounded so that
    engines agree.  Vectors that are null, zero, not finite or of another length than the query's are no
    one's neighbours."""
    usable = F.col("vec_id").isNotNull() & F.forall("embedding", lambda v: v.isNotNull())
    rows = lambda df: df.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(F.col("label").cast("long"), F.lit(-(1 << 62))).alias("label"), "embedding")
    blocks = scratch.cut(rows(vectors).mapInPandas(_pack(BLOCK), _BLOCKS).withColumn("number", F.monotonically_increasing_id()), "blocks")
    n, asked = blocks.count(), rows(queries)
    asked = scratch.cut(asked.repartition(max(1, -(-asked.count() // QUERY_BLOCK))).mapInPandas(_pack(QUERY_BLOCK), _BLOCKS), "queries")
    groups = max(1, -(-n // GROUP), min(n, vectors.sparkSession.sparkContext.defaultParallelism))
    dealt = blocks.withColumn("at", F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int")).drop("number").repartition(groups, "at", "dim")
    each = asked.select("dim", F.col("ids").alias("qids"), F.col("xs").alias("qs"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("at"))
    found = dealt.join(each, ["at", "dim"]).drop("at").mapInPandas(_nearest(k), "query_id long, vec_id long, label long, score double")
    found = found.withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    label = F.when(F.col("label") != -(1 << 62), F.col("label")).cast(dict(vectors.dtypes)["label"])
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "score", label.alias("label"))


def best_per(rows: DataFrame, key: str) -> DataFrame:
    """Of each query's neighbours the nearest of a key."""
    w = Window.partitionBy("query_id", key).orderBy("rank")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def listed(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Each query with its neighbours as a list; an empty one, not null, without any."""
    found = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda r: r["vec_id"].cast("string")), ",").alias("found"))
    return queries.select(F.col("vec_id").alias("query_id")).join(found, "query_id", "left").fillna("", ["found"])


def upsert(collection: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The collection after its changes: the latest version of each key."""
    both = collection.unionByName(changes)
    keep = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*keep), version).alias("r")).select(key, *[F.col(f"r.{c}") for c in keep])


def by_recency(rows: DataFrame, as_of: Column, half_life_days: float, k: int) -> DataFrame:
    """Rows by score halved for each half-life of their age; the k best of a group."""
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("ts")) / 86400.0
    decayed = F.round(F.col("score") * F.pow(F.lit(0.5), age / half_life_days), 6)
    w = Window.partitionBy("group_id").orderBy(F.desc("decayed"), "id")
    return rows.withColumn("decayed", decayed).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("group_id", F.col("rank").cast("long").alias("rank"), "id", "decayed")
