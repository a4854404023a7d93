"""Exact top-k search over an impact-ordered index, score at a time.

A vector's components are floor(``SCALE`` * x), integers; a score is their inner product.  The
index of a block of vectors quantises the impact |component| into ``LEVELS`` levels.  A posting
segment holds the postings (dimension, vector, component) of one level, without those that are 0;
segments are processed by descending impact, so an accumulator first gets what weighs most.  A sparse
segment is added posting by posting; one that holds over ``DENSE`` of all places is a matrix over the
dimensions and vectors that it has, since a product is then cheaper than a walk along lists.

After each segment, what a vector's score can still change by has a proven bound: the norm of its
own components not yet processed (known when the index is built) times the query's norm, or the
query's absolute sum times the segment's highest impact left, whichever is less.  A vector whose
upper bound is below the k-th best lower bound can't be a member of the result.  Processing stops
once the vectors that still can be are at most ``RESCORE`` a query (or no segment is left); they
are scored exactly, from all their components.  So the result doesn't depend on where it stops.

Plan: rows are packed, as they are read, into blocks of at most ``BLOCK`` vectors, queries into
blocks of ``QUERY_BLOCK``; no shuffle of vectors one by one.  Blocks go to tables in the shared folder.
Blocks of vectors are dealt to groups of ``GROUP`` at most, and every block of queries is given to every
group by number, so that the join has as many even keys as there are groups, whether Spark broadcasts
the queries or not; each pair of blocks is one row for an Arrow batch, and yields at most k rows a query.
The k best of those are kept by a window with a limit before its shuffle.

Defined cases: vectors that are null or hold null or non-finite components, and rows with null
ids, take no part; vectors of another length than the query's aren't candidates for it; identical rows
count once; a query's own id is no candidate; ties go to the smaller id; an empty table has no result;
columns other than id and vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldnotes.llm import scratch
from fieldnotes.llm.common import read

SCALE = 256
K = 5
LEVELS = 8
BLOCK = 4096
QUERY_BLOCK = 512
RESCORE = 64
DENSE = 0.02
GROUP = 16
EVERY = 50


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): usable rows with integer components."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x"))


def _packer(size: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def block(dim: int) -> pd.DataFrame:
            ids, rows = held.pop(dim)
            return pd.DataFrame({"dim": [dim], "ids": [np.array(ids, np.int64).tobytes()], "xs": [np.array(rows, np.int64).reshape(len(ids), dim).tobytes()]})

        for batch in batches:
            for i, x in zip(batch["vec_id"], batch["x"], strict=True):
                ids, rows = held.setdefault(len(x), ([], []))
                ids.append(i)
                rows.append(x)
                if len(ids) >= size:
                    yield block(len(x))
        for dim in list(held):
            yield block(dim)

    return pack


class ImpactIndex:
    """A block of vectors with its posting segments by descending impact."""

    def __init__(self, ids: np.ndarray, xs: np.ndarray, levels: int = LEVELS):
        both = np.unique(np.column_stack([ids, xs]), axis=0)  # identical rows count once
        self.ids, self.x = both[:, 0], both[:, 1:]
        impact = np.abs(self.x)
        top = self.top = int(impact.max(initial=0))
        edges = np.unique(np.ceil(top * np.arange(levels) / levels).astype(np.int64))[::-1]
        self.exact = np.float64 if top > 2048 or self.x.shape[1] * top * top >= 2**24 else np.float32
        self.segments, high = [], top + 1
        for low in edges:
            posted = (impact >= max(low, 1)) & (impact < high)
            rest = np.where(impact < low, self.x, 0)
            left = np.sqrt((rest.astype(np.float64) ** 2).sum(axis=1))
            self.segments.append((self._postings(posted), left, int(np.abs(rest).max(initial=0))))
            high = low

    def _postings(self, posted: np.ndarray) -> tuple[np.ndarray, ...]:
        """A segment: its vectors, and a matrix (dimensions used, values) or lists (where each vector's
        postings begin, dimensions, values)."""
        vectors, dims = np.flatnonzero(posted.any(axis=1)), np.flatnonzero(posted.any(axis=0))
        if posted.sum() > DENSE * posted.size:
            part = np.where(posted[np.ix_(vectors, dims)], self.x[np.ix_(vectors, dims)], 0)
            return vectors, dims, part.T.astype(self.exact)
        row, dim = np.nonzero(posted)
        return vectors, np.searchsorted(row, vectors), dim, self.x[row, dim].astype(self.exact)

    @staticmethod
    def _add(scores: np.ndarray, q: np.ndarray, segment: tuple[np.ndarray, ...]) -> None:
        vectors, *lists = segment
        if not len(vectors):
            return
        if len(lists) == 2:
            dims, values = lists
            scores[:, vectors] += q[:, dims] @ values
        else:
            starts, dims, values = lists
            scores[:, vectors] += np.add.reduceat(q[:, dims] * values, starts, axis=1)

    def search(self, own: np.ndarray, q: np.ndarray, k: int = K, rescore: int = RESCORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best (query number, vec_id, score) of a block of queries, best first."""
        n = len(self.ids)
        # sums must be exact in their type; beyond that too, their error is part of the slack
        most = self.x.shape[1] * self.top * int(np.abs(q).max(initial=0))
        qx = q.astype(self.exact if most < 2**24 else np.float64)
        error = 0.0 if most < 2**53 else most * self.x.shape[1] * 2.0**-52
        norm, total = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)), np.abs(q).sum(axis=1).astype(np.float64)
        scores = np.zeros((len(q), n), qx.dtype)
        same = own[:, None] == self.ids[None, :]
        possible = ~same
        for posted, left, rest in self.segments:
            self._add(scores, qx, posted)
            slack = np.minimum(norm[:, None] * left[None, :], (total * rest)[:, None]) * (1 + 1e-9) + 1e-6 + error
            if n > k:
                low = np.where(possible, scores - slack, -np.inf)
                bar = np.partition(low, n - k, axis=1)[:, n - k]
                possible &= scores + slack >= bar[:, None]
            if not rest or possible.sum(axis=1).max(initial=0) <= rescore:
                break
        rows, cols = np.nonzero(possible)
        exact = np.einsum("ij,ij->i", q[rows], self.x[cols])
        order = np.lexsort((self.ids[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.searchsorted(rows, np.arange(len(q)))
        best = np.arange(len(rows)) - first[rows] < k
        return rows[best], self.ids[cols[best]], exact[best]


def _searcher(k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, index = None, None
        for batch in batches:
            for dim, ids, xs, qids, qs in zip(batch["dim"], batch["ids"], batch["xs"], batch["qids"], batch["qs"], strict=True):
                if (ids, len(xs)) != last:
                    index = ImpactIndex(np.frombuffer(ids, np.int64), np.frombuffer(xs, np.int64).reshape(-1, dim))
                    last = (ids, len(xs))
                own = np.frombuffer(qids, np.int64)
                rows, found, score = index.search(own, np.frombuffer(qs, np.int64).reshape(len(own), dim), k)
                yield pd.DataFrame({"query_id": own[rows], "vec_id": found, "score": score})

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row of ``queries``."""
    x, q = quantised(vectors, scale), quantised(queries, scale)
    # blocks of vectors are numbered as they are written, so that groups of them are even
    number = F.monotonically_increasing_id()
    blocks = scratch.cut(x.mapInPandas(_packer(BLOCK), "dim int, ids binary, xs binary").withColumn("number", number), "blocks")
    asked = scratch.cut(q.repartition(max(1, -(-q.count() // QUERY_BLOCK))).mapInPandas(_packer(QUERY_BLOCK), "dim int, ids binary, xs binary"), "queries")
    groups = max(1, -(-blocks.count() // GROUP), min(blocks.count(), vectors.sparkSession.sparkContext.defaultParallelism))
    dealt = blocks.withColumn("at", F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int")).drop("number")
    each = asked.select("dim", F.col("ids").alias("qids"), F.col("xs").alias("qs"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("at"))
    pairs = dealt.repartition(groups, "at", "dim").join(each, ["at", "dim"]).drop("at")
    found = pairs.mapInPandas(_searcher(k), "query_id long, vec_id long, score long").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


def op1_sql() -> str:
    return f"""
WITH v AS (
  SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
