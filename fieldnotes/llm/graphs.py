"""Connected components of a graph given by its edges, by alternating large and small stars.

Every round replaces the edges of a node by edges to the least node it knows of; the number of
rounds is logarithmic in the number of nodes.  A round is two aggregates (with partial minima,
so a node with very many neighbours is no hot key) and two joins of narrow rows; its edges go to
a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnotes.llm import scratch

#: Edges a file of an edge table should have.
FILE_ROWS = 500_000


def _star(pairs: DataFrame) -> DataFrame:
    """(node, other) pairs -> the same with the least of the node and its others in ``m``."""
    least = pairs.groupBy("node").agg(F.min("other").alias("m")).select(F.col("node").alias("n"), F.least("node", "m").alias("m"))
    return pairs.join(least, pairs["node"] == least["n"]).select("node", "other", "m")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges, in either direction -> (node, component): every node that has an edge to
    another, with the least node it is connected to.  Loops and repeated edges do no harm."""
    start = edges.filter("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("m")).distinct()
    now = scratch.cut(start, "edges")
    rows, total = now.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
    while rows:
        both = now.select(F.col("v").alias("node"), F.col("m").alias("other")).unionAll(now.select(F.col("m").alias("node"), F.col("v").alias("other")))
        large = _star(both).filter("other > node AND other <> m").select(F.col("other").alias("node"), F.col("m").alias("other")).distinct()
        small = _star(large)
        nxt = small.filter("other <> m").select(F.col("other").alias("v"), "m").unionAll(small.select(F.col("node").alias("v"), "m")).filter("v <> m").distinct()
        # few edges go to few files, so that later rounds run few tasks
        now = scratch.cut(nxt.repartition(rows // FILE_ROWS + 1), "edges")
        was = (rows, total)
        rows, total = now.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if was == (rows, total):
            break
    labels = now.groupBy(F.col("v").alias("node")).agg(F.min("m").alias("component"))
    return labels.unionAll(now.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
