"""Conversation prefix trie by smallest-member ownership.

A node of the trie is a distinct sequence of first turns; its members are the conversations that begin with
it.  The member with the least id owns the node.  Deeper nodes have fewer members, so a conversation that
owns a node owns all that follow on its path: it owns a suffix of its path, which is known by where it begins.
Each node of a subtree is owned by just one member of the subtree's top, so sums over the nodes of a subtree
are sums over its members: the words of their turns from here on, less the words of turns they own, and one
for each member that owns a leaf.  One group-by over (node, member) gives them.

A turn is a digest of 128 bits and a word count; a prefix is the XOR of digests of (position, turn), so it is
a running sum that can be carried from one range of rows to the next.  Turns are dealt by ranges of
(conversation, turn): a conversation with most of all turns lies in many ranges, and their few totals are
broadcast.  What is joined to turns is joined by (range, conversation).  Groups of nodes are partial sums
before the shuffle, so the root and a common first turn are no hot keys.  The ids that end at a node are
joined to strings range by range, then hashed piece after piece, holding one piece.

Defined cases: rows without conv_id are in no conversation; null role or text is empty; null turns come
first; turns that tie are taken by role, then text; repeated rows are turns of their own; a conversation none
of whose turns remain is a member of the root alone; very long texts are read whole; other columns are
ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldnotes.llm import scratch
from fieldnotes.llm.common import read
from fieldnotes.operators.ordered import range_of, ranged

#: Conversations are rebuilt in groups of so many ids, by the first turns of the group's first.
GROUP = 20
#: They take up to this many turns less one from it.
HEADS = 4
#: Rows that were made from a conversation's head, not from a range of its own turns.
HEAD = -1
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "x", "y"]


def _heads(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string")), F.lit(HEADS))


def _donor(conv: Column) -> Column:
    return conv - conv % GROUP


def _turn_digest(depth: Column, digest: Column) -> tuple[Column, Column]:
    return F.xxhash64(depth, digest), F.xxhash64(F.lit("y"), digest, depth)


def _placed(turns: DataFrame) -> DataFrame:
    """(conv, range, n, x, y, words): a row a turn, with its number in its conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    given = turns.select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text")).filter(F.col("conv").isNotNull())
    digest = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))
    placed = ranged(given, ["conv", "turn", "role", "text"], [F.col("conv"), digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")], "place")
    return placed.withColumn("range", range_of(F.col("place")))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, length, words), and their prefixes (conv, range, depth, x, y, px, py, words, before,
    last): a row for each turn of a rebuilt conversation and for its empty start, with the digest of the
    prefix, that of its parent, the turn's words and those of the turns before it."""
    placed = _placed(turns)
    ranges = scratch.cut(placed.groupBy("range", "conv").agg(F.min("place").alias("begin"), F.count("*").alias("n")), "convs")
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    convs = ranges.groupBy("conv").agg(F.sum("n").alias("own")).withColumn("h", _heads(F.col("conv")))

    # the first turns of each group's first conversation, one row for it
    numbered = placed.join(ranges.filter(f"conv % {GROUP} = 0 AND skip < {HEADS - 1}"), ["range", "conv"])
    first = numbered.withColumn("n", F.col("place") - F.col("begin") + F.col("skip") + 1).filter(F.col("n") < HEADS)
    x, y = _turn_digest(F.col("n"), F.col("digest"))
    head = first.groupBy(F.col("conv").alias("donor")).agg(F.array_sort(F.collect_list(F.struct("n", x.alias("x"), y.alias("y"), "words"))).alias("head"))
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<n:long,x:long,y:long,words:long>>")), F.lit(1), F.col("h").cast("int"))
    start = convs.join(head, _donor(F.col("conv")) == F.col("donor"), "left").select("conv", "own", F.col("h").cast("long").alias("h"), taken.alias("head"))
    start = start.withColumn("k", F.size("head").cast("long"))
    zero = F.lit(0).cast("long")
    over = lambda name, merge: F.aggregate("head", zero, lambda a, t: merge(a, t[name]))
    xor = lambda a, b: a.bitwiseXOR(b)
    start = scratch.cut(
        start.select("conv", "h", "k", "head", (F.col("k") + F.greatest(F.col("own") - F.col("h"), zero)).alias("length"), over("x", xor).alias("hx"), over("y", xor).alias("hy"), over("words", lambda a, b: a + b).alias("hw")),
        "starts",
    )

    # a conversation's own turns after the head
    where = ranges.join(start.drop("head"), "conv").filter(F.col("skip") + F.col("n") > F.col("h")).drop("n")
    own = placed.join(where, ["range", "conv"]).withColumn("n", F.col("place") - F.col("begin") + F.col("skip") + 1).filter(F.col("n") > F.col("h"))
    own = own.withColumn("depth", F.col("n") - F.col("h") + F.col("k"))
    x, y = _turn_digest(F.col("depth"), F.col("digest"))
    within = Window.partitionBy("range", "conv").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = own.select("range", "conv", "place", "depth", "words", "length", "hx", "hy", "hw", x.alias("tx"), y.alias("ty"))
    own = scratch.cut(own.withColumns({"x": F.bit_xor("tx").over(within), "y": F.bit_xor("ty").over(within), "upto": F.sum("words").over(within)}), "own")
    totals = own.groupBy("range", "conv").agg(F.max_by(F.struct("x", "y", "upto"), "place").alias("t"))
    totals = totals.select("range", "conv", "t.*")
    carried = totals.select("range", "conv", F.bit_xor("x").over(earlier).alias("cx"), F.bit_xor("y").over(earlier).alias("cy"), F.sum("upto").over(earlier).alias("cw"))
    carried = F.broadcast(carried.filter("cw IS NOT NULL"))  # one for each range that begins within a conversation
    whole = own.join(carried, ["range", "conv"], "left").fillna(0, ["cx", "cy", "cw"])
    x, y = (F.col(c).bitwiseXOR(F.col(f"c{c}")).bitwiseXOR(F.col(f"h{c}")) for c in "xy")
    tail = whole.select("conv", "range", "depth", x.alias("x"), y.alias("y"), "tx", "ty", "words", (F.col("upto") + F.col("cw") + F.col("hw") - F.col("words")).alias("before"), (F.col("depth") == F.col("length")).alias("last"))

    # the empty start of each conversation, and what it takes from its group's first
    each = F.explode(F.sequence(zero, F.col("k")))
    steps = start.select("conv", "length", "head", each.alias("depth"))
    upto = lambda name, merge: F.aggregate(F.slice("head", F.lit(1), F.col("depth").cast("int")), zero, lambda a, t: merge(a, t[name]))
    this = lambda name: F.coalesce(F.get("head", (F.col("depth") - 1).cast("int"))[name], zero)
    heads = steps.select(
        "conv", F.lit(HEAD).cast("long").alias("range"), "depth", upto("x", xor).alias("x"), upto("y", xor).alias("y"), this("x").alias("tx"), this("y").alias("ty"),
        this("words").alias("words"), (upto("words", lambda a, b: a + b) - this("words")).alias("before"), (F.col("depth") == F.col("length")).alias("last"),
    )
    prefixes = tail.unionByName(heads)
    prefixes = prefixes.select("conv", "range", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("tx")).alias("px"), F.col("y").bitwiseXOR(F.col("ty")).alias("py"), "words", "before", "last")
    prefixes = scratch.cut(prefixes, "prefixes")
    lengths = start.select("conv", "length").join(prefixes.filter("last").select("conv", (F.col("before") + F.col("words")).alias("total")), "conv")
    return lengths, prefixes


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of nodes' strings, whose pieces come one after the other."""
    key, digest = None, None

    def row() -> pa.RecordBatch:
        depth, x, y = key
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (depth, x, y)] + [pa.array([digest.hexdigest()])], names=[*NODE, "ends_sha256"])

    for batch in batches:
        for *node, piece in zip(*[batch.column(c).to_pylist() for c in (*NODE, "piece")], strict=True):
            if node != key:
                if key:
                    yield row()
                key, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
    if key:
        yield row()


def _ends(prefixes: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of the nodes at which conversations end."""
    ends = ranged(prefixes.filter("last"), [*NODE, "conv"], [F.col(c) for c in (*NODE, "conv")], "place").withColumn("range", range_of(F.col("place")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = scratch.cut(ends.groupBy("range", *NODE).agg(listed.alias("piece")), "pieces")
    several = pieces.groupBy(*NODE).agg(F.count("*").alias("n"), F.max("piece").alias("piece"))
    one = several.filter("n = 1").select(*NODE, F.sha2("piece", 256).alias("ends_sha256"))
    split = F.broadcast(several.filter("n > 1").select(*NODE))  # fewer than there are ranges
    more = pieces.join(split, NODE).repartition(*NODE).sortWithinPartitions(*NODE, "range").select(*NODE, "piece")
    return one.unionByName(more.mapInArrow(_hash, "depth long, x long, y long, ends_sha256 string"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row a node of
    the trie of rebuilt conversations."""
    convs, prefixes = rebuilt(turns)
    first = F.min(F.struct("conv", "before")).alias("owner")
    owned = prefixes.groupBy(*NODE).agg(first, F.bool_and("last").alias("leaf"))
    owned = owned.groupBy(F.col("owner.conv").alias("conv")).agg(F.min(F.struct("depth", "owner.before")).alias("from"), F.bool_or("leaf").alias("leaf"))
    each = scratch.cut(
        convs.join(owned, "conv", "left").select(
            "conv",
            F.coalesce("from.depth", F.col("length") + 1).alias("own_from"),
            F.coalesce("from.before", "total").alias("shared"),
            F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf"),
        ),
        "owned",
    )
    # by range too, so that a conversation with very many turns is split
    where = prefixes.select("range", "conv").distinct().join(each, "conv")
    members = prefixes.join(where, ["range", "conv"])
    saved = F.when(F.col("depth") < F.col("own_from"), F.col("shared") - F.col("before")).otherwise(0)
    nodes = members.groupBy(*NODE).agg(
        F.min(F.struct("conv", "own_from")).alias("owner"), F.count("*").alias("n_convs"), F.first("px").alias("px"), F.first("py").alias("py"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens")
    )
    nodes = scratch.cut(nodes.select(*NODE, "owner.*", "n_convs", "px", "py", "n_leaves", "saved_tokens"), "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    # the parent of a node has another owner only where the owner's suffix begins; the root's owner is known
    root = nodes.filter("depth = 0").select(F.col("conv").alias("root"))
    begins = nodes.filter("depth > 1 AND depth = own_from").select(*NODE, (F.col("depth") - 1).alias("d"), "px", "py")
    owners = nodes.select(F.col("depth").alias("pd"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("conv").alias("parent"))
    parents = begins.join(owners, (F.col("d") == F.col("pd")) & (F.col("px") == F.col("ox")) & (F.col("py") == F.col("oy"))).select(*NODE, "parent")
    out = nodes.join(children, NODE, "left").join(parents, NODE, "left").join(_ends(prefixes), NODE, "left").join(F.broadcast(root), how="left")
    parent = F.when(F.col("depth") == 1, F.col("root")).when(F.col("depth") > 1, F.coalesce("parent", "conv"))
    return out.select(
        F.col("conv").alias("conv_id"),
        "depth",
        parent.alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op13_sql() -> str:
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))),
    lambda a, b: list_reduce(CAST([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))))"""
    return f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'k': md5(CAST(length(r) AS VARCHAR) || ':' || r || ':' || x), 'w': len(regexp_extract_all(x, '{WORD}'))}} ORDER BY turn NULLS FIRST, r, x) AS l FROM t GROUP BY c),
h AS (SELECT c, l, {crc} % {HEADS} AS h FROM o),
b AS (
  SELECT a.c, list_concat(coalesce(list_slice(d.l, 1, a.h), []), list_slice(a.l, a.h + 1, len(a.l))) AS s
  FROM h AS a LEFT JOIN o AS d ON d.c = a.c - a.c % {GROUP}),
p AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM b),
n AS (SELECT d, list_slice(s, 1, d) AS k, min(c) AS conv_id, count(*) AS n_convs, list(c ORDER BY c) FILTER (len(s) = d) AS ends FROM p GROUP BY ALL),
kids AS (SELECT list_slice(k, 1, d - 1) AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(kids.n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * n.k[d].w ELSE 0 END AS saved FROM n LEFT JOIN kids ON n.k = kids.k),
up AS (SELECT k, saved, n_children, unnest(range(0, d + 1)) AS e FROM f),
sums AS (SELECT list_slice(k, 1, e) AS k, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, parent.conv_id AS parent_conv_id, f.n_convs, f.n_children, sums.n_leaves, CAST(sums.saved_tokens AS BIGINT) AS saved_tokens,
  sha256(coalesce(array_to_string(f.ends, ','), '')) AS ends_sha256
FROM f JOIN sums ON f.k = sums.k LEFT JOIN n AS parent ON f.d > 0 AND parent.d = f.d - 1 AND parent.k = list_slice(f.k, 1, f.d - 1)"""
