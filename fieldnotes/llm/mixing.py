"""Mixing sources to target weights.

Each source gets a share of the corpus by weight, capped at a multiple of its own size; the
excess of capped sources is shared again by weight.  From target and size follows the rate at
which a source's documents are repeated: every document is emitted floor(rate) times, and once
more if a number seeded by its id falls below the fraction.

Plan: one aggregate over (source, word count) with partial sums, closed-form water-filling over
one row per source, kept in the shared folder, and a join of the documents to those rows: broadcast up to
``BROADCAST_SOURCES`` of them, so that texts aren't shuffled, and a sort-merge join, whose skewed
sources adaptive execution splits, beyond.

Defined cases: a null or empty text has size 0; null is a source of its own, ranked last; a
source of size 0 has target 0; repeated rows with one id share one draw; a null id draws as ''; very long
texts are counted whole, and copied no more than others; other columns stay, and where ``into`` names one,
it is replaced; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldnotes.llm import scratch
from fieldnotes.llm.common import free_name, others, read, uniform

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 17
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Target per source from (source, source_size): water-filling in closed form.

    Sources in order of cap / weight: the first whose fair share of what the capped ones before
    it leave doesn't exceed its cap, and all after it, are filled to one level.  Sums are of
    integers, so the result doesn't depend on their order.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(rank)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (
        ranked.withColumn("cap", F.col("source_size") * max_repeat)
        .withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.sum("weight").over(rest).cast("double"))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "rank", "level"))).over(every)["level"])
    )
    share = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return level.select("source", "source_size", F.coalesce(share, F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED, into: str = "mix") -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``mix`` (or ``into``): size, source_size, target, copies, taken."""
    size, source, of = (free_name(docs, n) for n in ("mix_size", "mix_source", "mix_target"))
    totals = docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    t = scratch.cut(targets(totals, weights, max_repeat).select(F.col("source").alias(source), F.struct("source_size", "target").alias(of)), "targets")
    t = F.broadcast(t) if t.count() <= BROADCAST_SOURCES else t
    sized = docs.withColumn(size, word_count(F.col("text")))
    joined = sized.join(t, sized["source"].eqNullSafe(t[source]))
    whole, target = F.col(f"{of}.source_size"), F.col(f"{of}.target")
    rate = F.when(whole > 0, target / whole).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (uniform(F.lit(seed), F.col("doc_id")) < rate - F.floor(rate)).cast("long")
    result = F.struct(F.col(size).alias("size"), whole.alias("source_size"), target.alias("target"), copies.alias("copies"), (F.col(size) * copies).alias("taken"))
    return joined.select(*others(docs, into), result.alias(into))


def emit(mixed: DataFrame, mix: str = "mix", into: str = "copy") -> DataFrame:
    """The mix itself: a row per copy, numbered from 1 in ``copy`` (or ``into``)."""
    return mixed.filter(f"{mix}.copies > 0").select(*others(mixed, mix, into), F.explode(F.sequence(F.lit(1), F.col(f"{mix}.copies").cast("int"))).alias(into))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "mix.size", "mix.source_size", "mix.target", "mix.taken")


def mixing_sql(docs: str = "documents") -> str:
    """The common tables up to ``mixed`` (doc_id, size, source_size, target, copies, taken)."""
    return rf"""
sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {docs}),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, source_size * {MAX_REPEAT} AS cap,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight,
    row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk
  FROM totals),
level AS (
  SELECT *, CAST(sum(source_size) OVER () - COALESCE(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl
  FROM ranked),
opened AS (
  SELECT lvl AS chosen FROM level WHERE lvl * weight <= cap ORDER BY CAST(cap AS DOUBLE) / weight, rnk LIMIT 1),
target AS (
  SELECT source, source_size, COALESCE(least(CAST(cap AS DOUBLE), chosen * weight), CAST(cap AS DOUBLE)) AS target
  FROM level LEFT JOIN opened ON TRUE),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('{SEED}:' || COALESCE(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized d JOIN target t ON d.source IS NOT DISTINCT FROM t.source),
mixed AS (
  SELECT doc_id, size, source_size, target,
    CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM rated)"""


def op2_sql() -> str:
    return f"WITH {mixing_sql()}\nSELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM mixed"
