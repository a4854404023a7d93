"""Queries of the versioned store, built from the tables; and rules by the thousand."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldnotes import scratch
from fieldnotes.operators import rules
from fieldnotes.sources import tables as t
from fieldnotes.sources.store import Store, Table


def vectors(s, d):
    """A collection of vectors, changed by a batch that is committed twice; and the number of the first snapshot."""
    e = t.table(s, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.lit(1).alias("version"))
    store = Store(scratch.folder(s, "vectors"), {"past_wins": Table("vec_id", "version")})
    changed = e.filter("vec_id % 5 = 0").select("vec_id", (F.col("label") + 100).alias("label"), (2 - F.col("vec_id") % 2 * 2).cast("int").alias("version"))
    first = store.commit(s, {"past_wins": e.filter("vec_id % 3 <> 0")})
    for _ in range(2):
        store.commit(s, {"past_wins": changed})
    return store, first


def upserted(s, d):
    store, _ = vectors(s, d)
    return store.read(s, "past_wins")


def before(s, d):
    store, first = vectors(s, d)
    return store.read(s, "past_wins", first).select("vec_id", "label", "version")


def announced(s, d):
    """Artifacts in three batches of a stream, each with its completion events in the same commit, the second
    delivered twice."""
    a = t.artifacts(s, d)
    store = Store(scratch.folder(s, "artifacts"), {"artifacts": Table("artifact_id", "agent_version"), "events": Table("event_id", "version")})
    for batch in (0, 1, 1, 2):
        rows = a.filter(F.col("artifact_id") % 3 == batch)
        event = F.sha2(F.concat_ws("|", F.lit("completed"), F.col("artifact_id").cast("string")), 256)
        store.commit(s, {"artifacts": rows, "events": rows.select(event.alias("event_id"), F.lit(1).alias("version"), "artifact_id", "company_id")}, ("agents", batch))
    both = store.read(s, "artifacts").join(store.read(s, "events").select("artifact_id", "event_id"), "artifact_id", "left")
    return both.groupBy("agent_name").agg(F.count("*").alias("artifacts"), F.count("event_id").alias("events"), F.sum("payload_bytes").alias("bytes"))


_WORD = r"[A-Za-z]{6,}"


def many(s, d):
    """Every longer word of the benchmark is a rule, looked for in each page."""
    words = t.table(s, d, "benchmark").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_WORD), 0))).alias("name")).distinct()
    none = F.lit(None).cast("string")
    given = words.select("name", F.lit("word").alias("category"), F.lit("html").alias("kind"), none.alias("header"), F.concat("name", F.lit("[a-z]*[,.]")).alias("regex"), F.lit(0.6).alias("weight"))
    pages = t.table(s, d, "pages").select("page_id", "html", F.create_map().cast("map<string,string>").alias("headers"))
    return rules.detect(pages, given).groupBy("name").agg(F.count("*").alias("pages"), F.min("page_id").alias("first"))


_VECTORS = "SELECT vec_id, CAST(label AS BIGINT) AS label, 1 AS version FROM embeddings"
QUERIES = {"store_upsert": upserted, "store_as_of": before, "store_artifacts": announced, "tech_rules_many": many}
SQL = {
    "store_upsert": f"""
WITH e AS ({_VECTORS}), a AS (SELECT * FROM e WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, label + 100, CAST(2 - vec_id % 2 * 2 AS INTEGER) FROM e WHERE vec_id % 5 = 0)
SELECT vec_id, arg_max(label, version) AS label, max(version) AS version FROM a GROUP BY 1""",
    "store_as_of": f"SELECT * FROM ({_VECTORS}) WHERE vec_id % 3 <> 0",
    "store_artifacts": f"SELECT agent_name, count(*) AS artifacts, count(*) AS events, sum(payload_bytes) AS bytes FROM ({t.ARTIFACTS_SQL}) GROUP BY 1",
    "tech_rules_many": f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORD}')) AS name FROM benchmark)
SELECT name, count(*) AS pages, min(page_id) AS first FROM pages JOIN w ON contains(html, name) AND regexp_matches(html, name || '[a-z]*[,.]') GROUP BY 1""",
}
