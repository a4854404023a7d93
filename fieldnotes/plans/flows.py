"""Event, retrieval, sequencer and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldnotes import scratch, streaming
from fieldnotes.operators import cost, events as ev, relational, retrieval as rv, sequencer as sq
from fieldnotes.plans.costs import AS_OF, at
from fieldnotes.plans.inline import Rows
from fieldnotes.sources import files, tables as t

LOG = t.EVENT_LOG_SQL
TYPES = ["view", "click", "purchase"]
_TYPES = ", ".join(repr(n) for n in TYPES)
DELIVERED = Rows(
    "event_id long, type string, ts string, version long, payload string",
    (1, "seo.completed", "2024-01-01 00:00:00", 1, '{"k": 3}'),
    (1, "seo.completed", "2024-01-01 00:00:05", 1, '{"k": 3}'),
    (2, "tech.completed", "2024-01-01 00:01:00", 2, '{"count": 4, "unit": "page"}'),
    (3, "bizintel.completed", "2024-01-01 00:00:30", 2, '{"k": 5}'),
    (3, "bizintel.completed", "2024-01-01 00:00:20", 2, '{"k": 5}'),
    (4, "crawl.failed", "2024-01-01 00:02:00", 1, "{}"),
    times=("ts",),
)
OTHER_BUS = Rows("event_id long", (1,), (2,), (3,), (3,), (9,))
PROCESSED = Rows("handler string, event_id long", ("mailer", 2), ("mailer", 7), ("auditor", 1))
STAGED = Rows("artifact_id long, stage string", *enumerate(ev.STAGES, 1))
REQUESTS = Rows(
    "request_id string, idempotency_key string, ts string",
    ("a", "k1", "2024-01-01 00:00:00"),
    ("b", "k1", "2024-01-01 23:59:59"),
    ("c", "k1", "2024-01-02 00:00:00"),
    ("d", "k2", "2024-01-01 05:00:00"),
    ("e", "k1", "2024-01-02 10:00:00"),
    ("f", "k3", "2024-01-01 00:00:00"),
    ("g", "k3", "2024-01-02 06:00:00"),
    ("h", "k3", "2024-01-03 02:00:00"),
    ("i", "k3", "2024-01-03 06:00:00"),
    ("j", "k3", "2024-01-03 06:00:00"),
    ("k", None, "2024-01-01 00:00:00"),
    ("l", None, "2024-01-01 00:00:00"),
    times=("ts",),
)
CACHE = Rows("niche string, city string, cached_at string", ("dental", "dubai", "2024-01-14 12:00:00"), ("dental", "paris", "2024-01-13 11:59:59"), ("gym", "dubai", "2024-01-21 00:00:00"), times=("cached_at",))
QUERIES_ASKED = Rows("niche string, city string", ("dental", "dubai"), ("dental", "paris"), ("gym", "dubai"), ("spa", "oslo"))
WINS = Rows(
    "id string, version long, outcome string, amount double",
    ("w1", 1, "lost", 10.0),
    ("w2", 1, "won", 20.0),
)
CHANGES = Rows("id string, version long, outcome string, amount double", ("w1", 2, "won", 15.0), ("w3", 1, "stalled", 5.0))
OBJECTIONS = Rows(
    "id string, group_id string, score double, ts string",
    ("o1", "price", 0.9, "2023-06-01 00:00:00"),
    ("o2", "price", 0.7, "2024-01-19 00:00:00"),
    ("o3", "price", 0.7, "2024-01-19 00:00:00"),
    ("o4", "it", 0.4, "2024-01-01 00:00:00"),
    ("o5", "price", 0.2, "2024-01-20 00:00:00"),
    times=("ts",),
)
# The outreach cadence (day of the sequence, channel).
CADENCE = Rows("cadence string, step_index long, day_offset long, channel string", *[("default", i, day - 1, c) for i, (day, c) in enumerate(((1, "email"), (2, "linkedin"), (4, "whatsapp"), (7, "email"), (10, "linkedin"), (15, "email")))])
DUE_AT = "2024-01-20 07:00:00"
#: A search's queries: every row whose id is divisible by this, against all rows.
EVERY = 20


CHAIN = 2_000_000_000


def caused(s, d):
    """The log with a parent for each event but every fifth, a chain of 100, and repeated deliveries."""
    e = t.table(s, d, "events")
    log = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") - 1).alias("causation_id"))
    chain = s.range(CHAIN, CHAIN + 100).select("id", F.when(F.col("id") > CHAIN, F.col("id") - 1).alias("causation_id"))
    log = log.unionByName(chain)
    return log.unionByName(log.filter("id % 7 = 0"))


def asked(s, d):
    return t.table(s, d, "embeddings").filter(F.col("vec_id") % EVERY == 0)


def near(s, d):
    return rv.neighbours(t.table(s, d, "embeddings"), asked(s, d))


def sequences(s, d):
    """A sequence for each conversation, started on a day of January."""
    c = t.table(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"))
    status = F.when(F.col("conv_id") % 7 == 0, "paused").when(F.col("conv_id") % 11 == 0, "converted").otherwise("active")
    began = F.lit("2024-01-01 06:00:00").cast("timestamp") + F.make_interval(days=(F.col("conv_id") % 20).cast("int"))
    return c.select(F.col("conv_id").alias("sequence_id"), F.lit("default").alias("cadence"), status.alias("status"), began.alias("started_at"), "turns")


_SEQUENCES = """SELECT conv_id AS sequence_id, 'default' AS cadence, CASE WHEN conv_id % 7 = 0 THEN 'paused' WHEN conv_id % 11 = 0 THEN 'converted' ELSE 'active' END AS status,
  TIMESTAMP '2024-01-01 06:00:00' + to_days(CAST(conv_id % 20 AS INTEGER)) AS started_at, max(turn) AS turns FROM conversations GROUP BY conv_id"""


def steps(s, d):
    rows = sequences(s, d)
    out = sq.schedule(rows, CADENCE.df(s))
    return out.join(rows.select("sequence_id", "turns"), "sequence_id").withColumn("sent", F.col("step_index") < F.col("turns") % 4)


_STEPS = f"""SELECT q.sequence_id, status, step_index, channel, started_at + to_days(CAST(day_offset AS INTEGER)) AS scheduled_for, step_index < turns % 4 AS sent
FROM ({_SEQUENCES}) q JOIN {CADENCE.sql} c ON q.cadence = c.cadence"""


def calls_stream(s, d, name: str = "events.parquet"):
    """The calls as a stream of the table's files."""
    reader = s.readStream.schema(s.read.parquet(f"{d}/{name}").schema)
    e = reader.parquet(f"{d}/{name}") if _is_folder(s, f"{d}/{name}") else reader.option("pathGlobFilter", name).parquet(d)
    return e.select("event_id", F.col("user_id").alias("company_id"), F.col("event_type").alias("type"), F.col("value").alias("cost_usd"), F.col("ts").cast("timestamp").alias("occurred_at"))


def _is_folder(s, path: str) -> bool:
    where = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def drained(s, stream, name: str, mode: str = "append"):
    """The rows of a stream over all that its source has; files and checkpoints go to the shared folder."""
    return streaming.drain(stream, scratch.folder(s, f"{name}/rows"), scratch.folder(s, f"{name}/checkpoint"), mode)


def repeated(s, d):
    """The log with every fifth event delivered again a moment later."""
    log = calls_stream(s, d)
    again = calls_stream(s, d).filter("event_id % 5 = 0").withColumn("occurred_at", F.col("occurred_at") + F.expr("interval 3 seconds"))
    return log.unionByName(again)


def sagas(s, d):
    return calls_stream(s, d).withColumn("correlation_id", F.concat_ws("/", F.col("company_id").cast("string"), F.date_format("occurred_at", "yyyy-MM-dd")))


SAGA_MINUTES = 600
REPLAY_AFTER = 500


def replayed(s, d):
    """The log kept as JSON files, from an event on and of some types; ids sort as texts by time."""
    path = scratch.folder(s, "log")
    log = t.event_log(s, d)
    log.select(F.lpad(F.col("event_id").cast("string"), 20, "0").alias("id"), "type", "correlation_id", "occurred_at").write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    rows = files.replay(s, path, f"{REPLAY_AFTER:020}", ["error", "purchase"])
    return rows.select(F.col("id").cast("long").alias("event_id"), "type", "occurred_at", "correlation_id")

QUERIES = {
    "fan_in_completed": lambda s, d: ev.fan_in(t.event_log(s, d), TYPES),
    "fan_in_timed_out": lambda s, d: ev.fan_in_timed_out(t.event_log(s, d), TYPES, at(AS_OF)),
    "causation_roots": lambda s, d: ev.causation_roots(caused(s, d)),
    "dedup_events": lambda s, d: ev.dedup(DELIVERED.df(s).withColumnRenamed("ts", "occurred_at"), PROCESSED.df(s), "mailer").select("event_id", "type", "occurred_at"),
    "replay_downstream": lambda s, d: ev.replay_downstream(STAGED.df(s), "tech"),
    "event_upcast": lambda s, d: ev.upcast(t.event_log(s, d).select("event_id", "version", "payload").unionByName(DELIVERED.df(s).select((F.col("event_id") + 1_000_000_000).alias("event_id"), "version", "payload"))),
    "bus_diff": lambda s, d: ev.bus_diff(DELIVERED.df(s), OTHER_BUS.df(s)),
    "merged_streams": lambda s, d: t.event_log(s, d).filter("type = 'view'").unionByName(t.event_log(s, d).filter("type = 'error'")).groupBy("type").agg(F.count("*").alias("events"), F.max("event_id").alias("last")),
    "recent_events": lambda s, d: relational.recent(t.event_log(s, d), "occurred_at", at(AS_OF), "1 hour").select("event_id", "type", "occurred_at"),
    "replayed_events": replayed,
    "idempotent_requests": lambda s, d: ev.idempotent(REQUESTS.df(s)),
    "discovery_cache": lambda s, d: ev.fresh(CACHE.df(s), QUERIES_ASKED.df(s), at(AS_OF), ["niche", "city"]),
    "headless_retries": lambda s, d: ev.headless_retries(t.table(s, d, "pages").groupBy((F.col("page_id") % 50).alias("host")).agg((F.sum(F.length("html")) < 40000).alias("is_empty")), s.range(0, 50, 7).select(F.col("id").alias("host"))),
    "vector_top5": near,
    "vector_top5_filtered": lambda s, d: near(s, d).filter("label < 5"),
    "past_wins": lambda s, d: rv.best_per(near(s, d), "label"),
    "retrieval_lists": lambda s, d: rv.listed(asked(s, d), near(s, d).filter("label = 3")),
    "anchor_semi": lambda s, d: t.table(s, d, "embeddings").select(F.col("vec_id").alias("deal_id"), "label").join(near(s, d).select(F.col("vec_id").alias("deal_id")), "deal_id", "left_semi"),
    "vector_upsert": lambda s, d: rv.upsert(WINS.df(s), CHANGES.df(s), "id", "version"),
    "objections_by_recency": lambda s, d: rv.by_recency(OBJECTIONS.df(s), at(AS_OF), 30.0, 3),
    "posts_per_week": lambda s, d: t.event_log(s, d).groupBy("company_id", F.date_trunc("week", "occurred_at").alias("week")).agg(F.count("*").alias("posts")),
    "schedule_calendar": lambda s, d: sq.schedule(sequences(s, d), CADENCE.df(s)).select("sequence_id", "step_index", "channel", "scheduled_for"),
    "due_steps": lambda s, d: sq.due(steps(s, d), at(DUE_AT)),
    "stream_cost_daily": lambda s, d: drained(s, streaming.cost_daily(calls_stream(s, d)), "cost_daily", "complete").withColumn("cost_usd", F.round("cost_usd", 4)),
    "stream_dedup": lambda s, d: drained(s, streaming.dedup(repeated(s, d)), "dedup").groupBy("type").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids")),
    "stream_fan_in": lambda s, d: drained(s, streaming.fan_in(sagas(s, d), TYPES), "fan_in"),
    "stream_fan_in_slow": lambda s, d: drained(s, streaming.fan_in(sagas(s, d), TYPES, timeout_minutes=SAGA_MINUTES), "fan_in_slow"),
}

_FIRST = f"""SELECT correlation_id, {", ".join(f"min(CASE WHEN type = '{n}' THEN occurred_at END) AS t{i}" for i, n in enumerate(TYPES))}, count(DISTINCT type) AS seen
FROM ({LOG}) WHERE type IN ({_TYPES}) GROUP BY 1"""


def _sagas(minutes: int) -> str:
    """Completed in time, or timed out before the watermark: ten minutes before the last event."""
    return f"""
WITH f AS (SELECT correlation_id, t0, t1, t2, least(t0, t1, t2) + INTERVAL {minutes} MINUTE AS deadline FROM ({_FIRST})),
w AS (SELECT max(occurred_at) - INTERVAL 10 MINUTE AS watermark FROM ({LOG}) WHERE type IN ({_TYPES})),
g AS (SELECT *, COALESCE(t0 <= deadline AND t1 <= deadline AND t2 <= deadline, FALSE) AS complete FROM f)
SELECT correlation_id, CASE WHEN complete THEN greatest(t0, t1, t2) ELSE deadline END AS completed_at, NOT complete AS timed_out FROM g, w WHERE complete OR deadline < watermark"""


_NEAR = f"""
SELECT query_id, rank, vec_id, score, label FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id, v.label,
      round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))), 6) AS score
    FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % {EVERY} = 0)) WHERE rank <= 5"""
SQL = {
    "fan_in_completed": f"SELECT correlation_id, greatest(t0, t1, t2) AS completed_at FROM ({_FIRST}) WHERE seen = 3",
    "fan_in_timed_out": f"""
SELECT * FROM (SELECT correlation_id, least(t0, t1, t2) AS began_at, least(t0, t1, t2) + INTERVAL 10 MINUTE AS timed_out_at,
  CAST({" + ".join(f"CASE WHEN t{i} <= least(t0, t1, t2) + INTERVAL 10 MINUTE THEN 1 ELSE 0 END" for i in range(3))} AS BIGINT) AS in_time FROM ({_FIRST}))
WHERE in_time < 3 AND timed_out_at <= TIMESTAMP '{AS_OF}'""",
    "causation_roots": f"""
WITH RECURSIVE log AS (SELECT event_id AS id, CASE WHEN event_id % 5 <> 0 THEN event_id - 1 END AS causation_id FROM events
  UNION ALL SELECT n, CASE WHEN n > {CHAIN} THEN n - 1 END FROM range({CHAIN}, {CHAIN} + 100) r(n)),
linked AS (SELECT l.id, p.id AS up FROM log l LEFT JOIN log p ON l.causation_id = p.id),
walk AS (SELECT id, id AS root, up, CAST(0 AS BIGINT) AS depth FROM linked UNION ALL
  SELECT w.id, l.id, l.up, w.depth + 1 FROM walk w JOIN linked l ON w.up = l.id)
SELECT id, root, depth FROM walk WHERE up IS NULL""",
    "dedup_events": f"""
SELECT event_id, type, occurred_at FROM (SELECT event_id, type, ts AS occurred_at, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS k FROM {DELIVERED.sql})
WHERE k = 1 AND event_id NOT IN (SELECT event_id FROM {PROCESSED.sql} WHERE handler = 'mailer')""",
    "replay_downstream": f"SELECT artifact_id, stage FROM {STAGED.sql} WHERE stage IN ('tech', 'opportunity', 'roi', 'email', 'whatsapp', 'proposal')",
    "event_upcast": f"""
SELECT event_id, CAST(2 AS BIGINT) AS version, CAST(COALESCE(json_extract_string(payload, '$.count'), json_extract_string(payload, '$.k')) AS BIGINT) AS count,
  CASE WHEN version = 1 THEN 'call' ELSE COALESCE(json_extract_string(payload, '$.unit'), 'call') END AS unit
FROM (SELECT event_id, version, payload FROM ({LOG}) UNION ALL SELECT event_id + 1000000000, version, payload FROM {DELIVERED.sql})""",
    "bus_diff": f"""
SELECT COALESCE(a.event_id, b.event_id) AS event_id, COALESCE(n_left, 0) AS n_left, COALESCE(n_right, 0) AS n_right
FROM (SELECT event_id, count(*) AS n_left FROM {DELIVERED.sql} GROUP BY 1) a FULL JOIN (SELECT event_id, count(*) AS n_right FROM {OTHER_BUS.sql} GROUP BY 1) b ON a.event_id = b.event_id
WHERE COALESCE(n_left, 0) <> COALESCE(n_right, 0)""",
    "merged_streams": f"SELECT type, count(*) AS events, max(event_id) AS last FROM ({LOG}) WHERE type IN ('view', 'error') GROUP BY 1",
    "replayed_events": f"SELECT event_id, type, occurred_at, correlation_id FROM ({LOG}) WHERE event_id > {REPLAY_AFTER} AND type IN ('error', 'purchase')",
    "recent_events": f"SELECT event_id, type, occurred_at FROM ({LOG}) WHERE occurred_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR AND occurred_at <= TIMESTAMP '{AS_OF}'",
    "idempotent_requests": f"""
WITH RECURSIVE r AS (SELECT * FROM {REQUESTS.sql}),
fresh AS (
  SELECT idempotency_key, min(ts) AS ts FROM r WHERE idempotency_key IS NOT NULL GROUP BY 1
  UNION ALL
  SELECT f.idempotency_key, (SELECT min(n.ts) FROM r n WHERE n.idempotency_key = f.idempotency_key AND n.ts >= f.ts + INTERVAL 24 HOUR) FROM fresh f WHERE f.ts IS NOT NULL)
SELECT request_id, idempotency_key, COALESCE((SELECT min(a.request_id) FROM r a WHERE a.idempotency_key = r.idempotency_key
  AND a.ts = (SELECT max(f.ts) FROM fresh f WHERE f.idempotency_key = r.idempotency_key AND f.ts <= r.ts)), request_id) AS answered_by FROM r""",
    "discovery_cache": f"""
SELECT niche, city FROM {QUERIES_ASKED.sql} q WHERE EXISTS (SELECT 1 FROM {CACHE.sql} c WHERE c.niche = q.niche AND c.city = q.city
  AND cached_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND cached_at <= TIMESTAMP '{AS_OF}')""",
    "headless_retries": "SELECT page_id % 50 AS host FROM pages GROUP BY 1 HAVING sum(length(html)) < 40000 AND (page_id % 50) % 7 <> 0",
    "vector_top5": _NEAR,
    "vector_top5_filtered": f"SELECT * FROM ({_NEAR}) WHERE label < 5",
    "past_wins": f"SELECT query_id, rank, vec_id, score, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM ({_NEAR})) WHERE n = 1",
    "retrieval_lists": f"""
SELECT e.vec_id AS query_id, COALESCE(found, '') AS found FROM embeddings e
LEFT JOIN (SELECT query_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS found FROM ({_NEAR}) WHERE label = 3 GROUP BY 1) n ON e.vec_id = n.query_id WHERE e.vec_id % {EVERY} = 0""",
    "anchor_semi": f"SELECT vec_id AS deal_id, label FROM embeddings WHERE vec_id IN (SELECT vec_id FROM ({_NEAR}))",
    "vector_upsert": f"""
SELECT id, version, outcome, amount FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS k FROM (SELECT * FROM {WINS.sql} UNION ALL SELECT * FROM {CHANGES.sql})) WHERE k = 1""",
    "objections_by_recency": f"""
SELECT group_id, rank, id, decayed FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY decayed DESC, id) AS rank FROM (
  SELECT *, round(score * pow(0.5, (epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 86400.0 / 30.0), 6) AS decayed FROM {OBJECTIONS.sql})) WHERE rank <= 3""",
    "posts_per_week": f"SELECT company_id, date_trunc('week', occurred_at) AS week, count(*) AS posts FROM ({LOG}) GROUP BY 1, 2",
    "schedule_calendar": f"SELECT sequence_id, step_index, channel, scheduled_for FROM ({_STEPS})",
    "due_steps": f"""
SELECT sequence_id, step_index, channel, scheduled_for FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY step_index) AS k FROM ({_STEPS}) WHERE status = 'active' AND NOT sent)
WHERE k = 1 AND scheduled_for <= TIMESTAMP '{DUE_AT}' AND hour(TIMESTAMP '{DUE_AT}' + INTERVAL 4 HOUR) BETWEEN 9 AND 17""",
    "stream_cost_daily": f"SELECT date_trunc('day', occurred_at) AS day, company_id, count(*) AS calls, round(sum(value), 4) AS cost_usd FROM ({LOG}) GROUP BY 1, 2",
    "stream_dedup": f"SELECT type, count(*) AS events, count(DISTINCT event_id) AS ids FROM ({LOG}) GROUP BY 1",
    "stream_fan_in": _sagas(10),
    "stream_fan_in_slow": _sagas(SAGA_MINUTES),
}
