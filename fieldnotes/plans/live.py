"""Stateful streams over the log, and the SQL of what they must have given by its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldnotes import scratch
from fieldnotes.operators import events as ev
from fieldnotes.plans.flows import CADENCE, calls_stream, drained
from fieldnotes.sources import eventlog, tables as t
from fieldnotes.streaming import stateful

#: What a stream decides lags behind it by the watermark; queries give what is older than this.
SETTLED = "2 hours"


def settled(s, d):
    return F.lit(t.table(s, d, "events").agg(F.max("ts")).first()[0]) - F.expr(f"interval {SETTLED}")


def _requests(e):
    key = F.when(F.col("event_id") % 11 != 0, F.concat_ws("/", F.col("type"), (F.col("company_id") % 50).cast("string")))
    return e.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("request_id"), key.alias("idempotency_key"), F.col("occurred_at").alias("ts"))


def _controls(e):
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("type")]
    return e.select((F.col("company_id") % 400).alias("sequence_id"), kind.alias("kind"), F.col("occurred_at").alias("at"))


KINDS = {"signup": "start", "error": "pause", "click": "resume", "purchase": "convert"}
STEPS = [(step, day, channel) for _, step, day, channel in CADENCE.rows]


def due(s, d):
    found = stateful.due_steps(_controls(calls_stream(s, d)).filter("kind IS NOT NULL"), STEPS)
    return drained(s, found, "due_steps").filter(F.col("due_at") < settled(s, d))


def buses(s, d):
    e = calls_stream(s, d)
    at = F.col("occurred_at")
    left = e.filter("event_id % 13 <> 0").select("event_id", at.alias("at"))
    slow = F.when(F.col("event_id") % 29 == 0, 90).otherwise(F.col("event_id") % 40)
    right = e.filter("event_id % 17 <> 0").select("event_id", (at + F.make_interval(secs=slow)).alias("at"))
    found = stateful.bus_diff(left.unionByName(left.filter("event_id % 5 = 0")), right)
    return drained(s, found, "bus_diff").filter(F.col("at") < settled(s, d))


_REQUESTS = """SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS request_id,
  CASE WHEN event_id % 11 <> 0 THEN event_type || '/' || CAST(user_id % 50 AS VARCHAR) END AS idempotency_key, ts FROM events"""
IDEMPOTENT = f"""
WITH RECURSIVE r AS ({_REQUESTS}),
fresh AS (
  SELECT idempotency_key, min(ts) AS ts FROM r WHERE idempotency_key IS NOT NULL GROUP BY 1
  UNION ALL
  SELECT f.idempotency_key, (SELECT min(n.ts) FROM r n WHERE n.idempotency_key = f.idempotency_key AND n.ts >= f.ts + INTERVAL 24 HOUR) FROM fresh f WHERE f.ts IS NOT NULL),
first AS (SELECT f.idempotency_key, f.ts, min(r.request_id) AS request_id FROM fresh f JOIN r ON r.idempotency_key = f.idempotency_key AND r.ts = f.ts GROUP BY 1, 2)
SELECT r.request_id, r.idempotency_key, COALESCE(f.request_id, r.request_id) AS answered_by
FROM r ASOF LEFT JOIN first f ON r.idempotency_key = f.idempotency_key AND r.ts >= f.ts"""

_KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"


def _opening(at: str) -> str:
    local = f"({at} + INTERVAL 4 HOUR)"
    day = f"date_trunc('day', {local}) + INTERVAL 5 HOUR"  # nine o'clock there, four hours ahead
    return f"CASE WHEN hour({local}) < 9 THEN {day} WHEN hour({local}) >= 18 THEN {day} + INTERVAL 1 DAY ELSE {at} END"


DUE = f"""
WITH c AS (SELECT user_id % 400 AS sequence_id, {_KIND} AS kind, ts FROM events WHERE {_KIND} IS NOT NULL),
s AS (SELECT sequence_id, min(ts) AS began FROM c WHERE kind = 'start' GROUP BY 1),
log AS (SELECT c.* FROM c JOIN s ON c.sequence_id = s.sequence_id AND ts > began WHERE kind <> 'start'),
ended AS (SELECT sequence_id, min(ts) AS ended FROM log WHERE kind = 'convert' GROUP BY 1),
plan AS (SELECT sequence_id, step_index, channel, {_opening("(began + to_days(CAST(day_offset AS INTEGER)))")} AS planned FROM s, {CADENCE.sql} q),
moments AS (
  SELECT sequence_id, step_index, channel, planned AS moment FROM plan
  UNION SELECT p.sequence_id, step_index, channel, {_opening("l.ts")} FROM plan p JOIN log l ON p.sequence_id = l.sequence_id AND l.kind = 'resume' AND l.ts > planned),
status AS (
  SELECT m.*, (SELECT max_by(l.kind, (l.ts, l.kind)) FROM log l WHERE l.sequence_id = m.sequence_id AND l.ts <= m.moment AND l.kind IN ('pause', 'resume')) AS last FROM moments m)
SELECT status.sequence_id, CAST(step_index AS INTEGER) AS step_index, channel, min(moment) AS due_at
FROM status LEFT JOIN ended ON status.sequence_id = ended.sequence_id
WHERE (last IS NULL OR last = 'resume') AND (ended IS NULL OR moment < ended)
GROUP BY 1, 2, 3 HAVING min(moment) < (SELECT max(ts) FROM events) - INTERVAL {SETTLED}"""

BUSES = f"""
WITH l AS (SELECT event_id, ts AS at FROM events WHERE event_id % 13 <> 0),
r AS (SELECT event_id, ts + to_seconds(CASE WHEN event_id % 29 = 0 THEN 90 ELSE event_id % 40 END) AS at FROM events WHERE event_id % 17 <> 0),
j AS (SELECT l.event_id AS a, l.at AS la, r.event_id AS b, r.at AS ra FROM l FULL JOIN r ON l.event_id = r.event_id AND r.at BETWEEN l.at - INTERVAL 1 MINUTE AND l.at + INTERVAL 1 MINUTE)
SELECT coalesce(a, b) AS event_id, CASE WHEN a IS NULL THEN 'right' ELSE 'left' END AS side, coalesce(la, ra) AS at FROM j
WHERE (a IS NULL OR b IS NULL) AND coalesce(la, ra) < (SELECT max(ts) FROM events) - INTERVAL {SETTLED}"""

def _logged(s, d):
    """The log as an event log of three commits."""
    path = scratch.folder(s, "event_log")
    nothing = F.lit(None).cast("string")
    e = t.event_log(s, d).select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), nothing.alias("tenant_id"), "type", F.col("version").cast("int").alias("version"), "correlation_id",
        nothing.alias("causation_id"), F.col("company_id").cast("string").alias("company_id"), "occurred_at", "payload",
    )
    for n in range(3):
        eventlog.append(e.filter(F.crc32("id") % 3 == n), path)
    return path


TAILED = ["error", "purchase"]
LOG_AFTER = 400


def tailed(s, d):
    found = drained(s, eventlog.tail(s, _logged(s, d), TAILED), "tail")
    return found.select(F.col("id").cast("long").alias("event_id"), "type", "occurred_at", "payload")


def replayed(s, d):
    found = eventlog.replay(s, _logged(s, d), TAILED, f"{LOG_AFTER:012}")
    return found.groupBy("type", "company_id").agg(F.count("*").alias("events"), F.max("id").alias("last"))


_TAILED = ", ".join(f"'{x}'" for x in TAILED)
QUERIES = {
    "stream_log_tail": tailed,
    "log_replay": replayed,
    "idempotent_events": lambda s, d: ev.idempotent(_requests(t.event_log(s, d))),
    "stream_idempotent": lambda s, d: drained(s, stateful.idempotent(_requests(calls_stream(s, d))), "idempotent"),
    "stream_due_steps": due,
    "stream_bus_diff": buses,
}
SQL = {
    "stream_log_tail": f"SELECT event_id, event_type AS type, ts AS occurred_at, props AS payload FROM events WHERE event_type IN ({_TAILED})",
    "log_replay": f"""
SELECT event_type AS type, CAST(user_id AS VARCHAR) AS company_id, count(*) AS events, lpad(CAST(max(event_id) AS VARCHAR), 12, '0') AS last
FROM events WHERE event_type IN ({_TAILED}) AND event_id > {LOG_AFTER} GROUP BY 1, 2""",
    "idempotent_events": IDEMPOTENT, "stream_idempotent": IDEMPOTENT, "stream_due_steps": DUE, "stream_bus_diff": BUSES}
