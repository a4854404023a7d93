"""Relational and queue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldnotes.operators import queue, relational as r
from fieldnotes.plans.costs import JOBS_AS_OF, at
from fieldnotes.sources import tables as t

COMPANIES, ARTIFACTS, DEALS, MESSAGES, JOBS = t.COMPANIES_SQL, t.ARTIFACTS_SQL, t.DEALS_SQL, t.MESSAGES_SQL, t.JOBS_SQL
KEY = ["tenant_id", "agent_name", "agent_version", "input_hash"]
PERMITS = {"agent-0": 8, "agent-1": 4, "agent-2": 16, "agent-3": 4}
PROMPTS = "(VALUES ('email', 1, 'a'), ('email', 1, 'b'), ('email', 2, 'a'), ('roi', 1, 'c'), ('roi', 1, 'c')) AS p(name, version, body_sha256)"
# The catalogue of services.
SERVICES = [
    "whatsapp-receptionist",
    "website-chatbot",
    "lead-qualification-agent",
    "review-automation",
    "ai-receptionist-voice",
    "ai-content-engine",
    "internal-rag-knowledge",
    "image-search-catalog",
    "auto-followup-engine",
    "smart-website-rebuild",
    "seo-audit-fixes",
]
PROPOSED = """(VALUES ('c1', 'website-chatbot', 0.9), ('c1', 'review-automation', 0.9), ('c1', 'time-machine', 0.99), ('c1', 'seo-audit-fixes', 0.4),
  ('c2', 'ai-content-engine', 0.7), ('c2', 'smart-website-rebuild', 0.8), ('c2', 'website-chatbot', 0.8), ('c2', 'internal-rag-knowledge', 0.2), ('c3', 'hologram', 0.5)) AS o(company_id, id, priority_score)"""
BASELINES = "(VALUES ('building', 0.3, 900.0), ('machinery', 0.2, 1500.0), ('global', 0.1, 500.0)) AS b(industry, uplift, lead_value)"
TABLE = lambda s, v, cols="*": s.sql(f"SELECT {cols} FROM {v}")


def requests(s, d):
    """New enqueue requests: of existing jobs' keys, some with another input."""
    j = t.jobs(s, d)
    changed = F.when(F.col("id") % 3 == 0, F.sha2(F.concat(F.lit("new|"), F.col("company_id").cast("string")), 256)).otherwise(F.col("input_hash"))
    return j.select("tenant_id", "agent_name", "agent_version", changed.alias("input_hash"), (F.col("id") + 10_000_000).alias("id"))


REQUESTS = f"""SELECT tenant_id, agent_name, agent_version, CASE WHEN id % 3 = 0 THEN sha256('new|' || CAST(company_id AS VARCHAR)) ELSE input_hash END AS input_hash,
  id + 10000000 AS id FROM ({JOBS})"""


def asked(s, d):
    """Cache requests: a document's text, or another text for every third."""
    a = t.table(s, d, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text"))
    return a.select(F.col("doc_id").alias("request_id"), F.col("source").alias("agent_name"), F.lit(1).cast("long").alias("agent_version"), F.sha2(text, 256).alias("input_hash"))


ASKED = """SELECT doc_id AS request_id, source AS agent_name, CAST(1 AS BIGINT) AS agent_version,
  sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS input_hash FROM documents"""


def enqueued(s, d):
    base = t.jobs(s, d).groupBy(*KEY).agg(F.min("id").alias("id"))
    return r.enqueue(base, requests(s, d), KEY, ["id"])


def hosts(s, d):
    p = t.table(s, d, "pages").select(F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1)).alias("host"))
    return r.new_by_host(p.unionByName(t.companies(s, d).select("host")), t.companies(s, d))


def bundle(s, d):
    talk = t.messages(s, d).withColumn("company_id", F.col("conversation_id"))
    return r.dossier(t.companies(s, d), t.artifacts(s, d), t.deals(s, d), talk)


def correlated(s, d):
    """Jobs fall on a day of the log's month by their id, so that they share correlations with it."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30).cast("int")), "yyyy-MM-dd")
    of = lambda day: F.concat_ws("/", F.col("company_id").cast("string"), day)
    jobs = t.jobs(s, d).select("status", of(day).alias("correlation_id"))
    calls = t.llm_calls(s, d).select("cost_usd", of(F.date_format("occurred_at", "yyyy-MM-dd")).alias("correlation_id"))
    return r.correlate(jobs, calls, t.event_log(s, d))


def dossiers(s, d):
    """Summaries are artifacts, findings deals that weren't won, opportunities all deals, drafts what was sent."""
    deals = t.deals(s, d)
    summaries = t.artifacts(s, d).select("company_id", F.col("input_hash").alias("summary"), F.col("artifact_id").alias("version"))
    findings = deals.filter("stage <> 'won'").select("company_id", (F.col("amount_usd") % 4).cast("int").alias("severity"), F.col("deal_id").alias("check"))
    drafts = t.messages(s, d).filter("direction = 'outbound'").select(F.col("conversation_id").alias("company_id"), F.when(F.col("turn") % 3 == 0, "email").when(F.col("turn") % 3 == 1, "whatsapp").otherwise("proposal").alias("kind"))
    return r.dossier_view(t.companies(s, d), summaries, findings, deals.select("company_id", F.col("amount_usd").alias("score"), F.col("deal_id").alias("id")), drafts)


def found_leads(s, d):
    """Leads are companies; those with an even id are known already."""
    c = t.companies(s, d).join(t.table(s, d, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_acctbal").alias("rating")), "company_id")
    leads = c.select("host", "name", F.col("industry").alias("niche"), "city", "rating")
    return r.lead_search(leads.unionByName(leads.filter("rating > 0")), c.filter("company_id % 2 = 0"), "Building", "Nation_3", 20)


CLAIMED = ["id", "agent_name", "status", "priority", "available_at", "leased_until", "started_at", "attempt_count"]
QUERIES = {
    "company_list": lambda s, d: r.company_list(t.companies(s, d), 2, "active", "building", q="9").select("company_id", "name", "host", "city"),
    "company_view_latest": lambda s, d: r.company_view(t.companies(s, d), t.artifacts(s, d)),
    "soft_delete": lambda s, d: t.companies(s, d).groupBy("tenant_id").agg(F.count_if(F.col("deleted_at").isNull()).alias("live"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted")),
    "dossier_bundle": bundle,
    "dossier_view": dossiers,
    "lead_search": found_leads,
    "company_timeline": lambda s, d: r.timeline(t.event_log(s, d)),
    "cache_hits": lambda s, d: r.cache_hits(asked(s, d), t.artifacts(s, d)),
    "cache_misses": lambda s, d: r.cache_misses(asked(s, d), t.artifacts(s, d)),
    "dedupe_by_host": hosts,
    "catalogue_semi": lambda s, d: TABLE(s, PROPOSED, "company_id, id, CAST(priority_score AS double) AS priority_score").join(s.createDataFrame([(x,) for x in SERVICES], "id string"), "id", "left_semi"),
    "thread_order": lambda s, d: r.thread(t.messages(s, d)),
    "reply_threads": lambda s, d: r.replies(t.messages(s, d)),
    "unmatched_replies": lambda s, d: r.unmatched_replies(t.messages(s, d)),
    "cursor_page": lambda s, d: r.page(t.companies(s, d).filter("deleted_at IS NULL").select("company_id", "host"), "company_id", 100, 25),
    "enqueue_idempotent": enqueued,
    "prompt_conflicts": lambda s, d: r.prompt_conflicts(TABLE(s, PROMPTS)),
    "industry_baselines": lambda s, d: r.with_default(t.companies(s, d).select("company_id", "industry"), TABLE(s, BASELINES, "industry, CAST(uplift AS double) AS uplift, CAST(lead_value AS double) AS lead_value"), "industry", "global", ["uplift", "lead_value"]),
    "correlate_runs": correlated,
    "artifact_sizes": lambda s, d: t.artifacts(s, d).groupBy("agent_name").agg(F.count_distinct("input_hash").alias("inputs"), F.sum("payload_bytes").alias("bytes"), F.max("payload_bytes").alias("largest")),
    "queue_claim": lambda s, d: queue.claim(t.jobs(s, d), at(JOBS_AS_OF), 4).select(*CLAIMED),
    "queue_claim_permits": lambda s, d: queue.claim_permits(t.jobs(s, d), at(JOBS_AS_OF), PERMITS).select(*CLAIMED, "rank"),
    "queue_reap_requeue": lambda s, d: queue.reap_requeue(t.jobs(s, d), at(JOBS_AS_OF)).select("id", "status", "leased_until", "attempt_count", "last_error"),
    "queue_reap_fail": lambda s, d: queue.reap_fail(t.jobs(s, d), at(JOBS_AS_OF)).select("id", "status", "finished_at", "attempt_count"),
    "queue_heartbeat": lambda s, d: queue.heartbeat(t.jobs(s, d), F.col("agent_name") == "agent-1", at(JOBS_AS_OF)).select("id", "leased_until"),
    "queue_after_claim": lambda s, d: queue.apply(t.jobs(s, d), queue.claim(t.jobs(s, d), at(JOBS_AS_OF), 4)).groupBy("status").agg(F.count("*").alias("jobs"), F.sum("attempt_count").alias("attempts")),
    "backoff_schedule": lambda s, d: queue.retry(t.jobs(s, d), at(JOBS_AS_OF)).select("id", "status", F.round(queue.backoff_ms(F.col("attempt_count")), 3).alias("delay_ms"), "available_at"),
}

_CLAIM = f"'running' AS status, priority, available_at, TIMESTAMP '{JOBS_AS_OF}' + INTERVAL 5 MINUTE AS leased_until, COALESCE(started_at, TIMESTAMP '{JOBS_AS_OF}') AS started_at, attempt_count + 1 AS attempt_count"
_FREE = f"FROM ({JOBS}) WHERE status = 'queued' AND available_at <= TIMESTAMP '{JOBS_AS_OF}'"
_EXPIRED = f"FROM ({JOBS}) WHERE status = 'running' AND leased_until < TIMESTAMP '{JOBS_AS_OF}'"
SQL = {
    "company_list": f"""SELECT company_id, name, host, city FROM ({COMPANIES})
WHERE tenant_id = 2 AND deleted_at IS NULL AND status = 'active' AND industry = 'building' AND (name ILIKE '%9%' OR host ILIKE '%9%')""",
    "company_view_latest": f"""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY company_id, agent_name ORDER BY artifact_id DESC) AS k FROM ({ARTIFACTS}))
SELECT c.company_id, name, host, agent_name, artifact_id, input_hash FROM ({COMPANIES}) c LEFT JOIN (SELECT * FROM a WHERE k = 1) a ON c.company_id = a.company_id WHERE deleted_at IS NULL""",
    "soft_delete": f"SELECT tenant_id, count(*) FILTER (WHERE deleted_at IS NULL) AS live, count(*) FILTER (WHERE deleted_at IS NOT NULL) AS deleted FROM ({COMPANIES}) GROUP BY 1",
    "dossier_bundle": f"""
SELECT c.company_id, c.host, COALESCE(artifacts, 0) AS artifacts, latest_artifact, COALESCE(deals, 0) AS deals, amount_usd, COALESCE(won, 0) AS won, COALESCE(messages, 0) AS messages
FROM ({COMPANIES}) c
LEFT JOIN (SELECT company_id, count(*) AS artifacts, max(artifact_id) AS latest_artifact FROM ({ARTIFACTS}) GROUP BY 1) a ON c.company_id = a.company_id
LEFT JOIN (SELECT company_id, count(*) AS deals, round(sum(amount_usd), 2) AS amount_usd, count(*) FILTER (WHERE stage = 'won') AS won FROM ({DEALS}) GROUP BY 1) d ON c.company_id = d.company_id
LEFT JOIN (SELECT conversation_id AS company_id, count(*) AS messages FROM ({MESSAGES}) GROUP BY 1) m ON c.company_id = m.company_id WHERE deleted_at IS NULL""",
    "cache_hits": f"SELECT * FROM ({ASKED}) q WHERE EXISTS (SELECT 1 FROM ({ARTIFACTS}) a WHERE a.agent_name = q.agent_name AND a.agent_version = q.agent_version AND a.input_hash = q.input_hash)",
    "cache_misses": f"SELECT * FROM ({ASKED}) q WHERE NOT EXISTS (SELECT 1 FROM ({ARTIFACTS}) a WHERE a.agent_name = q.agent_name AND a.agent_version = q.agent_version AND a.input_hash = q.input_hash)",
    "dedupe_by_host": f"""
SELECT DISTINCT host FROM (SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages UNION ALL SELECT host FROM ({COMPANIES}))
WHERE host <> '' AND host NOT IN (SELECT host FROM ({COMPANIES}))""",
    "catalogue_semi": f"SELECT company_id, id, CAST(priority_score AS DOUBLE) AS priority_score FROM {PROPOSED} WHERE id IN ({', '.join(repr(x) for x in SERVICES)})",
    "thread_order": f"""
SELECT conversation_id, turn, direction, row_number() OVER w AS position, lag(external_id) OVER w AS previous_id FROM ({MESSAGES}) WINDOW w AS (PARTITION BY conversation_id ORDER BY turn)""",
    "reply_threads": f"""
SELECT a.external_id, a.in_reply_to, b.conversation_id AS sent_conversation FROM ({MESSAGES}) a JOIN ({MESSAGES}) b ON a.in_reply_to = b.external_id
WHERE a.direction = 'inbound' AND b.direction = 'outbound'""",
    "unmatched_replies": f"""
SELECT external_id, conversation_id, in_reply_to FROM ({MESSAGES}) WHERE direction = 'inbound' AND in_reply_to IS NOT NULL AND in_reply_to NOT IN (SELECT external_id FROM ({MESSAGES}))""",
    "cursor_page": f"""
WITH m AS (SELECT company_id, host, row_number() OVER (ORDER BY company_id) AS n, count(*) OVER () AS more
  FROM (SELECT company_id, host FROM ({COMPANIES}) WHERE deleted_at IS NULL AND company_id > 100 ORDER BY company_id LIMIT 26))
SELECT company_id, host, CASE WHEN more > 25 THEN max(company_id) FILTER (WHERE n = 25) OVER () END AS next_cursor FROM m QUALIFY n <= 25""",
    "enqueue_idempotent": f"""
WITH base AS (SELECT tenant_id, agent_name, agent_version, input_hash, min(id) AS id FROM ({JOBS}) GROUP BY 1, 2, 3, 4),
fresh AS (SELECT tenant_id, agent_name, agent_version, input_hash, min(id) AS id FROM ({REQUESTS}) GROUP BY 1, 2, 3, 4)
SELECT *, FALSE AS created FROM base UNION ALL
SELECT *, TRUE AS created FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.tenant_id = f.tenant_id AND b.agent_name = f.agent_name AND b.agent_version = f.agent_version AND b.input_hash = f.input_hash)""",
    "prompt_conflicts": f"SELECT name, version, count(DISTINCT body_sha256) AS bodies FROM {PROMPTS} GROUP BY 1, 2 HAVING count(DISTINCT body_sha256) > 1",
    "industry_baselines": f"""
SELECT c.company_id, c.industry, CAST(COALESCE(b.uplift, g.uplift) AS DOUBLE) AS uplift, CAST(COALESCE(b.lead_value, g.lead_value) AS DOUBLE) AS lead_value, b.industry IS NULL AS is_default
FROM ({COMPANIES}) c LEFT JOIN {BASELINES} ON c.industry = b.industry CROSS JOIN (SELECT * FROM {BASELINES} WHERE industry = 'global') g""",
    "correlate_runs": f"""
WITH j AS (SELECT CAST(company_id AS VARCHAR) || '/' || strftime(DATE '2024-01-01' + CAST(id % 30 AS INTEGER), '%Y-%m-%d') AS correlation_id, count(*) AS jobs, count(*) FILTER (WHERE status = 'failed') AS failed FROM ({JOBS}) GROUP BY 1),
c AS (SELECT CAST(company_id AS VARCHAR) || '/' || strftime(occurred_at, '%Y-%m-%d') AS correlation_id, count(*) AS calls, round(sum(cost_usd), 4) AS cost_usd FROM ({t.LLM_CALLS_SQL}) GROUP BY 1),
e AS (SELECT correlation_id, count(*) AS events, min(occurred_at) AS first_event, max(occurred_at) AS last_event FROM ({t.EVENT_LOG_SQL}) GROUP BY 1),
k AS (SELECT correlation_id FROM j UNION SELECT correlation_id FROM c UNION SELECT correlation_id FROM e)
SELECT k.correlation_id, COALESCE(jobs, 0) AS jobs, COALESCE(failed, 0) AS failed, COALESCE(calls, 0) AS calls, cost_usd, COALESCE(events, 0) AS events, first_event, last_event
FROM k LEFT JOIN j ON k.correlation_id = j.correlation_id LEFT JOIN c ON k.correlation_id = c.correlation_id LEFT JOIN e ON k.correlation_id = e.correlation_id""",
    "dossier_view": f"""
WITH s AS (SELECT company_id, max_by(input_hash, artifact_id) AS summary FROM ({ARTIFACTS}) GROUP BY 1),
f AS (SELECT company_id, string_agg(CAST(deal_id AS VARCHAR), ',' ORDER BY k) AS findings FROM (
  SELECT company_id, deal_id, row_number() OVER (PARTITION BY company_id ORDER BY CAST(trunc(amount_usd % 4) AS INTEGER) DESC, deal_id) AS k FROM ({DEALS}) WHERE stage <> 'won') WHERE k <= 5 GROUP BY 1),
o AS (SELECT company_id, string_agg(CAST(deal_id AS VARCHAR), ',' ORDER BY k) AS opportunities FROM (
  SELECT company_id, deal_id, row_number() OVER (PARTITION BY company_id ORDER BY amount_usd DESC, deal_id) AS k FROM ({DEALS})) WHERE k <= 5 GROUP BY 1),
d AS (SELECT conversation_id AS company_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS drafts FROM (
  SELECT conversation_id, CASE turn % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'whatsapp' ELSE 'proposal' END AS kind FROM ({MESSAGES}) WHERE direction = 'outbound') GROUP BY 1)
SELECT c.company_id, name, summary, COALESCE(findings, '') AS findings, COALESCE(opportunities, '') AS opportunities, COALESCE(drafts, '') AS drafts
FROM ({COMPANIES}) c LEFT JOIN s ON c.company_id = s.company_id LEFT JOIN f ON c.company_id = f.company_id LEFT JOIN o ON c.company_id = o.company_id LEFT JOIN d ON c.company_id = d.company_id
WHERE deleted_at IS NULL""",
    "lead_search": f"""
SELECT host, rating, name FROM (SELECT host, max(c_acctbal) AS rating, max(name) AS name FROM ({COMPANIES}) c JOIN customer ON c_custkey = company_id WHERE industry = 'building' AND city = 'nation_3' AND company_id % 2 = 1 GROUP BY 1)
ORDER BY rating DESC, host LIMIT 20""",
    "company_timeline": f"""
SELECT company_id, event_id, type, occurred_at, row_number() OVER w AS position, CAST(floor(epoch(occurred_at)) - floor(epoch(lag(occurred_at) OVER w)) AS BIGINT) AS seconds
FROM ({t.EVENT_LOG_SQL}) WINDOW w AS (PARTITION BY company_id ORDER BY occurred_at, event_id)""",
    "artifact_sizes": f"SELECT agent_name, count(DISTINCT input_hash) AS inputs, CAST(sum(payload_bytes) AS BIGINT) AS bytes, max(payload_bytes) AS largest FROM ({ARTIFACTS}) GROUP BY 1",
    "queue_claim": f"SELECT id, agent_name, {_CLAIM} FROM (SELECT * {_FREE} ORDER BY priority, available_at, id LIMIT 4)",
    "queue_claim_permits": f"""
SELECT id, agent_name, {_CLAIM}, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY agent_name ORDER BY priority, available_at, id) AS k {_FREE})
WHERE k <= CASE agent_name {" ".join(f"WHEN '{a}' THEN {n}" for a, n in PERMITS.items())} ELSE 0 END""",
    "queue_reap_requeue": f"SELECT id, 'queued' AS status, CAST(NULL AS TIMESTAMP) AS leased_until, attempt_count, COALESCE(last_error, 'lease expired') AS last_error {_EXPIRED} AND attempt_count < max_attempts",
    "queue_reap_fail": f"SELECT id, 'failed' AS status, TIMESTAMP '{JOBS_AS_OF}' AS finished_at, attempt_count {_EXPIRED} AND attempt_count >= max_attempts",
    "queue_heartbeat": f"SELECT id, TIMESTAMP '{JOBS_AS_OF}' + INTERVAL 5 MINUTE AS leased_until FROM ({JOBS}) WHERE status = 'running' AND agent_name = 'agent-1'",
    "queue_after_claim": f"""
WITH c AS (SELECT id {_FREE} ORDER BY priority, available_at, id LIMIT 4)
SELECT CASE WHEN c.id IS NULL THEN j.status ELSE 'running' END AS status, count(*) AS jobs, CAST(sum(attempt_count + CASE WHEN c.id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS attempts
FROM ({JOBS}) j LEFT JOIN c ON j.id = c.id GROUP BY 1""",
    "backoff_schedule": f"""
SELECT id, 'queued' AS status, least(300000.0, 2000.0 * pow(3.0, attempt_count)) AS delay_ms,
  TIMESTAMP '{JOBS_AS_OF}' + to_milliseconds(CAST(least(300000.0, 2000.0 * pow(3.0, attempt_count)) AS BIGINT)) AS available_at
FROM ({JOBS}) WHERE status = 'failed' AND attempt_count < max_attempts""",
}
