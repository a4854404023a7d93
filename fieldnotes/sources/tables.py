"""Tables of a data folder, and views of them in the engine's own shapes.

A view renames and derives columns only, so filters and column pruning reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its zone-less timestamps as timestamps of the session zone (UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls, from ``events``: company, agent, cost, tokens, latency, time."""
    e = table(spark, sf_dir, "events")
    tokens = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("call_id"),
        (F.col("user_id") % 3).alias("tenant_id"),
        F.col("user_id").alias("company_id"),
        F.col("event_type").alias("agent_name"),
        tokens.alias("input_tokens"),
        (tokens % 7).alias("output_tokens"),
        F.col("value").alias("cost_usd"),
        (F.col("value") * 10).alias("latency_ms"),
        (F.col("event_type") == "error").alias("schema_retry"),
        F.col("ts").alias("occurred_at"),
    )


LLM_CALLS_SQL = """
SELECT event_id AS call_id, user_id % 3 AS tenant_id, user_id AS company_id, event_type AS agent_name,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS output_tokens,
  value AS cost_usd, value * 10 AS latency_ms, event_type = 'error' AS schema_retry, ts AS occurred_at
FROM events"""

#: Lease length and start of leases in the job view, which has none of its own.
_LEASE = "interval 5 minutes"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue jobs, from ``orders``: status, priority, times, attempts, lease."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("failed")
    priority = F.substring("o_orderpriority", 1, 1).cast("long") * 10
    agent = F.concat(F.lit("agent-"), (F.col("o_orderkey") % 4).cast("string"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 5).alias("tenant_id"),
        F.col("o_custkey").alias("company_id"),
        agent.alias("agent_name"),
        F.lit(1).cast("long").alias("agent_version"),
        F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), F.col("o_orderpriority")), 256).alias("input_hash"),
        status.alias("status"),
        priority.alias("priority"),
        F.col("o_orderdate").alias("available_at"),
        F.when(status == "running", F.col("o_orderdate") + F.expr(_LEASE)).alias("leased_until"),
        F.when(status != "queued", F.col("o_orderdate")).alias("started_at"),
        F.when(status == "failed", F.col("o_orderdate") + F.expr("interval 1 hour")).alias("finished_at"),
        (F.col("o_orderkey") % 4).alias("attempt_count"),
        F.lit(3).cast("long").alias("max_attempts"),
        F.lit(None).cast("string").alias("last_error"),
        F.col("o_totalprice").alias("duration_ms"),
    )


JOBS_SQL = """
SELECT o_orderkey AS id, o_custkey % 5 AS tenant_id, o_custkey AS company_id, 'agent-' || CAST(o_orderkey % 4 AS VARCHAR) AS agent_name,
  CAST(1 AS BIGINT) AS agent_version, sha256(CAST(o_custkey AS VARCHAR) || '|' || o_orderpriority) AS input_hash,
  CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'failed' END AS status,
  CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 10 AS priority, o_orderdate AS available_at,
  CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 5 MINUTE END AS leased_until,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS started_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 HOUR END AS finished_at,
  o_orderkey % 4 AS attempt_count, CAST(3 AS BIGINT) AS max_attempts, CAST(NULL AS VARCHAR) AS last_error, o_totalprice AS duration_ms
FROM orders"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies, from ``customer`` with its nation."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    return joined.select(
        (F.col("c_custkey") % 5).alias("tenant_id"),
        F.col("c_custkey").alias("company_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]+", "-")), F.lit(".example.com")).alias("host"),
        F.lower("c_mktsegment").alias("industry"),
        F.lower("n_name").alias("city"),
        F.when(F.col("c_acctbal") < 0, "paused").otherwise("active").alias("status"),
        F.when(F.col("c_custkey") % 17 == 0, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"),
    )


COMPANIES_SQL = """
SELECT c_custkey % 5 AS tenant_id, c_custkey AS company_id, c_name AS name,
  lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '-', 'g')) || '.example.com' AS host, lower(c_mktsegment) AS industry, lower(n_name) AS city,
  CASE WHEN c_acctbal < 0 THEN 'paused' ELSE 'active' END AS status,
  CASE WHEN c_custkey % 17 = 0 THEN TIMESTAMP '2024-01-01' END AS deleted_at
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals, from ``orders``."""
    o = table(spark, sf_dir, "orders")
    stage = F.when(F.col("o_orderstatus") == "F", "won").when(F.col("o_orderstatus") == "P", "proposal").otherwise("qualified")
    return o.select(F.col("o_orderkey").alias("deal_id"), F.col("o_custkey").alias("company_id"), stage.alias("stage"), F.col("o_totalprice").alias("amount_usd"), F.col("o_orderdate").alias("created_at"))


DEALS_SQL = """
SELECT o_orderkey AS deal_id, o_custkey AS company_id, CASE o_orderstatus WHEN 'F' THEN 'won' WHEN 'P' THEN 'proposal' ELSE 'qualified' END AS stage,
  o_totalprice AS amount_usd, o_orderdate AS created_at FROM orders"""


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent results, from ``documents``: the cache key is (agent, version, input hash)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("artifact_id"),
        (F.col("doc_id") % 150).alias("company_id"),
        F.col("source").alias("agent_name"),
        F.lit(1).cast("long").alias("agent_version"),
        F.sha2("text", 256).alias("input_hash"),
        F.octet_length("text").cast("long").alias("payload_bytes"),
        F.col("lang"),
    )


ARTIFACTS_SQL = """
SELECT doc_id AS artifact_id, doc_id % 150 AS company_id, source AS agent_name, CAST(1 AS BIGINT) AS agent_version,
  sha256(text) AS input_hash, CAST(strlen(text) AS BIGINT) AS payload_bytes, lang FROM documents"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, from ``conversations``: a reply names the message it answers, if any is known."""
    c = table(spark, sf_dir, "conversations")
    ext = lambda turn: F.concat_ws("-", F.lit("m"), F.col("conv_id").cast("string"), turn.cast("string"))
    answered = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("lost-"), F.col("conv_id").cast("string"))).otherwise(ext(F.col("turn") - 1))
    return c.select(
        F.col("conv_id").alias("conversation_id"),
        F.col("turn"),
        F.when(F.col("role") == "assistant", "outbound").otherwise("inbound").alias("direction"),
        ext(F.col("turn")).alias("external_id"),
        F.when((F.col("role") != "assistant") & (F.col("turn") > 0), answered).alias("in_reply_to"),
        F.col("text").alias("body"),
    )


MESSAGES_SQL = """
SELECT conv_id AS conversation_id, turn, CASE WHEN role = 'assistant' THEN 'outbound' ELSE 'inbound' END AS direction,
  'm-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS external_id,
  CASE WHEN role <> 'assistant' AND turn > 0 THEN
    CASE WHEN conv_id % 5 = 0 THEN 'lost-' || CAST(conv_id AS VARCHAR) ELSE 'm-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn - 1 AS VARCHAR) END END AS in_reply_to,
  text AS body FROM conversations"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log, from ``events``: a correlation is a user's day."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("event_type").alias("type"),
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("correlation_id"),
        F.col("user_id").alias("company_id"),
        F.col("ts").alias("occurred_at"),
        (1 + F.col("event_id") % 2).alias("version"),
        F.col("props").alias("payload"),
        F.col("value"),
    )


EVENT_LOG_SQL = """
SELECT event_id, event_type AS type, CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS correlation_id,
  user_id AS company_id, ts AS occurred_at, 1 + event_id % 2 AS version, props AS payload, value FROM events"""
