"""Cost and pipeline-health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldnotes.operators import cost
from fieldnotes.sources import tables as t

AS_OF = "2024-01-20 12:00:00"
SINCE = "2024-01-15 00:00:00"
JOBS_AS_OF = "1998-06-01 12:00:00"
CALLS, JOBS, LOG = t.LLM_CALLS_SQL, t.JOBS_SQL, t.EVENT_LOG_SQL
#: Ceilings for the stand-in agents, as a table.
CEILINGS = "(VALUES ('view', 60.0), ('click', 80.0), ('signup', 40.0), ('purchase', 100.0)) AS c(agent_name, ceiling_usd)"
STEPS = [("view", "click"), ("click", "signup"), ("signup", "purchase")]
EDGES = [1000.0, 50_000.0, 150_000.0, 300_000.0]


def at(text: str):
    return F.lit(text).cast("timestamp")


def bursts(s):
    """Twelve days: 5,000 seconds of 25 events on six of them, of 20 on the next three, and 4,000 of 30."""
    one = s.range(12 * 5000).select((F.col("id") / 5000).cast("int").alias("day"), (F.col("id") % 5000).cast("int").alias("second"))
    many = F.when(F.col("day") < 6, 25).when(F.col("day") < 9, 20).when(F.col("second") < 4000, 30)
    when = F.lit("2023-11-01 00:00:00").cast("timestamp") + F.make_dt_interval(days=F.col("day"), secs=F.col("second").cast("decimal(18,6)"))
    return one.select(when.alias("occurred_at"), many.cast("long").alias("weight")).filter("weight IS NOT NULL")


_BURSTS = """SELECT TIMESTAMP '2023-11-01' + to_days(CAST(d AS INTEGER)) + to_seconds(n) AS occurred_at, CASE WHEN d < 6 THEN 25 WHEN d < 9 THEN 20 ELSE 30 END AS weight
FROM range(12) a(d), range(5000) b(n) WHERE d < 9 OR n < 4000"""

QUERIES = {
    "cost_daily": lambda s, d: cost.cost_daily(t.llm_calls(s, d)),
    "pipeline_health": lambda s, d: cost.pipeline_health(t.jobs(s, d), at(JOBS_AS_OF)),
    "cost_by_company_since": lambda s, d: cost.cost_by_company_since(t.llm_calls(s, d), at(SINCE)),
    "cost_today_week_month": lambda s, d: cost.cost_windows(t.llm_calls(s, d), at(AS_OF)),
    "latency_p50_p95": lambda s, d: cost.latency_percentiles(t.llm_calls(s, d)),
    "median_cost": lambda s, d: cost.median_cost(t.llm_calls(s, d), 0.05),
    "retry_rate": lambda s, d: cost.retry_rate(t.llm_calls(s, d), 0.05),
    "funnel_rates": lambda s, d: cost.funnel(t.event_log(s, d), STEPS),
    "job_counts": lambda s, d: cost.outcome_counts(t.jobs(s, d)),
    "job_duration_histogram": lambda s, d: cost.histogram(t.jobs(s, d), EDGES),
    "cost_ceiling_breaches": lambda s, d: cost.ceiling_breaches(t.llm_calls(s, d), s.sql(f"SELECT agent_name, CAST(ceiling_usd AS double) AS ceiling_usd FROM {CEILINGS}")),
    "rate_alert_runs": lambda s, d: cost.rate_alert_runs(t.event_log(s, d).select("occurred_at", F.lit(1).cast("long").alias("weight")).unionByName(bursts(s))),
}

SQL = {
    "cost_daily": f"""
SELECT tenant_id, company_id, date_trunc('day', occurred_at) AS day, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 4) AS cost_usd FROM ({CALLS}) GROUP BY 1, 2, 3""",
    "pipeline_health": f"""
SELECT tenant_id, agent_name, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'leased') AS leased,
  count(*) FILTER (WHERE status = 'running') AS running,
  count(*) FILTER (WHERE status = 'failed' AND finished_at > TIMESTAMP '{JOBS_AS_OF}' - INTERVAL 1 HOUR) AS recent_failures
FROM ({JOBS}) GROUP BY 1, 2""",
    "cost_by_company_since": f"SELECT company_id, count(*) AS calls, round(sum(cost_usd), 4) AS cost_usd FROM ({CALLS}) WHERE occurred_at >= TIMESTAMP '{SINCE}' GROUP BY 1",
    "cost_today_week_month": f"""
SELECT {", ".join(f"round(sum(CASE WHEN occurred_at >= date_trunc('{u}', TIMESTAMP '{AS_OF}') THEN cost_usd ELSE 0.0 END), 4) AS {n}" for u, n in (("day", "today"), ("week", "this_week"), ("month", "this_month")))}
FROM ({CALLS}) WHERE occurred_at <= TIMESTAMP '{AS_OF}'""",
    "latency_p50_p95": f"SELECT agent_name, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95 FROM ({CALLS}) GROUP BY 1",
    "median_cost": f"""
SELECT *, median_cost <= 0.05 AS within_target FROM (
  SELECT round(quantile_cont(cost, 0.5), 4) AS median_cost, count(*) AS companies FROM (SELECT company_id, sum(cost_usd) AS cost FROM ({CALLS}) GROUP BY 1))""",
    "retry_rate": f"""
SELECT *, retry_rate > 0.05 AS alert FROM (
  SELECT company_id, round(avg(CAST(schema_retry AS INTEGER)), 6) AS retry_rate, count(*) AS calls FROM ({CALLS}) GROUP BY 1)""",
    "funnel_rates": f"""
SELECT {", ".join(f"{n} AS n_{n}" for n in ("view", "click", "signup", "purchase"))},
  {", ".join(f"round(CASE WHEN {a} = 0 THEN NULL ELSE CAST({b} AS DOUBLE) / {a} END, 6) AS {a}_to_{b}" for a, b in STEPS)}
FROM (SELECT {", ".join(f"count(*) FILTER (WHERE type = '{n}') AS {n}" for n in ("view", "click", "signup", "purchase"))} FROM ({LOG}))""",
    "job_counts": f"SELECT agent_name, status, count(*) AS jobs, count(DISTINCT company_id) AS companies FROM ({JOBS}) GROUP BY 1, 2",
    "job_duration_histogram": f"""
SELECT agent_name, CAST({" + ".join(f"CASE WHEN duration_ms >= {e} THEN 1 ELSE 0 END" for e in EDGES)} AS BIGINT) AS bucket, count(*) AS jobs FROM ({JOBS}) GROUP BY 1, 2""",
    "cost_ceiling_breaches": f"""
SELECT r.agent_name, company_id, day, cost_usd, CAST(ceiling_usd AS DOUBLE) AS ceiling_usd
FROM (SELECT agent_name, company_id, date_trunc('day', occurred_at) AS day, round(sum(cost_usd), 4) AS cost_usd FROM ({CALLS}) GROUP BY 1, 2, 3) r
JOIN {CEILINGS} ON r.agent_name = c.agent_name WHERE cost_usd > ceiling_usd""",
    "rate_alert_runs": f"""
WITH s AS (SELECT date_trunc('second', occurred_at) AS second, sum(weight) AS n FROM (SELECT occurred_at, 1 AS weight FROM ({LOG}) UNION ALL {_BURSTS}) GROUP BY 1),
days AS (SELECT DISTINCT CAST(second AS DATE) AS day FROM s),
every AS (SELECT day, CAST(COALESCE(n, 0) AS DOUBLE) AS n FROM (SELECT day, CAST(day AS TIMESTAMP) + to_seconds(k) AS second FROM days, range(86400) r(k)) g LEFT JOIN s ON s.second = g.second),
d AS (SELECT day, quantile_cont(n, 0.95) AS p95 FROM every GROUP BY 1),
i AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS island FROM d WHERE p95 > 20.0)
SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM i GROUP BY island HAVING count(*) >= 5""",
}
