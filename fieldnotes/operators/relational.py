"""Views over companies, artifacts, conversations and deals.

Latest-of-key is an aggregate (``max_by``), not a window, so partial results meet before the
shuffle; anti and semi joins are left to Catalyst's choice of broadcast or sort-merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldnotes.operators.ordered import running


def company_list(companies: DataFrame, tenant: int, status: str | None = None, industry: str | None = None, city: str | None = None, q: str | None = None) -> DataFrame:
    """Live companies of a tenant; every given filter is a conjunct, ``q`` matches name or host."""
    out = companies.filter((F.col("tenant_id") == tenant) & F.col("deleted_at").isNull())
    for name, value in (("status", status), ("industry", industry), ("city", city)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    if q is not None:
        out = out.filter(F.col("name").ilike(f"%{q}%") | F.col("host").ilike(f"%{q}%"))
    return out


def latest(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Of each key, the row that is greatest by ``order``."""
    best = F.max(F.struct(*order, *keep)).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{c}") for c in dict.fromkeys([*order, *keep])])


def company_view(companies: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Live companies with their latest artifact of each agent, null where there is none."""
    live = companies.filter(F.col("deleted_at").isNull()).select("company_id", "name", "host")
    return live.join(latest(artifacts, ["company_id", "agent_name"], ["artifact_id"], ["input_hash"]), "company_id", "left")


def dossier(companies: DataFrame, artifacts: DataFrame, deals: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row per live company: its artifacts, deals and conversations, summed before joining."""
    a = artifacts.groupBy("company_id").agg(F.count("*").alias("artifacts"), F.max("artifact_id").alias("latest_artifact"))
    d = deals.groupBy("company_id").agg(F.count("*").alias("deals"), F.round(F.sum("amount_usd"), 2).alias("amount_usd"), F.count_if(F.col("stage") == "won").alias("won"))
    c = conversations.groupBy("company_id").agg(F.count("*").alias("messages"))
    live = companies.filter(F.col("deleted_at").isNull()).select("company_id", "host")
    out = live.join(a, "company_id", "left").join(d, "company_id", "left").join(c, "company_id", "left")
    return out.fillna(0, ["artifacts", "deals", "won", "messages"])


CACHE_KEY = ["agent_name", "agent_version", "input_hash"]


def cache_hits(requests: DataFrame, artifacts: DataFrame, key: list[str] = CACHE_KEY) -> DataFrame:
    return requests.join(artifacts.select(*key), key, "left_semi")


def cache_misses(requests: DataFrame, artifacts: DataFrame, key: list[str] = CACHE_KEY) -> DataFrame:
    return requests.join(artifacts.select(*key), key, "left_anti")


def new_by_host(leads: DataFrame, companies: DataFrame, host: str = "host") -> DataFrame:
    """Hosts of leads, once each, that no company has."""
    return leads.select(host).filter(F.col(host) != "").distinct().join(companies.select(host), host, "left_anti")


def thread(messages: DataFrame) -> DataFrame:
    """Messages in the order of their conversation, with the one before."""
    placed = running(messages.select("conversation_id", "turn", "direction", "external_id"), "conversation_id", ["turn"], rank="position", before={"previous_id": "external_id"})
    return placed.drop("external_id")


def replies(messages: DataFrame) -> DataFrame:
    """Inbound messages with the outbound one they answer."""
    sent = messages.filter("direction = 'outbound'").select(F.col("external_id").alias("sent_id"), F.col("conversation_id").alias("sent_conversation"))
    got = messages.filter("direction = 'inbound' AND in_reply_to IS NOT NULL")
    return got.join(sent, got["in_reply_to"] == sent["sent_id"]).select("external_id", "in_reply_to", "sent_conversation")


def unmatched_replies(messages: DataFrame) -> DataFrame:
    known = messages.select(F.col("external_id").alias("known_id"))
    got = messages.filter("direction = 'inbound' AND in_reply_to IS NOT NULL")
    return got.join(known, got["in_reply_to"] == known["known_id"], "left_anti").select("external_id", "conversation_id", "in_reply_to")


def page(rows: DataFrame, key: str, after: int | str | None, size: int) -> DataFrame:
    """A page by key, and in ``next_cursor`` the last key if more rows follow."""
    rest = rows if after is None else rows.filter(F.col(key) > F.lit(after))
    more = rest.orderBy(key).limit(size + 1)
    w = Window.orderBy(key)  # of at most size + 1 rows
    numbered = more.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count("*").over(Window.partitionBy()))
    last = F.max(F.when(F.col("_n") == size, F.col(key))).over(Window.partitionBy())
    return numbered.withColumn("next_cursor", F.when(F.col("_all") > size, last)).filter(F.col("_n") <= size).drop("_n", "_all")


def enqueue(jobs: DataFrame, requests: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """The queue after idempotent enqueueing: existing rows win, requests with one key are one job."""
    fresh = requests.groupBy(*key).agg(F.min(F.struct(*keep)).alias("first")).select(*key, *[F.col(f"first.{c}") for c in keep])
    fresh = fresh.join(jobs.select(*key), key, "left_anti")
    return jobs.select(*key, *keep).withColumn("created", F.lit(False)).unionByName(fresh.withColumn("created", F.lit(True)))


def prompt_conflicts(prompts: DataFrame) -> DataFrame:
    """Versions of a prompt that were registered with different bodies."""
    return prompts.groupBy("name", "version").agg(F.count_distinct("body_sha256").alias("bodies")).filter("bodies > 1")


def with_default(rows: DataFrame, lookup: DataFrame, key: str, default: str, values: list[str]) -> DataFrame:
    """Values looked up by key, or else those of the default key (one row, by scalar subqueries)."""
    fallback = {v: lookup.filter(F.col(key) == default).agg(F.max(v)).scalar() for v in values}
    joined = rows.join(lookup.filter(F.col(key) != default).select(key, *values, F.lit(True).alias("_known")), key, "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(v), fallback[v]).alias(v) for v in values], F.col("_known").isNull().alias("is_default"))


def lead_search(leads: DataFrame, known: DataFrame, niche: str, city: str, limit: int = 50) -> DataFrame:
    """The best ``limit`` leads of a niche and city, once each host, whose host no company has."""
    wanted = leads.filter((F.lower("niche") == niche.lower()) & (F.lower("city") == city.lower()) & (F.col("host") != ""))
    once = wanted.groupBy("host").agg(F.max(F.struct("rating", "name")).alias("best")).select("host", "best.*")
    return once.join(known.select("host").distinct(), "host", "left_anti").orderBy(F.desc("rating"), "host").limit(limit)


def timeline(log: DataFrame, company: str = "company_id") -> DataFrame:
    """A company's events in the order they occurred, numbered, with the seconds since the one before."""
    placed = running(log.select(company, "event_id", "type", "occurred_at"), company, ["occurred_at", "event_id"], rank="position", before={"_before": "occurred_at"})
    since = F.unix_timestamp("occurred_at") - F.unix_timestamp("_before")
    return placed.withColumn("seconds", since).drop("_before")


def dossier_view(companies: DataFrame, summaries: DataFrame, findings: DataFrame, opportunities: DataFrame, drafts: DataFrame, top: int = 5) -> DataFrame:
    """The reviewable dossier of each live company: its latest summary, its gravest findings and best
    opportunities (``top`` of each) and its drafts by kind, lists comma-joined, empty where there are none."""

    def best(rows: DataFrame, order: str, name: str) -> DataFrame:
        w = Window.partitionBy("company_id").orderBy(F.desc(order), name)
        kept = rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= top)
        return kept.groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col(name).cast("string").alias("_v")))), lambda x: x["_v"]).alias("list"))

    latest_ = summaries.groupBy("company_id").agg(F.max_by("summary", "version").alias("summary"))
    kinds = drafts.groupBy("company_id").agg(F.array_sort(F.collect_set("kind")).alias("list"))
    out = companies.filter(F.col("deleted_at").isNull()).select("company_id", "name").join(latest_, "company_id", "left")
    for name, rows in (("findings", best(findings, "severity", "check")), ("opportunities", best(opportunities, "score", "id")), ("drafts", kinds)):
        out = out.join(rows.select("company_id", F.array_join("list", ",").alias(name)), "company_id", "left")
    return out.fillna("", ["findings", "opportunities", "drafts"])


def correlate(jobs: DataFrame, calls: DataFrame, log: DataFrame, key: str = "correlation_id") -> DataFrame:
    """What happened under each correlation: jobs, model calls with their cost, events with their span.
    Each side is summed first; a correlation that any of them has gets a row."""
    j = jobs.groupBy(key).agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "failed").alias("failed"))
    c = calls.groupBy(key).agg(F.count("*").alias("calls"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))
    e = log.groupBy(key).agg(F.count("*").alias("events"), F.min("occurred_at").alias("first_event"), F.max("occurred_at").alias("last_event"))
    return j.join(c, key, "full").join(e, key, "full").fillna(0, ["jobs", "failed", "calls", "events"])


def recent(rows: DataFrame, column: str, as_of: Column, within: str) -> DataFrame:
    return rows.filter((F.col(column) > as_of - F.expr(f"interval {within}")) & (F.col(column) <= as_of))
