"""Event semantics over a log: fan-in, timeouts, dedup, causation, replay, upcasts.

A fan-in's state is one row per key, so it is an aggregate with partial results, never a
collection of a key's events.  Time is the events' own; ``as_of`` is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldnotes import scratch

# Stages in the order work flows, what a replay of one makes stale.
STAGES = {
    "crawl": ["extract"],
    "extract": ["seo", "tech", "bizintel"],
    "seo": ["opportunity"],
    "tech": ["opportunity"],
    "bizintel": ["opportunity"],
    "opportunity": ["roi"],
    "roi": ["email", "whatsapp", "proposal"],
    "email": [],
    "whatsapp": [],
    "proposal": [],
}


def _first_times(log: DataFrame, types: list[str], key: str) -> DataFrame:
    times = [F.min(F.when(F.col("type") == n, F.col("occurred_at"))).alias(f"_t{i}") for i, n in enumerate(types)]
    return log.filter(F.col("type").isin(types)).groupBy(key).agg(*times, F.count_distinct("type").alias("seen"))


def fan_in(log: DataFrame, types: list[str], key: str = "correlation_id") -> DataFrame:
    """Keys that have seen every type: once each, at the last of the types' first times."""
    first = _first_times(log, types, key).filter(F.col("seen") == len(types))
    return first.select(key, F.greatest(*[F.col(f"_t{i}") for i in range(len(types))]).alias("completed_at"))


def fan_in_timed_out(log: DataFrame, types: list[str], as_of: Column, timeout: str = "10 minutes", key: str = "correlation_id") -> DataFrame:
    """Keys that began but weren't complete when the timeout ran out, with how many types they had."""
    first = _first_times(log, types, key)
    times = [F.col(f"_t{i}") for i in range(len(types))]
    began = F.least(*times)
    deadline = began + F.expr(f"interval {timeout}")
    in_time = sum((F.when(t <= deadline, 1).otherwise(0) for t in times), F.lit(0))
    out = first.select(key, began.alias("began_at"), deadline.alias("timed_out_at"), F.coalesce(in_time, F.lit(0)).cast("long").alias("in_time"))
    return out.filter((F.col("in_time") < len(types)) & (F.col("timed_out_at") <= as_of))


def dedup(log: DataFrame, processed: DataFrame, handler: str) -> DataFrame:
    """Events a handler hasn't processed, a repeated delivery once (its earliest)."""
    done = processed.filter(F.col("handler") == handler).select("event_id")
    keep = [c for c in log.columns if c != "event_id"]
    once = log.groupBy("event_id").agg(F.min(F.struct("occurred_at", *[c for c in keep if c != "occurred_at"])).alias("e"))
    return once.select("event_id", *[F.col(f"e.{c}") for c in keep]).join(done, "event_id", "left_anti")


def causation_roots(log: DataFrame) -> DataFrame:
    """(id, root, depth) of every event: its causes followed up to one that has none in the log.

    Repeated events count once, with their least cause.  Each round doubles the stride of the events that
    aren't at their root yet, and is written, so a chain of depth d takes log d rounds of one join, each of
    the events still on their way.  Events whose causes run in a circle have no root: root and depth are null.
    """
    once = log.groupBy("id").agg(F.min("causation_id").alias("causation_id"))
    known = once.select(F.col("id").alias("known"))
    linked = once.join(known, once["causation_id"] == known["known"], "left")
    state = linked.select("id", F.coalesce("known", "id").alias("top"), F.col("known").isNotNull().cast("long").alias("depth"), F.col("known").isNull().alias("done"))
    state = scratch.cut(state, "roots")
    ended, open_ = [state.filter("done")], state.filter("NOT done")
    for _ in range(state.count().bit_length() + 1):
        if not open_.limit(1).count():
            break
        tops = reduce(DataFrame.unionAll, [*ended, open_])
        tops = tops.select(F.col("id").alias("above"), F.col("top").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        moved = open_.join(tops, F.col("top") == F.col("above")).select("id", F.col("next").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"))
        moved = scratch.cut(moved, "roots")
        ended, open_ = [*ended, moved.filter("done")], moved.filter("NOT done")
    roots = reduce(DataFrame.unionAll, ended).select("id", F.col("top").alias("root"), "depth")
    return roots.unionAll(open_.select("id", F.lit(None).cast(dict(roots.dtypes)["root"]).alias("root"), F.lit(None).cast("long").alias("depth")))


def downstream(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id, depth): what was made of the ids of ``start``, from them or through others, and the least number of
    steps to it.  ``edges``: (parent, child), repeats and circles do no harm, a child may have many parents.

    Each round takes the children of what the round before found and drops what is known; it is written, so
    plans don't grow.  There are as many rounds as the longest of the shortest ways.
    """
    known = edges.filter("parent <> child").select("parent", "child").distinct()
    found = [scratch.cut(start.select("id").filter("id IS NOT NULL").distinct().withColumn("depth", F.lit(0).cast("long")), "reached")]
    while found[-1].limit(1).count():
        seen = reduce(DataFrame.unionAll, found).select(F.col("id").alias("child"))
        made = found[-1].join(known, F.col("id") == F.col("parent")).select("child").distinct().join(seen, "child", "left_anti")
        found.append(scratch.cut(made.select(F.col("child").alias("id"), F.lit(len(found)).cast("long").alias("depth")), "reached"))
    return reduce(DataFrame.unionAll, found)


def stale_stages(start: str, graph: dict[str, list[str]] | None = None) -> list[str]:
    """The stage and all below it, in order of first reach."""
    graph, out = STAGES if graph is None else graph, [start]
    for stage in out:
        out.extend(s for s in graph[stage] if s not in out)
    return out


def replay_downstream(artifacts: DataFrame, start: str, stage: str = "stage") -> DataFrame:
    """Artifacts that a replay of a stage invalidates."""
    return artifacts.filter(F.col(stage).isin(stale_stages(start)))


def upcast(log: DataFrame) -> DataFrame:
    """Version 1 payloads {"k": n} as version 2 {"count": n, "unit": "call"}; version 2 keeps its
    count under either name."""
    n = F.coalesce(F.get_json_object("payload", "$.count"), F.get_json_object("payload", "$.k")).cast("long")
    unit = F.when(F.col("version") == 1, F.lit("call")).otherwise(F.coalesce(F.get_json_object("payload", "$.unit"), F.lit("call")))
    return log.withColumns({"count": n, "unit": unit, "version": F.lit(2).cast("long")}).drop("payload")


def bus_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Events that one of two buses lacks or delivered another number of times."""
    a, b = (x.groupBy("event_id").agg(F.count("*").alias(n)) for x, n in ((left, "n_left"), (right, "n_right")))
    both = a.join(b, "event_id", "full_outer").fillna(0, ["n_left", "n_right"])
    return both.filter("n_left <> n_right")


def headless_retries(sites: DataFrame, tried: DataFrame, host: str = "host") -> DataFrame:
    """Sites whose extraction was empty and that weren't tried headless yet: one retry each."""
    return sites.filter("is_empty").join(tried.select(host), host, "left_anti").select(host)


def fresh(cache: DataFrame, queries: DataFrame, as_of: Column, key: list[str], days: int = 7) -> DataFrame:
    """Queries a cache still answers: an entry of the last ``days`` days."""
    live = cache.filter((F.col("cached_at") > as_of - F.make_interval(days=F.lit(days))) & (F.col("cached_at") <= as_of))
    return queries.join(live.select(*key), key, "left_semi")


def idempotent(requests: DataFrame, ttl_hours: int = 24) -> DataFrame:
    """Requests with the one that answers them.  The first with a key is fresh and answers all with it for
    ``ttl_hours``; the first after that is fresh again.  One without a key answers itself.

    Requests of one key and instant are one row before the shuffle; a key's instants, in order, then pass
    through a task that holds no more than the request that answers now.
    """
    span = ttl_hours * 3_600_000_000
    at = requests.withColumn("us", F.unix_micros("ts"))
    instants = at.filter("idempotency_key IS NOT NULL").groupBy("idempotency_key", "us").agg(F.min("request_id").alias("first"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, since, answer = None, 0, None
        for batch in batches:
            out = []
            for k, us, first in zip(batch["idempotency_key"], batch["us"], batch["first"], strict=True):
                if k != key or us >= since + span:
                    key, since, answer = k, us, first
                out.append(answer)
            yield batch[["idempotency_key", "us"]].assign(answered_by=out)

    ordered = instants.repartition("idempotency_key").sortWithinPartitions("idempotency_key", "us")
    schema = f"idempotency_key string, us long, answered_by {dict(requests.dtypes)['request_id']}"
    answers = ordered.mapInPandas(fold, schema)
    return at.join(answers, ["idempotency_key", "us"], "left").select("request_id", "idempotency_key", F.coalesce("answered_by", "request_id").alias("answered_by"))
