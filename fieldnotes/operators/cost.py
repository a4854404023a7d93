"""Cost, latency and pipeline-health analytics over model calls and queue jobs.

Every operator is a single aggregate (partial before its shuffle) or two; group keys are narrow,
so what is shuffled is a row per key and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cost_daily(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost by tenant, company and day."""
    return calls.groupBy("tenant_id", "company_id", F.date_trunc("day", "occurred_at").alias("day")).agg(
        F.count("*").alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 4).alias("cost_usd"),
    )


def pipeline_health(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs by status for each tenant and agent, with the failures of the last hour."""
    count = lambda cond: F.count_if(cond)
    recent = (F.col("status") == "failed") & (F.col("finished_at") > as_of - F.expr("interval 1 hour"))
    return jobs.groupBy("tenant_id", "agent_name").agg(
        *[count(F.col("status") == s).alias(s) for s in ("queued", "leased", "running")],
        F.coalesce(count(recent), F.lit(0)).alias("recent_failures"),
    )


def cost_by_company_since(calls: DataFrame, since: Column) -> DataFrame:
    recent = calls.filter(F.col("occurred_at") >= since)
    return recent.groupBy("company_id").agg(F.count("*").alias("calls"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


def cost_windows(calls: DataFrame, as_of: Column) -> DataFrame:
    """One row: cost of the day, week (from Monday) and month of ``as_of``."""
    part = lambda unit: F.round(F.sum(F.when(F.col("occurred_at") >= F.date_trunc(unit, as_of), F.col("cost_usd")).otherwise(0.0)), 4)
    return calls.filter(F.col("occurred_at") <= as_of).agg(part("day").alias("today"), part("week").alias("this_week"), part("month").alias("this_month"))


CUTS = 16


def percentiles(rows: DataFrame, key: str, value: str, names: dict[str, float]) -> DataFrame:
    """Exact percentiles of a column by key, interpolated, under the given names; nulls don't count.

    A sketch cuts each key's values into ``CUTS`` ranges; counts by range tell in which the wanted ranks lie,
    and only the values of those ranges, each with its count, are put in order.  So a task holds a fraction
    of a key's distinct values, however many rows the key has.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v"))
    cuts = rows.groupBy(key).agg(F.percentile_approx("v", [i / CUTS for i in range(1, CUTS)], F.lit(CUTS * 100)).alias("cuts"))
    above = sum(((F.col("v") > F.get("cuts", i)).cast("int") for i in range(CUTS - 1)), F.lit(0))
    ranged = rows.join(cuts, key).select(key, "v", above.alias("range"))
    sizes = ranged.groupBy(key, "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("range")) - F.col("n")  # CUTS rows a key
    sizes = sizes.withColumn("before", before).withColumn("all", F.sum("n").over(Window.partitionBy(key)))
    ranks = F.array(*[F.lit(p) * (F.col("all") - 1) for p in names.values()])
    wanted = F.exists(ranks, lambda r: (F.floor(r) < F.col("before") + F.col("n")) & (F.ceil(r) >= F.col("before")))
    counts = ranged.join(sizes.filter(wanted).select(key, "range", "before", "all"), [key, "range"]).groupBy(key, "range", "before", "all", "v").agg(F.count("*").alias("n"))
    last = F.col("before") + F.sum("n").over(Window.partitionBy(key, "range").orderBy("v"))
    placed = counts.withColumn("last", last).withColumn("first", F.col("last") - F.col("n"))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank < F.col("last")), F.col("v")))

    out = []
    for name, p in names.items():
        r = F.lit(p) * (F.col("all") - 1)
        out += [value_at(F.floor(r)).alias(f"_low_{name}"), value_at(F.ceil(r)).alias(f"_high_{name}"), F.max(r - F.floor(r)).alias(f"_part_{name}")]
    mixed = lambda n: F.round(F.col(f"_low_{n}") + F.col(f"_part_{n}") * (F.col(f"_high_{n}") - F.col(f"_low_{n}")), 4).alias(n)
    return placed.groupBy(key).agg(*out).select(key, *[mixed(n) for n in names])


def latency_percentiles(calls: DataFrame) -> DataFrame:
    return percentiles(calls, "agent_name", "latency_ms", {"p50": 0.5, "p95": 0.95})


def median_cost(calls: DataFrame, target: float) -> DataFrame:
    """One row: the median over companies of their cost, and whether it meets the target."""
    by_company = calls.groupBy("company_id").agg(F.sum("cost_usd").alias("cost")).withColumn("one", F.lit(1))
    median = percentiles(by_company, "one", "cost", {"median_cost": 0.5}).select(F.max("median_cost").alias("median_cost"))
    count = by_company.agg(F.count("*")).scalar()
    return median.select("median_cost", count.alias("companies"), (F.col("median_cost") <= target).alias("within_target"))


def retry_rate(calls: DataFrame, alert: float) -> DataFrame:
    rate = calls.groupBy("company_id").agg(F.round(F.avg(F.col("schema_retry").cast("int")), 6).alias("retry_rate"), F.count("*").alias("calls"))
    return rate.withColumn("alert", F.col("retry_rate") > alert)


def funnel(events: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """One row: for each (from, to) the count of both types and their ratio (null from nothing)."""
    names = list(dict.fromkeys(n for pair in steps for n in pair))
    counts = events.agg(*[F.count_if(F.col("type") == n).alias(n) for n in names])
    return counts.select(*[F.col(n).alias(f"n_{n}") for n in names], *[F.round(F.try_divide(F.col(b).cast("double"), F.col(a).cast("double")), 6).alias(f"{a}_to_{b}") for a, b in steps])


def outcome_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("agent_name", "status").agg(F.count("*").alias("jobs"), F.count_distinct("company_id").alias("companies"))


def histogram(jobs: DataFrame, edges: list[float]) -> DataFrame:
    """Jobs by agent and bucket of ``duration_ms``; bucket i holds edges[i-1] <= x < edges[i]."""
    bucket = sum((F.when(F.col("duration_ms") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return jobs.groupBy("agent_name", bucket.cast("long").alias("bucket")).agg(F.count("*").alias("jobs"))


def ceiling_breaches(calls: DataFrame, ceilings: DataFrame) -> DataFrame:
    """Runs (company and day of an agent) that cost more than the agent's ceiling."""
    runs = calls.groupBy("agent_name", "company_id", F.date_trunc("day", "occurred_at").alias("day")).agg(F.round(F.sum("cost_usd"), 4).alias("cost_usd"))
    return runs.join(ceilings, "agent_name").filter(F.col("cost_usd") > F.col("ceiling_usd"))


SECONDS = 86_400


def rate_alert_runs(events: DataFrame, p95_over: float = 20.0, days: int = 5) -> DataFrame:
    """Runs of at least ``days`` consecutive days whose 95th percentile of events in a second, over all
    seconds of the day, exceeds the limit: gaps and islands."""
    per_second = events.groupBy(F.date_trunc("second", "occurred_at").alias("second")).agg(F.sum("weight").alias("n"))
    # how many seconds had how many events, and the seconds that had none
    counts = per_second.groupBy(F.to_date("second").alias("day"), F.col("n").cast("double").alias("n")).agg(F.count("*").alias("seconds"))
    silent = counts.groupBy("day").agg((F.lit(SECONDS) - F.sum("seconds")).alias("seconds")).select("day", F.lit(0.0).alias("n"), "seconds").filter("seconds > 0")
    per_day = counts.unionByName(silent).groupBy("day").agg(F.percentile("n", 0.95, F.col("seconds")).alias("p95")).filter(F.col("p95") > p95_over)
    # one row a day: small whatever the number of events
    island = F.date_sub("day", F.row_number().over(Window.orderBy("day")))
    runs = per_day.withColumn("island", island).groupBy("island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))
    return runs.filter(F.col("days") >= days).drop("island")
