"""Queue semantics as pure functions of a snapshot: who claims, what the reaper does, when to retry.

A step reads one snapshot and gives the changed rows or the next snapshot; a single writer applies
it.  Ranks end in the id, so they are total orders; a claim is a top-n (no full sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEASE = "5 minutes"


def claimable(jobs: DataFrame, as_of: Column) -> DataFrame:
    return jobs.filter((F.col("status") == "queued") & (F.col("available_at") <= as_of))


def _claimed(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.withColumns(
        {
            "status": F.lit("running"),
            "leased_until": as_of + F.expr(f"interval {LEASE}"),
            "started_at": F.coalesce("started_at", as_of),
            "attempt_count": F.col("attempt_count") + 1,
        }
    )


def claim(jobs: DataFrame, as_of: Column, n: int) -> DataFrame:
    """The n most urgent jobs as they are after claiming."""
    return _claimed(claimable(jobs, as_of).orderBy("priority", "available_at", "id").limit(n), as_of)


def apply(jobs: DataFrame, changed: DataFrame) -> DataFrame:
    """The next snapshot: changed rows in place of those with their id."""
    return jobs.join(changed.select("id"), "id", "left_anti").unionByName(changed.select(*jobs.columns))


def claim_permits(jobs: DataFrame, as_of: Column, permits: dict[str, int]) -> DataFrame:
    """Of each agent as many of the most urgent jobs as it has permits; none without an entry."""
    cap = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in permits.items() for x in pair]), F.col("agent_name")), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("agent_name").orderBy("priority", "available_at", "id"))
    most = max(permits.values(), default=0)
    # the constant bound lets each task keep only its first rows before the shuffle
    ranked = claimable(jobs, as_of).withColumn("rank", rank).filter(F.col("rank") <= most).filter(F.col("rank") <= cap)
    return _claimed(ranked, as_of).withColumn("rank", F.col("rank").cast("long"))


def expired(as_of: Column) -> Column:
    return (F.col("status") == "running") & (F.col("leased_until") < as_of)


def reap_requeue(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs whose lease has run out and that have attempts left, as they are requeued."""
    rows = jobs.filter(expired(as_of) & (F.col("attempt_count") < F.col("max_attempts")))
    return rows.withColumns({"status": F.lit("queued"), "leased_until": F.lit(None).cast("timestamp"), "last_error": F.coalesce("last_error", F.lit("lease expired"))})


def reap_fail(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs whose lease has run out and that have none left, as they fail."""
    return jobs.filter(expired(as_of) & (F.col("attempt_count") >= F.col("max_attempts"))).withColumns({"status": F.lit("failed"), "finished_at": as_of})


def heartbeat(jobs: DataFrame, mine: Column, as_of: Column) -> DataFrame:
    """Running jobs of a worker, told by a condition, with their lease extended."""
    return jobs.filter(mine & (F.col("status") == "running")).withColumn("leased_until", as_of + F.expr(f"interval {LEASE}"))


def backoff_ms(attempt: Column, base: float = 2000.0, multiplier: float = 3.0, most: float = 300_000.0) -> Column:
    """Delay before the next attempt, without jitter."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(multiplier), attempt))


def retry(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Failed jobs with attempts left, queued again after their delay."""
    delay = F.make_dt_interval(secs=backoff_ms(F.col("attempt_count")) / 1000)
    return jobs.filter((F.col("status") == "failed") & (F.col("attempt_count") < F.col("max_attempts"))).withColumns({"status": F.lit("queued"), "available_at": as_of + delay})
