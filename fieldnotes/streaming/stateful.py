"""Operators that keep state by key and set timers in event time: idempotent requests, sequences of due steps,
and two buses compared.

State is in RocksDB, so it is bounded by disk, not by an executor's memory, and a restart goes on from the
checkpoint.  What may still arrive is bounded by the watermark: rows later than that are dropped, and what is
decided at an instant is decided once the watermark has passed it, so results don't depend on the order of
arrival within it.  Rows that a micro-batch holds of one key are put in order in memory; the source's
``maxBytesPerTrigger`` bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE = "10 minutes"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE = 60_000_000


def _on_rocks(stream: DataFrame) -> None:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Answers(StatefulProcessor):
    """The request that answers a key now: one row of state, dropped by a timer when it has expired."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("answer", "since long, request_id string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "request_id"], kind="stable")
        held = self.now.get() if self.now.exists() else None
        before, out = held, []
        for us, request in zip(batch["us"].tolist(), batch["request_id"], strict=True):
            if held is None or us >= held[0] + self.span:
                held = (us, request)
            out.append(held[1])
        if held != before:
            self.now.update(held)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((held[0] + self.span) // 1000 + 1)
        yield pd.DataFrame({"request_id": batch["request_id"], "idempotency_key": key[0], "answered_by": out})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.now.clear()
        return iter(())

    def close(self) -> None:
        pass


def idempotent(requests: DataFrame, ttl_hours: int = 24, late: str = LATE) -> DataFrame:
    """(request_id, idempotency_key, answered_by) of a stream of requests (request_id, idempotency_key, ts): the
    first with a key answers all with it for ``ttl_hours``, the first after that is fresh again.  Requests are
    answered as they come: of those that come in one micro-batch the earliest is first; one that is older than
    the request that already answers gets that answer too.  One without a key answers itself."""
    _on_rocks(requests)
    keyed = requests.filter("idempotency_key IS NOT NULL").select(F.col("request_id").cast("string").alias("request_id"), "idempotency_key", F.unix_micros("ts").alias("us"), "ts").withWatermark("ts", late)
    answered = keyed.groupBy("idempotency_key").transformWithStateInPandas(Answers(ttl_hours * 60 * MINUTE), "request_id string, idempotency_key string, answered_by string", "Append", "EventTime")
    alone = requests.filter("idempotency_key IS NULL").select(F.col("request_id").cast("string").alias("request_id"), "idempotency_key", F.col("request_id").cast("string").alias("answered_by"))
    return answered.unionByName(alone)


def opening(us: int, zone: str, opens: int, closes: int) -> int:
    """The first instant from ``us`` on within business hours of a zone."""
    at = pd.Timestamp(us, unit="us", tz="UTC").tz_convert(zone)
    if at.hour < opens:
        at = at.normalize() + pd.Timedelta(hours=opens)
    elif at.hour >= closes:
        at = (at.normalize() + pd.Timedelta(days=1)).normalize() + pd.Timedelta(hours=opens)
    return at.value // 1000 if at.unit == "ns" else int(at.timestamp() * 1_000_000)


def openings(us: np.ndarray, zone: str, opens: int, closes: int) -> np.ndarray:
    """``opening`` of many instants."""
    at = pd.to_datetime(us, unit="us", utc=True).tz_convert(zone)
    day = at.normalize()
    nine, next_nine = (x + pd.Timedelta(hours=opens) for x in (day, (day + pd.Timedelta(days=1)).normalize()))
    micros = lambda x: x.tz_convert("UTC").tz_localize(None).to_numpy("datetime64[us]").astype(np.int64)
    return np.where(at.hour < opens, micros(nine), np.where(at.hour >= closes, micros(next_nine), us))


class Sequences(StatefulProcessor):
    """A sequence: when it began, the steps that are still to come, and what was done to it since.

    It has one timer, at the next instant at which one of its steps may be due; when the watermark has passed
    that, all instants that it has passed are decided at once, for by then nothing earlier can arrive.  What
    no later instant asks for is forgotten then: of the pauses and resumptions that the watermark has passed
    the last stays, of the resumptions that are still to take effect the last for each of their openings.
    """

    def __init__(self, cadence: list[tuple[int, int, str]], zone: str, opens: int, closes: int):
        self.cadence = {step: (offset, channel) for step, offset, channel in cadence}
        self.hours = (zone, opens, closes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sequence", "began long, pending array<int>, times array<long>, kinds array<string>")

    def _planned(self, began: int, step: int) -> int:
        return opening(began + self.cadence[step][0] * 24 * 60 * MINUTE, *self.hours)

    def _held(self) -> tuple[int | None, list[int], np.ndarray, np.ndarray]:
        began, pending, times, kinds = self.state.get() if self.state.exists() else (None, sorted(self.cadence), [], [])
        return began, list(pending), np.array(times, np.int64), np.array(kinds, object)

    def _decided(self, began: int | None, pending: list[int], times: np.ndarray, kinds: np.ndarray, upto: int) -> list[tuple[int, int]]:
        """Settles all before ``upto``: (step, instant) of the steps due; the state and the timer for the rest."""
        order = np.lexsort((kinds.astype(str), times))
        times, kinds = times[order], kinds[order]
        out, waits, opened = [], [], np.zeros(0, np.int64)
        if began is not None and pending:
            counts = times > began
            seen_times, seen_kinds = times[counts], kinds[counts]
            converts = seen_times[seen_kinds == "convert"]
            ended = int(converts[0]) if len(converts) else np.iinfo(np.int64).max
            turns = seen_kinds != "convert"
            turn_times, paused = seen_times[turns], seen_kinds[turns] == "pause"
            resumed = turn_times[~paused]
            opened = openings(resumed, *self.hours)
            for step in pending:
                planned = self._planned(began, step)
                moments = np.unique(np.append(opened[resumed > planned], planned))
                coming = moments[moments >= upto]
                moments = moments[(moments < upto) & (moments < ended)]
                last = np.searchsorted(turn_times, moments, "right") - 1
                free = moments[(last < 0) | ~paused[last]] if len(paused) else moments
                if len(free):
                    out.append((step, int(free[0])))
                elif len(coming) and coming[0] < ended:
                    waits.append(int(coming[0]))
            pending = [step for step in pending if step not in dict(out)]
        # what has passed: an instant to come sees the last pause or resumption, and the openings still to come
        passed, turn = times < upto, kinds != "convert"
        keep = ~passed
        if began is None or began >= upto:  # what is before a beginning doesn't count
            pass
        else:
            keep |= passed & (kinds == "convert")
            last_turn = np.flatnonzero(passed & turn)[-1:]
            keep[last_turn] = True
            resumes = np.flatnonzero(passed & (kinds == "resume") & (times > began))
            effect = openings(times[resumes], *self.hours)
            _, latest = np.unique(effect[::-1], return_index=True)
            latest = len(effect) - 1 - latest
            keep[resumes[latest[effect[latest] >= upto]]] = True
            converts = np.flatnonzero(keep & (kinds == "convert") & (times > began))
            keep[converts[1:]] = False
        if not pending:
            keep[:] = False
        self.state.update((began, pending, times[keep].tolist(), kinds[keep].tolist()))
        wanted = {min(waits) // 1000 + 1} if waits else set()
        timers = set(self.handle.listTimers())
        for timer in timers - wanted:
            self.handle.deleteTimer(timer)
        for timer in wanted - timers:
            self.handle.registerTimer(timer)
        return out

    def _rows(self, key: Any, out: list[tuple[int, int]]) -> pd.DataFrame:
        steps = [s for s, _ in out]
        return pd.DataFrame({"sequence_id": [key[0]] * len(out), "step_index": steps, "channel": [self.cadence[s][1] for s in steps], "due_at": pd.to_datetime([m for _, m in out], unit="us")})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        began, pending, times, kinds = self._held()
        new = pd.concat([batch[["us", "kind"]] for batch in rows])
        us, kind = new["us"].to_numpy(np.int64), new["kind"].to_numpy(object)
        starts = us[kind == "start"]
        if len(starts):
            began = int(starts.min()) if began is None else min(began, int(starts.min()))
        others = kind != "start"
        out = self._decided(began, pending, np.append(times, us[others]), np.append(kinds, kind[others]), timerValues.getCurrentWatermarkInMs() * 1000)
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        began, pending, times, kinds = self._held()
        out = self._decided(began, pending, times, kinds, timerValues.getCurrentWatermarkInMs() * 1000)
        if out:
            yield self._rows(key, out)

    def close(self) -> None:
        pass


def due_steps(log: DataFrame, cadence: list[tuple[int, int, str]], zone: str = "Asia/Dubai", opens: int = 9, closes: int = 18, late: str = LATE) -> DataFrame:
    """(sequence_id, step_index, channel, due_at) of a stream (sequence_id, kind, at) of what happens to sequences:
    start, pause, resume, convert.  ``cadence``: step, day of the sequence, channel.

    A step is due at the first of these instants at which its sequence is neither paused nor converted: the
    one it is planned for, moved into business hours, and the first business hour after each resumption
    since.  A sequence begins at its first start; what is before that doesn't count.  Ties of instants are
    taken by name, so that a resumption beats a pause."""
    _on_rocks(log)
    rows = log.select("sequence_id", "kind", F.unix_micros("at").alias("us"), "at").withWatermark("at", late)
    kind = dict(log.dtypes)["sequence_id"]
    out = f"sequence_id {kind}, step_index int, channel string, due_at timestamp"
    return rows.groupBy("sequence_id").transformWithStateInPandas(Sequences(cadence, zone, opens, closes), out, "Append", "EventTime")


def bus_diff(left: DataFrame, right: DataFrame, within: str = "1 minute", late: str = LATE) -> DataFrame:
    """Events (event_id, at) that only one of two streams delivers, or the other not ``within`` that time, as
    (event_id, side, at): a full outer join by id and time, whose unmatched rows come out, and whose state
    goes, once the watermarks of both have passed what could match them.  Repeats of an event within the
    watermark count once."""
    a, b = (
        x.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"]).select(F.col("event_id").alias(f"{n}_id"), F.col("at").alias(f"{n}_at"))
        for x, n in ((left, "left"), (right, "right"))
    )
    near = F.expr(f"left_id = right_id AND right_at BETWEEN left_at - INTERVAL {within} AND left_at + INTERVAL {within}")
    both = a.join(b, near, "full_outer").filter("left_id IS NULL OR right_id IS NULL")
    return both.select(F.coalesce("left_id", "right_id").alias("event_id"), F.when(F.col("left_id").isNull(), "right").otherwise("left").alias("side"), F.coalesce("left_at", "right_at").alias("at"))
