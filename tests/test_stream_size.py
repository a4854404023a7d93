"""Streams of many correlations and of few busy sequences: a group's work is by columns, its timer one."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from test_stateful import CADENCE, T0, append, naive_due, stream

from fieldnotes import streaming
from fieldnotes.streaming import stateful


class Handle:
    """Counts the timers of one key, and holds its state."""

    def __init__(self):
        self.timers, self.made, self.value = set(), 0, None

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def registerTimer(self, at):
        self.made += 1
        self.timers.add(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_a_busy_sequence_has_one_timer_and_a_short_log():
    us = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    handle, sequences = Handle(), stateful.Sequences(CADENCE, "Asia/Dubai", 9, 18)
    sequences.init(handle)
    kinds = ["start", *(["pause", "resume"] * 1000)]
    rows = pd.DataFrame({"us": [us(T0 + timedelta(minutes=n)) for n in range(len(kinds))], "kind": kinds})
    assert list(sequences.handleInputRows((7,), iter([rows]), At(0))) == []
    assert len(handle.timers) == 1 and handle.made == 1
    (found,) = sequences.handleExpiredTimer((7,), At(us(T0 + timedelta(days=2)) // 1000), At(0))
    want = naive_due([(7, k, T0 + timedelta(minutes=n)) for n, k in enumerate(kinds)], T0 + timedelta(days=2))
    assert {(7, s, c, d.to_pydatetime()) for s, c, d in zip(found["step_index"], found["channel"], found["due_at"], strict=True)} == want and len(want) == 2
    assert len(handle.value[2]) <= 2 and len(handle.timers) == 1


def test_openings_of_many_are_those_of_one():
    rng = np.random.default_rng(1)
    us = rng.integers(1_700_000_000, 1_735_000_000, 400) * 1_000_000
    for zone in ("Asia/Dubai", "Europe/Berlin", "America/New_York"):
        assert stateful.openings(us, zone, 9, 18).tolist() == [stateful.opening(int(u), zone, 9, 18) for u in us]


def test_fan_in_of_many_correlations_over_restarts(spark, tmp_path):
    """Calls are by bucket and not by correlation; results are those of each correlation, null too."""
    schema = "correlation_id string, type string, occurred_at timestamp"
    draw = random.Random(8)
    rows = [(draw.choice([None, *map(str, range(150))]), draw.choice("xyz"), T0 + timedelta(minutes=draw.randrange(200))) for _ in range(600)]
    rows += [("last", "x", T0 + timedelta(minutes=800))]
    rows.sort(key=lambda r: r[2])
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for i in range(0, len(rows), 210):
        append(spark, rows[i : i + 210], schema, src)
        got = streaming.drain(streaming.fan_in(stream(spark, schema, src), ["x", "y"], timeout_minutes=60, buckets=3), out, cp).collect()
    want = set()
    for key in {r[0] for r in rows} - {"last"}:
        first = [min((t for k, kind, t in rows if (k, kind) == (key, w)), default=datetime.max) for w in "xy"]
        if min(first) < datetime.max:
            done = max(first) <= min(first) + timedelta(minutes=60)
            want.add((key, max(first) if done else min(first) + timedelta(minutes=60), not done))
    assert len(got) == len(want) and {tuple(r) for r in got} == want and {r[2] for r in want} == {True, False}
