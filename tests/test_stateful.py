"""Stateful streams in several micro-batches, over restarts and with rows out of order."""

import random
from datetime import datetime, timedelta

from fieldnotes import streaming
from fieldnotes.streaming import stateful

T0 = datetime(2024, 1, 1)


def append(spark, rows, schema, path):
    """A file for each call: with one file a trigger, each is a micro-batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_idempotent_over_restarts(spark, tmp_path):
    schema = "request_id string, idempotency_key string, ts timestamp"
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    h = lambda n: T0 + timedelta(hours=n)
    parts = [
        [("b", "k", h(1)), ("a", "k", h(0)), ("n", None, h(0)), ("z", "q", h(0.5))],
        [("c", "k", h(23.99)), ("m", None, h(1))],
        [("d", "k", h(24)), ("e", "k", h(30))],
        [("x", "other", h(60))],  # moves the watermark on, so that what has expired goes
        [("f", "k", h(61)), ("y", "q", h(61)), ("g", "k", h(60.95))],
    ]
    for rows in parts:
        append(spark, rows, schema, src)
        found = streaming.drain(stateful.idempotent(stream(spark, schema, src)), out, cp)
    got = {r["request_id"]: r["answered_by"] for r in found.collect()}
    assert got == {"a": "a", "b": "a", "n": "n", "z": "z", "c": "a", "m": "m", "d": "d", "e": "d", "x": "x", "f": "g", "g": "g", "y": "y"}


CADENCE = [(0, 0, "email"), (1, 1, "linkedin"), (2, 4, "whatsapp")]


def naive_due(log, until):
    """Log of (sequence, kind, time) -> due steps before ``until``."""

    def opening(t):
        local = t + timedelta(hours=4)
        day = local.replace(hour=0, minute=0, second=0, microsecond=0)
        if local.hour < 9:
            local = day + timedelta(hours=9)
        elif local.hour >= 18:
            local = day + timedelta(days=1, hours=9)
        return local - timedelta(hours=4)

    out = set()
    for seq in {s for s, _, _ in log}:
        own = sorted((t, k) for s, k, t in log if s == seq)
        began = min((t for t, k in own if k == "start"), default=None)
        if began is None:
            continue
        own = [(t, k) for t, k in own if t > began and k != "start"]
        end = min((t for t, k in own if k == "convert"), default=datetime.max)
        for step, day, channel in CADENCE:
            planned = opening(began + timedelta(days=day))
            for at in sorted([planned, *(opening(t) for t, k in own if k == "resume" and t > planned)]):
                state = [k for t, k in own if t <= at and k in ("pause", "resume")][-1:]
                if at < end and state != ["pause"]:
                    if at < until:
                        out.add((seq, step, channel, at))
                    break
    return out


def test_due_steps_in_any_order_of_arrival(spark, tmp_path):
    schema = "sequence_id long, kind string, at timestamp"
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    draw = random.Random(4)
    log = [(seq, "start", T0 + timedelta(minutes=draw.randrange(3000))) for seq in range(12)]
    log += [(draw.randrange(14), draw.choice(["start", "pause", "resume", "pause", "resume", "convert"]), T0 + timedelta(minutes=draw.randrange(12000))) for _ in range(90)]
    log += [(99, "start", T0 + timedelta(days=12))]
    log.sort(key=lambda r: r[2])
    parts = [log[i : i + 35] for i in range(0, len(log), 35)]
    # a row that comes late, yet within the watermark
    parts[1].append((3, "pause", parts[0][-1][2] - timedelta(minutes=9)))
    for rows in parts:
        draw.shuffle(rows)
        append(spark, rows, schema, src)
        found = streaming.drain(stateful.due_steps(stream(spark, schema, src), CADENCE), out, cp)
    got = [tuple(r) for r in found.collect()]
    until = T0 + timedelta(days=12) - timedelta(minutes=10)
    want = naive_due([r for p in parts for r in p], until)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


def test_buses_differ(spark, tmp_path):
    schema = "event_id long, at timestamp"
    at = lambda n: T0 + timedelta(seconds=n)
    paths = {n: str(tmp_path / n) for n in ("left", "right", "out", "cp")}
    append(spark, [(1, at(0)), (2, at(1)), (2, at(2)), (3, at(3)), (4, at(4))], schema, paths["left"])
    append(spark, [(1, at(30)), (2, at(0)), (4, at(70)), (5, at(5))], schema, paths["right"])
    end = [(100, at(100_000))]
    for side in ("left", "right"):
        append(spark, end, schema, paths[side])
    found = streaming.drain(stateful.bus_diff(*(stream(spark, schema, paths[n]) for n in ("left", "right"))), paths["out"], paths["cp"])
    assert sorted((r["event_id"], r["side"]) for r in found.collect()) == [(3, "left"), (4, "left"), (4, "right"), (5, "right")]


def test_openings():
    us = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    for given, want in (
        (datetime(2024, 1, 1, 4, 59), datetime(2024, 1, 1, 5)),
        (datetime(2024, 1, 1, 5), datetime(2024, 1, 1, 5)),
        (datetime(2024, 1, 1, 13, 59, 59), datetime(2024, 1, 1, 13, 59, 59)),
        (datetime(2024, 1, 1, 14), datetime(2024, 1, 2, 5)),
        (datetime(2024, 1, 31, 21), datetime(2024, 2, 1, 5)),
    ):
        assert stateful.opening(us(given), "Asia/Dubai", 9, 18) == us(want)
