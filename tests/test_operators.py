"""Properties and worked cases that the tables don't show."""

import datetime
import io
import json
import pathlib
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldnotes import session, streaming
from fieldnotes.functions import money, text, urls
from fieldnotes.operators import cost, events, pages, queue, relational, retrieval, rules, sequencer, validators
from fieldnotes.plans import costs, inline, web
from fieldnotes.sources import files, tables

SF = "/root/testdata/sf0.001"
JOB = "id long, agent_name string, status string, priority long, available_at timestamp, leased_until timestamp, started_at timestamp, finished_at timestamp, attempt_count long, max_attempts long, last_error string"
T0 = datetime.datetime(2024, 1, 1, 12, 0, 0)


def m(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def at(minutes=0):
    return F.lit(m(minutes).isoformat(sep=" ")).cast("timestamp")


@pytest.fixture
def jobs(spark):
    return spark.createDataFrame(
        [
            (1, "a", "queued", 10, m(-5), None, None, None, 0, 3, None),
            (2, "a", "queued", 10, m(-5), None, None, None, 0, 3, None),
            (3, "a", "queued", 5, m(5), None, None, None, 0, 3, None),
            (4, "b", "queued", 20, m(-9), None, m(-60), None, 1, 3, "x"),
            (5, "b", "running", 10, m(-20), m(-1), m(-20), None, 1, 3, None),
            (6, "b", "running", 10, m(-20), m(-1), m(-20), None, 3, 3, None),
            (7, "b", "running", 10, m(-20), None, m(-20), None, 1, 3, None),
            (8, "c", "failed", 10, m(-20), None, m(-20), m(-10), 2, 3, "boom"),
        ],
        JOB,
    )


def ids(df, col="id"):
    return [r[col] for r in df.collect()]


def test_claim_orders_and_skips_the_future(jobs):
    got = queue.claim(jobs, at(), 10)
    assert ids(got) == [1, 2, 4]
    assert {r["id"]: r["started_at"] for r in got.collect()} == {1: T0, 2: T0, 4: m(-60)}


def test_claims_never_repeat(jobs):
    first = queue.claim(jobs, at(), 2)
    second = queue.claim(queue.apply(jobs, first), at(), 2)
    assert set(ids(first)).isdisjoint(ids(second)) and queue.apply(jobs, first).count() == jobs.count()


def test_reaping_is_idempotent_and_splits_by_attempts(jobs):
    requeued, failed = queue.reap_requeue(jobs, at()), queue.reap_fail(jobs, at())
    assert ids(requeued) == [5] and ids(failed) == [6]
    assert requeued.first()["last_error"] == "lease expired"
    again = queue.apply(queue.apply(jobs, requeued), failed)
    assert not ids(queue.reap_requeue(again, at())) and not ids(queue.reap_fail(again, at()))


def test_permits_and_heartbeat_and_backoff(spark, jobs):
    assert sorted(ids(queue.claim_permits(jobs, at(), {"a": 1}))) == [1]
    assert ids(queue.heartbeat(jobs, F.col("id").isin(5, 8), at())) == [5]
    delays = spark.range(6).select(queue.backoff_ms(F.col("id")).alias("d")).collect()
    assert [r["d"] for r in delays] == [2000, 6000, 18000, 54000, 162000, 300000]
    assert queue.retry(jobs, at()).first()["available_at"] == T0 + datetime.timedelta(seconds=18)


def test_thousand_jobs_are_claimed_once(spark):
    now = spark.range(1000).select(
        "id", F.lit("a").alias("agent_name"), F.lit("queued").alias("status"), (F.col("id") % 7).alias("priority"), at(-1).alias("available_at"), F.lit(None).cast("timestamp").alias("leased_until"),
        F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(0).cast("long").alias("attempt_count"), F.lit(3).cast("long").alias("max_attempts"), F.lit(None).cast("string").alias("last_error"),
    )
    snapshot, seen = spark.createDataFrame(now.collect(), now.schema), []
    for _ in range(4):
        got = queue.claim(snapshot, at(), 250)
        seen += ids(got)
        snapshot = spark.createDataFrame(queue.apply(snapshot, got).collect(), now.schema)
    assert sorted(seen) == list(range(1000))


def test_enqueue_twice_is_once(spark):
    have = spark.createDataFrame([("t", "h1", 1)], "tenant_id string, input_hash string, id long")
    want = spark.createDataFrame([("t", "h1", 7), ("t", "h2", 8), ("t", "h2", 9)], have.schema)
    once = relational.enqueue(have, want, ["tenant_id", "input_hash"], ["id"])
    twice = relational.enqueue(once.drop("created"), want, ["tenant_id", "input_hash"], ["id"])
    assert sorted(ids(once)) == sorted(ids(twice)) == [1, 8]


def test_urls(spark):
    cases = {
        "HTTPS://Shop.Example.com/A?utm_x=1&b=2#f": "https://shop.example.com/A?b=2",
        "http://x.com/?UTM_source=1": "http://x.com/",
        "http://x.com?a=1&&utm_b": "http://x.com?a=1",
        "": "",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.normalise(F.col("u")).alias("n"), urls.host_of(F.col("u")).alias("h")).collect()
    assert {r["u"]: r["n"] for r in rows} == cases
    assert spark.createDataFrame([("http://me@Host.com:80/x",)], "u string").select(urls.host_of(F.col("u")).alias("h")).first()["h"] == "host.com"


def test_hash_ignores_order_of_keys(spark):
    a, b = (F.create_map(*[F.lit(x) for kv in p for x in kv]) for p in ([("x", "1"), ("y", "2")], [("y", "2"), ("x", "1")]))
    row = spark.range(1).select(text.input_hash(a).alias("a"), text.input_hash(b).alias("b")).first()
    assert row["a"] == row["b"]


def test_money(spark):
    row = spark.range(1).select(
        money.payback_months(F.lit(1500.0), F.lit(2400.0), F.lit(80.0)).alias("p"), money.payback_months(F.lit(1.0), F.lit(2.0), F.lit(2.0)).alias("zero"), money.discounted(F.lit(100.0), F.lit(0.9)).alias("d")
    ).first()
    assert round(row["p"], 2) == 0.65 and row["zero"] is None and row["d"] == 80.0


def test_empty_page_has_every_gap(spark):
    found = rules.detect(web.headed(spark), web.SIGNALS.df(spark))
    assert {r["category"] for r in rules.gaps(web.headed(spark), found).filter("page_id = 4").collect()} == set(rules.GAPS)


def test_rules_in_slices_give_the_same(spark, monkeypatch):
    whole = {tuple(r) for r in rules.detect(web.headed(spark), web.SIGNALS.df(spark)).collect()}
    monkeypatch.setattr(rules, "BROADCAST_RULES", 4)
    assert {tuple(r) for r in rules.detect(web.headed(spark), web.SIGNALS.df(spark)).collect()} == whole


def test_budget_by_pages_and_by_bytes(spark):
    rows = spark.createDataFrame([(1, "h", 0, 10), (2, "h", 1, 10), (3, "h", 1, 10), (4, "g", 0, 90), (5, "g", 1, 20)], "page_id long, host string, depth int, bytes long")
    assert sorted(ids(pages.crawl_budget(rows, 2, 100), "page_id")) == [1, 2, 4]


def test_words_around_the_bound(spark):
    rows = spark.createDataFrame([("http://a.com/", "<p>" + "w " * 199), ("http://b.com/", "<p>" + "w " * 200)], "url string, html string")
    assert {r["host"]: r["is_empty"] for r in pages.site_words(rows).collect()} == {"a.com": True, "b.com": False}


EVENT = "id string, type string, correlation_id string, occurred_at timestamp"


def test_fan_in_ignores_order_and_repeats(spark):
    rows = [("1", "x", "k", m(3)), ("2", "y", "k", m(1)), ("3", "x", "k", m(9)), ("4", "x", "l", m(0)), ("5", "y", "l", m(11)), ("6", "x", "n", m(0))]
    a, b = (events.fan_in(spark.createDataFrame(r, EVENT), ["x", "y"]).collect() for r in (rows, rows[::-1]))
    assert {tuple(r) for r in a} == {tuple(r) for r in b} == {("k", m(3)), ("l", m(11))}
    late = events.fan_in_timed_out(spark.createDataFrame(rows, EVENT), ["x", "y"], at(60))
    assert {(r["correlation_id"], r["in_time"]) for r in late.collect()} == {("l", 1), ("n", 1)}


def test_causation_with_missing_parent_repeats_depth_and_circles(spark):
    rows = [("a", None), ("b", "a"), ("b", "a"), ("c", "b"), ("c", "b"), ("d", "c"), ("e", "gone"), ("x", "y"), ("y", "x"), ("z", "x")]
    rows += [(f"n{i:03}", f"n{i - 1:03}" if i else None) for i in range(100)]
    got = [tuple(r) for r in events.causation_roots(spark.createDataFrame(rows, "id string, causation_id string")).collect()]
    want = {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "a", 3), ("e", "e", 0), ("x", None, None), ("y", None, None), ("z", None, None)}
    assert len(got) == len(set(got)) and set(got) == want | {(f"n{i:03}", "n000", i) for i in range(100)}
    none = spark.createDataFrame([], "id string, causation_id string")
    assert events.causation_roots(none).collect() == []


def test_requests_are_answered_for_a_day_from_the_fresh_one(spark):
    rows = [("a", "k", m(0)), ("b", "k", m(60 * 30)), ("c", "k", m(60 * 50)), ("d", "k", m(60 * 54)), ("e", "k", m(60 * 24 - 1)), ("f", None, m(0)), ("g", None, m(0)), ("h", "l", m(1)), ("i", "l", m(1))]
    got = events.idempotent(spark.createDataFrame(rows, "request_id string, idempotency_key string, ts timestamp")).collect()
    assert {r["request_id"]: r["answered_by"] for r in got} == {"a": "a", "b": "b", "c": "b", "d": "d", "e": "a", "f": "f", "g": "g", "h": "h", "i": "h"}


def saga_files(tmp_path):
    rows = [("1", "x", "k", 3), ("2", "y", "k", 1), ("2", "y", "k", 1), ("4", "x", "l", 0), ("6", "x", "n", 0), ("7", "y", "n", 2), ("8", "x", "o", 0), ("8b", "y", "o", 11), ("9", "x", "far", 60 * 24)]
    for i, (e, kind, key, t) in enumerate(rows):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": e, "type": kind, "correlation_id": key, "occurred_at": m(t).isoformat()}))


def test_stream_equals_batch(spark, tmp_path):
    saga_files(tmp_path)
    stream = files.event_stream(spark, str(tmp_path), ["x", "y"])
    got = {tuple(r) for r in streaming.drain(streaming.fan_in(stream, ["x", "y"]), f"{tmp_path}/out", f"{tmp_path}/check").collect()}
    batch = events.fan_in(files.replay(spark, str(tmp_path)), ["x", "y"]).collect()
    late = events.fan_in_timed_out(files.replay(spark, str(tmp_path)), ["x", "y"], at(60 * 24 - 10)).collect()
    assert {(r["correlation_id"], r["completed_at"], False) for r in batch if r["correlation_id"] != "o"} | {(r["correlation_id"], r["timed_out_at"], True) for r in late} == got
    assert got == {("k", m(3), False), ("n", m(2), False), ("l", m(10), True), ("o", m(10), True)}
    once = streaming.drain(streaming.dedup(stream, "id"), f"{tmp_path}/out2", f"{tmp_path}/check2")
    assert once.count() == 8


def test_following_a_log_goes_on_from_its_checkpoint(spark, tmp_path):
    (tmp_path / "log").mkdir()

    def add(name, rows):
        (tmp_path / "log" / f"{name}.json").write_text("\n".join(json.dumps({"id": e, "type": "x", "occurred_at": m(t).isoformat()}) for e, t in rows))

    def run():
        stream = streaming.dedup(files.event_stream(spark, f"{tmp_path}/log"), "id").select("id")
        query = streaming.follow(stream, f"{tmp_path}/rows", f"{tmp_path}/check", every="1 second")
        query.processAllAvailable()
        query.stop()
        return sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/rows").collect())

    add("a", [("1", 0), ("2", 1), ("1", 2)])
    assert run() == ["1", "2"]
    add("b", [("2", 2), ("3", 3)])
    assert run() == ["1", "2", "3"]


def test_periodic_steps_and_artifacts_with_their_events(spark, tmp_path):
    seen = []
    query = streaming.periodic(spark, lambda s, number: seen.append(number), f"{tmp_path}/ticks", every="1 second")
    for _ in range(100):
        if len(seen) >= 2:
            break
        query.awaitTermination(1)
    query.stop()
    assert seen[:2] == [0, 1]
    sink = files.write_with_event(f"{tmp_path}/artifacts", f"{tmp_path}/events", "seo.completed")
    rows = spark.createDataFrame([(1, 7), (2, 8)], "artifact_id long, company_id long")
    for _ in range(2):
        sink(rows, 4)
    log = spark.read.parquet(f"{tmp_path}/events").collect()
    assert sorted((r["type"], r["artifact_id"], r["company_id"]) for r in log) == [("seo.completed", 1, 7), ("seo.completed", 2, 8)] and spark.read.parquet(f"{tmp_path}/artifacts").count() == 2


def test_stream_times_out(spark, tmp_path):
    stream = files.event_stream(spark, str(tmp_path))
    for name, rows in (("a", [("1", "x", "k", 0)]), ("b", [("2", "x", "far", 600)]), ("c", [("3", "x", "far2", 601)])):
        (tmp_path / f"{name}.json").write_text("\n".join(json.dumps({"id": e, "type": t, "correlation_id": k, "occurred_at": m(w).isoformat()}) for e, t, k, w in rows))
    q = streaming.fan_in(stream.withColumn("x", F.lit(1)), ["x", "y"]).writeStream.format("memory").queryName("timeouts").option("maxFilesPerTrigger", 1).start()
    q.processAllAvailable()
    (tmp_path / "d.json").write_text(json.dumps({"id": "4", "type": "x", "correlation_id": "far3", "occurred_at": m(602).isoformat()}))
    q.processAllAvailable()
    q.stop()
    assert ("k", m(10), True) in {tuple(r) for r in spark.table("timeouts").collect()}


def test_replay_goes_on_after_an_id(spark, tmp_path):
    """ULIDs sort as texts in the order of their time, across a change of their first characters too."""
    ulids = ["01HKABCDEFGHJKMNPQRSTVWXYZ", "01HKABCDEFGHJKMNPQRSTVWXZ0", "01HM0000000000000000000000", "01J00000000000000000000000"]
    for i, e in enumerate(reversed(ulids)):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": e, "type": "x" if i % 2 else "y", "occurred_at": m(len(ulids) - i).isoformat()}))
    log = files.replay(spark, str(tmp_path)).orderBy("id").collect()
    assert [r["id"] for r in log] == ulids and [r["occurred_at"] for r in log] == sorted(r["occurred_at"] for r in log)
    assert sorted(r["id"] for r in files.replay(spark, str(tmp_path), after=ulids[1]).collect()) == ulids[2:]
    assert [r["id"] for r in files.replay(spark, str(tmp_path), ulids[1], ["x"]).collect()] == ulids[2:3]


def test_write_batch_twice_is_once(spark, tmp_path):
    sink = files.write_batch(str(tmp_path / "out"))
    for batch in (0, 1, 1):
        sink(spark.range(3), batch)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_sources(spark, tmp_path):
    (tmp_path / "u.csv").write_text("url\nhttp://a.com\nhttp://b.com\n")
    (tmp_path / "u.json").write_text('["http://a.com", {"url": "http://b.com"}]')
    assert ids(files.url_list(spark, str(tmp_path / "u.csv")), "url") == ids(files.url_list(spark, str(tmp_path / "u.json")), "url") == ["http://a.com", "http://b.com"]
    (tmp_path / "r.yaml").write_text("- name: A\n  category: cms\n  signals:\n    - header: X-Y\n      regex: z\n    - html: q\n      weight: 0.2\n")
    assert [tuple(r) for r in files.rules(spark, str(tmp_path / "r.yaml")).collect()] == [("A", "cms", "header", "x-y", "z", 0.6), ("A", "cms", "html", None, "q", 0.2)]
    (tmp_path / "p.md").write_text("---\nname: email\nversion: 3\nmodel: flash\n---\n\nHello {{ name }}\n")
    row = files.front_matter(spark, str(tmp_path)).first()
    assert (row["name"], row["version"], row["model"], row["body"]) == ("email", 3, "flash", "Hello {{ name }}")
    assert files.submit_url(spark, "http://a.com", "2024-01-01 00:00:00").first()["type"] == "url.submitted"


def test_neighbours_by_blocks_without_broadcast(spark, monkeypatch):
    v = tables.table(spark, SF, "embeddings")
    odd = spark.createDataFrame([(90001, None, 1), (90002, [0.0] * 64, 1), (90003, [float("nan")] * 64, 2), (90004, [1.0], 3), (None, [0.5] * 64, 1)], "vec_id long, embedding array<float>, label int")
    v = v.unionByName(odd)
    q = v.filter("vec_id % 100 = 0")
    whole = {tuple(r) for r in retrieval.neighbours(v, q).collect()}
    monkeypatch.setattr(retrieval, "BLOCK", 37)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {tuple(r) for r in retrieval.neighbours(v, q).collect()} == whole and len(whole) == 5 * q.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_percentiles_are_exact(spark):
    rng = random.Random(1)
    rows = [("a", float(rng.randrange(50))) for _ in range(500)] + [("b", rng.gauss(0, 1)) for _ in range(801)] + [("c", 3.0), ("d", None)]
    rows += [("e", 1.0)] * 300 + [("e", 2.0)]
    got = cost.percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()
    for r in got:
        have = sorted(v for k, v in rows if k == r["k"])
        for name, p in (("p0", 0.0), ("p50", 0.5), ("p95", 0.95), ("p100", 1.0)):
            at_ = p * (len(have) - 1)
            low, high = have[int(at_)], have[-int(-at_ // 1)]
            assert abs(r[name] - (low + (at_ - int(at_)) * (high - low))) < 1e-3
    assert {r["k"] for r in got} == {"a", "b", "c", "e"}


def test_types_of_json_ld_wherever_they_stand(spark):
    html = """<script type="application/ld+json">{"@graph": [{"@type": ["Dentist", "Thing"]}, {"@type": "WebSite"}]}</script><script type="application/ld+json">[{"@type": "Person"}]</script>"""
    assert spark.range(1).select(text.json_ld_types(F.lit(html)).alias("t")).first()["t"] == ["Dentist", "Person", "Thing", "WebSite"]


def test_no_folder_of_one_machine_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.sql.warehouse.dir": "file:/opt/warehouse"}.get(key, default))

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(Cluster)
    Cluster.conf.get = staticmethod(lambda key, default=None: {"spark.sql.warehouse.dir": "hdfs://n/warehouse/"}.get(key, default))
    assert session.shared_folder(Cluster) == "hdfs://n/warehouse/_scratch"


def test_the_package_is_packed_whole():
    names = zipfile.ZipFile(io.BytesIO(session.packed(pathlib.Path(session.__file__).parent.parent))).namelist()
    assert {"fieldnotes/__init__.py", "fieldnotes/session.py", "fieldnotes/plans/flows.py"} <= set(names)


def test_costs_around_midnight_and_null_company(spark):
    rows = [(1, None, m(719), 1.0), (1, None, m(720), 2.0), (1, 5, m(0), 4.0)]
    calls = spark.createDataFrame(rows, "tenant_id long, company_id long, occurred_at timestamp, cost_usd double").withColumns({"input_tokens": F.lit(1), "output_tokens": F.lit(1)})
    assert sorted((r["company_id"] or 0, r["day"].day, r["cost_usd"]) for r in cost.cost_daily(calls).collect()) == [(0, 1, 1.0), (0, 2, 2.0), (5, 1, 4.0)]


def test_sequencer_waits_for_hours(spark):
    steps = spark.createDataFrame([(1, "active", 0, "email", m(-60), True), (1, "active", 1, "email", m(-30), False), (2, "paused", 0, "email", m(-60), False)], "sequence_id long, status string, step_index long, channel string, scheduled_for timestamp, sent boolean")
    assert [(r["sequence_id"], r["step_index"]) for r in sequencer.due(steps, at(0)).collect()] == [(1, 1)]
    assert not sequencer.due(steps, at(60 * 6)).collect()  # 22:00 in the zone


def test_validators_at_their_bounds(spark):
    got = {r["draft_id"]: r for r in validators.email_compliance(web.DRAFTS.df(spark)).collect()}
    assert got[1]["words"] == 120 and got[1]["ok"] and got[2]["words"] == 121 and not got[2]["ok"]
    assert got[3]["banned"].split(",") == ["i hope this email finds you well", "quick question", "synergy"]


def test_page_cursor_walks_all(spark):
    rows, after, seen = spark.range(10).withColumnRenamed("id", "k"), None, []
    while True:
        page = relational.page(rows, "k", after, 4).collect()
        seen += [r["k"] for r in page]
        after = page[-1]["next_cursor"]
        if after is None:
            break
    assert seen == list(range(10))


def test_literals():
    assert inline._literal(["a'b", None, True]) == "['a''b', NULL, TRUE]" and costs.AS_OF
