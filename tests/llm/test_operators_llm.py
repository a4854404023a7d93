"""The operators against brute force, their SQL, held-out rows, and on awkward input."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from oracle import SMALL, check, connect
from pyspark.sql import functions as F

from fieldnotes.llm import decontaminate, graphs, langid, licenses, linededup, lmscore, mixing, pii, queries, simhash, topk, toxicity
from fieldnotes.llm.common import small_batches

MID = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = ("lorem ipsum dolor " * 60_000).strip()
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "one", "en", "b", 3),
    (4, "one", "en", "b", 3),
    (5, "12345 !!", "en", "b", 8),
    (6, "The weather of the town is mild and the river runs slowly past the old mill\nagain", "en", "a", 80),
    (7, "The weather of the town is mild and the river runs slowly past the old mill\nagain", None, None, 80),
    (None, "no id \U0001f600 here", "en", None, 12),
    (8, LONG, "en", "c", len(LONG)),
]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


CLASHES = (
    "mix mix_source leak leak_row leak_hits copy language gone gone_id gone_row gone_key gone_parts known license_key license_row licenses drop_id drop_spot "
    "candidates spans toxicity lm h1 key node text_ spot row"
).split()


@pytest.fixture
def awkward(spark):
    """Nulls, blanks, long texts, repeated rows and columns whose names clash."""
    df = spark.createDataFrame(AWKWARD, DOCS)
    for name in CLASHES:
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, con, name):
    check(con, queries.QUERIES[name](spark, SMALL), queries.oracle_sql()[name])


# -- 1 top-k ----------------------------------------------------------------------------------
def brute_top(rows, every=50, k=5):
    good = {(i, tuple(math.floor(256 * float(v)) for v in x)) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)}
    out = set()
    for q, qx in good:
        if q % every:
            continue
        scored = sorted({(-sum(a * b for a, b in zip(qx, x, strict=True)), i) for i, x in good if i != q and len(x) == len(qx)})
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("dim,n,threshold", [(3, 30, None), (16, 400, None), (16, 400, "-1")])
def test_topk_is_exact(spark, monkeypatch, dim, n, threshold):
    if threshold:  # no broadcast, and many blocks
        monkeypatch.setattr(topk, "BLOCK", 16)
        monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    rng = random.Random(dim)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(dim)]) for i in range(n)]
    rows += [(n + 1, None), (n + 2, [None] * dim), (n + 3, [float("nan")] * dim), (n + 4, [float("inf")] * dim), (None, [0.5] * dim), rows[7], rows[0], (n + 5, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows32 = [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x]) for i, x in rows]
    try:
        got = topk.top_k(df, df.filter("vec_id % 50 = 0")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {tuple(r) for r in got} == brute_top(rows32) and len(got) == len({tuple(r) for r in got})


def test_topk_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, none).collect() == []


@pytest.mark.parametrize("dense", [0.0, 0.02, 1.0])
def test_impact_index_stops_early_and_right(monkeypatch, dense):
    monkeypatch.setattr(topk, "DENSE", dense)
    rng = np.random.default_rng(1)
    x = (rng.normal(0, 40, (500, 8)) * (rng.random((500, 1)) > 0.9) + rng.normal(0, 1, (500, 8))).astype(np.int64)
    index = topk.ImpactIndex(np.arange(500), x)
    rows, ids, score = index.search(np.arange(5), x[:5], rescore=20)
    for q in range(5):
        want = sorted((-int(x[q] @ x[i]), i) for i in range(500) if i != q)[:5]
        assert [(-s, i) for s, i in zip(score[rows == q], ids[rows == q], strict=True)] == want


# -- 2 mixing ---------------------------------------------------------------------------------
def test_mix_meets_targets_and_bounds(spark):
    rows = spark.createDataFrame([(i, "w " * (1 + i % 7), None, s, 0) for i, s in enumerate(itertools.chain(["a"] * 900, ["b"] * 300, ["c"] * 60, [None] * 40))], DOCS)
    got = mixing.mix(rows).select("source", "mix.*").collect()
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        by[r["source"]][0] += r["size"]
        by[r["source"]][1] += r["taken"]
        by[r["source"]][2] = r["target"]
    assert math.isclose(sum(t for _, _, t in by.values()), sum(s for s, _, _ in by.values()))
    for size, taken, target in by.values():
        assert target <= 3 * size and abs(taken - target) < 0.15 * target
    assert by[None][2] == 3 * by[None][0]
    assert mixing.emit(mixing.mix(rows)).count() == sum(r["copies"] for r in got)


# -- 4 decontamination ------------------------------------------------------------------------
def brute_leaks(text, items):
    words = [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]
    hit, found = set(), set()
    for name, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), item or ""))
        n = min(10, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found |= set() if name is None else {str(name)}
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("bits", [decontaminate.BITMAP, 8])
def test_leaks_equal_brute_force_also_joined(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "BITMAP", bits)
    rng = random.Random(5)
    vocab = ["a", "b", "c", "É", "d9"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 7, 9, 10, 12, 25])))) for i in range(25)] + [(90, None), (91, ""), (92, "..."), (None, "x1 x2 x3"), (None, " ".join(f"y{i}" for i in range(11)))]
    texts = [" ".join(rng.choice(vocab).upper() for _ in range(rng.randrange(60))) + ", " + rng.choice(items[:25])[1] for _ in range(40)] + [None, "", "\t", "X1 x2, x3 d9", " ".join(f"y{i}" for i in range(10)), "same", "same"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_leaks(t, items) for i, t in enumerate(texts)}
    for size in (decontaminate.SLICE_BYTES, 150):
        got = decontaminate.contamination(docs, bench, size).select("doc_id", "leak.*").collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in got} == want and len(got) == len(want)
        for r in got:
            assert all(a["hi"] < b["lo"] for a, b in itertools.pairwise(r["hits"]))


def test_every_shared_span_shares_a_fingerprint():
    rng = np.random.default_rng(2)
    for _ in range(200):
        span = rng.integers(1, 40, 10)
        a, b = (np.concatenate([rng.integers(1, 40, rng.integers(0, 30)), span, rng.integers(1, 40, rng.integers(0, 30))]) for _ in range(2))
        ha, hb = (set(decontaminate._roll(x, 5)[decontaminate.winnow(x)].tolist()) for x in (a, b))
        assert ha & hb


# -- 5 personal data --------------------------------------------------------------------------
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if ok(k, m.group())]


PII = [
    "mail a@b.co, a@b@c.de x._y@z-1.q.w. a@b..c é a@b.c_x@d.e.f",
    "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255 12.3.4 1..2.3.4 000000000000000000000000000000000000000000001.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 79927398713 4000 0000 0000 0000 006",
    "+1 (736) 555-2678 +49 30 123456.. +1+2 345 678 90 +12 +1 2345678",
    "\U0001f600é a@b.c \U0001f600 9.9.9.9",
    "",
    None,
    "1" * 30_000,
    "a" * 200_000,
    "a.b@" + "c." * 20_000 + "d",
    "+1" + " 2" * 20_000,
]


def test_base_spans_equal_plain_patterns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PII)], "doc_id long, text string")
    found = pii.find(df).select("doc_id", pii.listed(F.filter("spans", lambda s: s["base"])).alias("base"), pii.listed(F.col("spans")).alias("all")).collect()
    for r in found:
        want = brute_pii(PII[r["doc_id"]])
        assert r["base"] == ",".join(want)
        assert set(want) <= set(r["all"].split(",")) | {""}


def test_pii_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in pii.op5_pii(spark, SMALL).collect():
        want = brute_pii(texts[r["doc_id"]])
        kinds = collections.Counter(w.split(":")[0] for w in want)
        assert tuple(r[f"n_{k}"] for k in pii.KINDS) == tuple(kinds[k] for k in pii.KINDS)
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()


def test_the_method_adds_spans_that_labelers_agree_on(spark):
    rows = [(i, f"write to anna.{i} (at) shop (dot) com or call ({212 + i}) 555-0{100 + i}, thanks") for i in range(30)] + [(99, "version 123 456 7890x of token=4111111111111112")]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()
    assert all(r["s"].startswith("email:9:") and "phone:" in r["s"] for r in found if r["doc_id"] < 30)
    assert [r["s"] for r in found if r["doc_id"] == 99] == [""]


def test_em_ranks_labelers_by_agreement():
    votes = {}
    for kind in range(4):
        for v, n in {(1, 1, 1, 1): 50, (-1, -1, -1, -1): 50, (1, 1, -1, 1): 20, (-1, -1, 1, -1): 20}.items():
            votes[kind, v, (0, 0)] = n
    model = pii.Classifier(votes)
    assert model.hit[2] < model.hit[0] and model.pass_[2] < model.pass_[0] and model.weight[2] < model.weight[0]


def test_the_classifier_learns_from_marks_what_no_labeler_says():
    agreed = {(3, (0, 1, 1, 1), (2, 1)): 80, (3, (0, -1, -1, -1), (1, 0)): 80}
    model = pii.Classifier(agreed | {(3, (0, 0, 0, 0), (2, 1)): 5, (3, (0, 0, 0, 0), (1, 0)): 5})
    z = lambda digits, parted: model.offset[3] + model.digits[3][digits] + model.parted[3] * parted
    assert z(2, 1) > z(1, 0)


def test_added_spans_do_not_overlap_and_compressed_addresses_are_found(spark):
    rows = [(i, f"server address 2001:db8::{i:x} and fe80::1:2 of the host, card 4111 1111 1111 111{2 + i % 7} payment", "kept", "kept") for i in range(40)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string, candidates string, spans string"), into="found").collect()
    assert all(r["candidates"] == r["spans"] == "kept" for r in found)
    for r in found:
        spans = sorted((s["start"], s["end"]) for s in r["found"])
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans)) and (15, 26 if int(r["doc_id"]) < 16 else 27) in spans


# -- 6 licences -------------------------------------------------------------------------------
def test_whole_texts_and_equivalents(spark, monkeypatch):
    mit = next(t for n, t in licenses.NOTICES if n == "MIT" and len(t) > 200)
    docs = spark.createDataFrame(
        [(1, mit, "x"), (2, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(",", " ,"), "x"), (3, mit + " and more", "x"), (4, None, "x"), (5, "", "x"), (6, "intro\nlicenced under the apache licence, version 2.0\nReleased under the MIT License!", "x")],
        "doc_id long, text string, known string",
    )
    rows = {r["doc_id"]: r for r in licenses.scan(docs, licenses.catalogue(spark)).select("doc_id", "known", "licenses.*").collect()}
    assert [rows[i]["whole"] for i in range(1, 7)] == ["MIT", "MIT", None, None, None, None]
    assert rows[6]["lines"] == ["Apache-2.0", "MIT"] and rows[6]["n_lines"] == 2 and rows[4]["digest"] is None and rows[1]["known"] == "x"
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    assert {r["doc_id"]: r for r in licenses.scan(docs, licenses.catalogue(spark)).select("doc_id", "known", "licenses.*").collect()} == rows


# -- 8 pseudo-likelihood ----------------------------------------------------------------------
def test_order_matters_and_pieces_add_up(spark, monkeypatch):
    small_batches(spark)
    rng = random.Random(1)
    line = "the cat sat on the mat and the dog ran to the barn while a bird sang in the tree"
    rows = [(i, " ".join([line] * rng.randrange(3, 9))) for i in range(300)]
    shuffled = line.split() * 5
    rng.shuffle(shuffled)
    docs = spark.createDataFrame([*rows, (900, " ".join([line] * 5)), (901, " ".join(shuffled)), (902, None), (903, " \n")], "doc_id long, text string")
    own = lmscore.vocabulary(docs)
    net = lmscore.train(lmscore.encoded(docs, own), rounds=2, one_in=2)
    score = {r["doc_id"]: (r["n_tokens"], r["log_prob"]) for r in lmscore.lm_score(docs, net, own).select("doc_id", "lm.*").filter("doc_id >= 900").collect()}
    assert score[900][1] > score[901][1] + 20 and score[902] == score[903] == (0, 0.0)
    codes = lmscore.encoded(docs.filter("doc_id >= 900"), own)
    for r in lmscore.scored(codes, net).collect():
        assert r["lm"]["n_tokens"] == score[r["doc_id"]][0] and math.isclose(r["lm"]["log_prob"], score[r["doc_id"]][1], rel_tol=1e-4)
    monkeypatch.setattr(lmscore, "STEP", 7)
    again = {r["doc_id"]: r["log_prob"] for r in lmscore.lm_score(docs, net, own).select("doc_id", "lm.*").filter("doc_id >= 900").collect()}
    assert all(math.isclose(again[k], score[k][1], rel_tol=1e-3) for k in again)


def test_network_gradient():
    net = lmscore.Network(seed=1)
    rng = np.random.default_rng(0)
    near, token = rng.integers(0, lmscore.CLASSES, (64, 4)), rng.integers(0, lmscore.CLASSES, 64)
    loss = lambda n: float(n.forward(near)[np.arange(64), token].mean())
    before = loss(net)
    for _ in range(40):
        net.learn(near, token)
    assert loss(net) > before + 0.5


# -- 9 SimHash --------------------------------------------------------------------------------
def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 2:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def test_fingerprints_and_components_of_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    parts = brute_components(prints)
    got = simhash.op9_simhash(spark, SMALL).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{p:016x}", parts[i]) for i, p in prints.items()}


def test_xxh64_is_sparks_own(spark):
    for s in ("", "a b c", "é" * 50):
        assert spark.range(1).select(F.xxhash64(F.lit(s)).alias("h")).first()["h"] & (2**64 - 1) == xxhash.xxh64_intdigest(s.encode(), 42)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1])
def test_links_lose_nothing_in_small_or_full_buckets(spark, bucket):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = {}
    for i in range(160):
        x = rng.choice(centres)
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        prints[i] = x
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(x)) for i, x in prints.items()], "doc_id long, fp long")
    got = df.join(simhash.near_duplicates(df, bucket), "fp").select("doc_id", "component_id").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(prints)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(300, 200), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in graphs.components(edges).collect()}
    assert got == {**dict.fromkeys(range(101), 0), 200: 200, 300: 200}


# -- 10 language ------------------------------------------------------------------------------
def test_held_out_accuracy(spark):
    rows = langid.op10_langid(spark, MID).join(spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.98


def test_trees_are_distributions_and_pieces_add_up(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")] * 20)], DOCS)
    trees = langid.train(docs)
    p = np.exp2(-trees.cost.reshape(-1, trees.m, len(trees.langs)))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    text = langid.symbols_of("the table is on the cat " * 50)
    whole = trees.lengths([text])
    monkeypatch.setattr(langid, "_PIECE", 13)
    assert np.allclose(trees.lengths([text]), whole, rtol=1e-5)


# -- all: awkward input -----------------------------------------------------------------------
def test_awkward_rows_keep_their_columns(spark, awkward, monkeypatch):
    small_batches(spark)
    rows = lambda df, names: sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    every, kept = awkward.columns, [c for c in awkward.columns if c not in ("text", "n_chars")]
    bench = spark.createDataFrame([(1, "river runs slowly past the old mill again"), (None, "x"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)] + [(None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    own = lmscore.vocabulary(awkward)
    for out in (
        mixing.mix(awkward, into="found"),
        decontaminate.contamination(awkward, bench, into="found"),
        decontaminate.contamination(awkward, bench, slice_bytes=1, into="found"),
        toxicity.toxicity(awkward, toxicity.train(awkward, labels), into="found"),
        toxicity.toxicity(awkward, None, into="found"),
        pii.find(awkward, into="found"),
        licenses.scan(awkward, licenses.catalogue(spark), into="found"),
        lmscore.lm_score(awkward, lmscore.train(lmscore.encoded(awkward, own)), own, into="found"),
        langid.identify(awkward, langid.train(awkward), into="found"),
        langid.identify(awkward, None, into="found"),
    ):
        assert set(out.columns) == {*every, "found"} and rows(out, every) == rows(awkward, every)
    out = linededup.dedup_lines(awkward)
    assert out.columns == every and rows(out, kept) == rows(awkward, kept)
    found = langid.identify(awkward, langid.train(awkward), "tongue").select("doc_id", "tongue.*").collect()
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und"} == {1, 2, 3, 5}
    kept = simhash.keep_one(awkward)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 4, 5, 6, 8] and kept.columns == every
    assert set(map(repr, rows(kept, every))) <= set(map(repr, rows(awkward, every)))
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    out = licenses.scan(awkward, licenses.catalogue(spark), into="found")
    assert set(out.columns) == {*every, "found"} and rows(out, every) == rows(awkward, every)


def test_empty_tables(spark):
    small_batches(spark)
    docs, labels, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string")
    own = lmscore.vocabulary(docs)
    prints = simhash.fingerprints(docs)
    for out in (
        mixing.mix(docs),
        mixing.emit(mixing.mix(docs)),
        decontaminate.contamination(docs, bench),
        toxicity.toxicity(docs, toxicity.train(docs, labels)),
        pii.find(docs),
        licenses.scan(docs, licenses.catalogue(spark)),
        linededup.dedup_lines(docs),
        lmscore.lm_score(docs, lmscore.train(lmscore.encoded(docs, own)), own),
        simhash.near_duplicates(prints),
        simhash.keep_one(docs),
        langid.identify(docs, langid.train(docs)),
    ):
        assert out.collect() == []
