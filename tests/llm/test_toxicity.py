"""The chain against enumeration of all tags, its likelihood and gradient, the query, held-out rows."""

import itertools
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from fieldnotes.llm import toxicity

MID = "/root/testdata/sf0.1"


def weights(emit, trans):
    """The unnormalised weight of every sequence of tags."""
    n = len(emit)
    return {y: math.exp(sum(e * t for e, t in zip(emit, y, strict=True)) + sum(trans[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=n)}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(2, 5)), rng.normal(size=(2, 2))
    mask = np.array([[True] * 5, [True] * 3 + [False] * 2])
    marg, pairs, log_z = toxicity.forward_backward(emit, trans, mask)
    for k, n in ((0, 5), (1, 3)):
        w = weights(emit[k, :n], trans)
        z = sum(w.values())
        assert math.isclose(log_z[k], math.log(z), rel_tol=1e-9)
        for i in range(n):
            assert math.isclose(marg[k, i], sum(x for y, x in w.items() if y[i]) / z, rel_tol=1e-9)
        for i in range(n - 1):
            for a, b in itertools.product((0, 1), repeat=2):
                assert math.isclose(pairs[k, i, a, b], sum(x for y, x in w.items() if y[i : i + 2] == (a, b)) / z, rel_tol=1e-9)


def test_likelihood_is_of_labelled_documents_and_has_that_gradient():
    windows = pd.DataFrame(
        [("a", 1, 4, [0, 0, 2], [0, 1, 2]), ("a", 1, 2, [1], [0]), ("b", 0, 3, [1], [1]), ("c", 1, 1, [0], [2]), ("d", 0, 5, [], [])],
        columns=["doc", "toxic", "length", "at", "feature"],
    )
    chains, rng = toxicity.Chains(windows, 3), np.random.default_rng(4)
    params = rng.normal(0, 1, 8)
    want, trans = 0.0, params[4:].reshape(2, 2)
    for _, rows in windows.groupby("doc"):
        clean = 1.0
        for r in rows.itertuples():
            emit = [params[3] + sum(params[f] for a, f in zip(r.at, r.feature, strict=True) if a == i) for i in range(r.length)]
            w = weights(emit, trans)
            clean *= w[(0,) * r.length] / sum(w.values())
        want += math.log(1 - clean) if rows["toxic"].iloc[0] else math.log(clean)
    value, grad = chains.likelihood(params)
    assert math.isclose(value, want, rel_tol=1e-9)
    for i in range(8):
        step = np.eye(8)[i] * 1e-5
        assert math.isclose(grad[i], (chains.likelihood(params + step)[0] - chains.likelihood(params - step)[0]) / 2e-5, rel_tol=1e-5, abs_tol=1e-7)


def toy():
    rng = random.Random(3)
    words = ["river", "town", "mill", "road", "hill", "green", "stone"]
    rows = []
    for i in range(400):
        t = [rng.choice(words) + rng.choice("abcdefgh") for _ in range(30)]
        if i % 4 == 0:
            t[rng.randrange(30)] = "zork" + rng.choice("abcdefgh")
            t[rng.randrange(30)] = "blargh"
        rows.append((i, " ".join(t), int(i % 4 == 0)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = toy()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(3, None), (900, None), (None, "blargh")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(4, None), (None, 1), (5, 7), (7777, 1)], "doc_id long, toxic int")
    return toxicity.train(docs, labels)


def naive(crf, text):
    """Marginals over the whole chain, a potential for every token from all its features."""
    words = toxicity.words_of(text)
    if not words:
        return [], 0.0, 0.0
    emit = np.array([[crf.bias + sum(crf.table.get(f, 0.0) for f in toxicity.features_at(words, i)) for i in range(len(words))]])
    marg = toxicity.forward_backward(emit, crf.trans, np.ones_like(emit, bool))[0][0]
    spots = [(m.start(), m.end(), marg[i]) for i, m in enumerate(toxicity._TOKEN.finditer(text)) if any(f in crf.table for f in toxicity.features_at(words, i))]
    return spots, max((p for *_, p in spots), default=0.0), sum(p for *_, p in spots)


def test_jumps_over_plain_tokens_change_nothing(trained):
    assert any(f == "blargh" for f in trained.table) and any(f.startswith("zor") for f in trained.table)
    more = toxicity.Crf(trained.table | {"<blargh": 0.3, ">zorkq": -0.4, "<towna": 1.0}, trained.bias, np.array([[0.2, -0.3], [0.1, 0.5]]), trained.curve)
    rng = random.Random(5)
    for crf in (trained, more):
        for text in ["river town blargh mill " + "hilla " * 50 + "zorkq zorkb stone", "blargh", "towna", "blargh blargh towna zorkq", "", "12 !"] + [" ".join(rng.choice(["hilla", "blargh", "zorkq", "towna", "x"]) for _ in range(12)) for _ in range(20)]:
            spots, top, total = crf.tag(text)
            want, want_top, want_total = naive(crf, text)
            assert [s[:2] for s in spots] == [s[:2] for s in want]
            assert np.allclose([s[2] for s in spots], [s[2] for s in want], atol=1e-6) and math.isclose(top, want_top, abs_tol=1e-6) and math.isclose(total, want_total, abs_tol=1e-5)


def test_spans_are_the_toxic_tokens(trained):
    text = "rivera towna blargh milla zorkh hilla"
    spots, top, total = trained.tag(text)
    assert [text[s:e] for s, e, p in spots if p >= 0.5] == ["blargh", "zorkh"]
    assert trained.score(top, total) > 0.9 > 0.1 > trained.score(*trained.tag("rivera towna milla")[1:])


def test_query_equals_a_naive_chain(spark, tmp_path, monkeypatch):
    rows = [*toy(), (1000, "a blargh \U0001f600 zorka", 1), (1001, None, 1), (1002, "", 0), (1002, "", 0)]
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    monkeypatch.setattr(toxicity, "train", lambda d, x, f=toxicity.train: kept.setdefault("crf", f(d, x)))
    got = toxicity.op3_toxicity(spark, str(tmp_path)).collect()
    crf, texts = kept["crf"], {i: t for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        spots, top, total = naive(crf, texts[r["doc_id"]] or "")
        assert math.isclose(r["score"], crf.score(top, total), abs_tol=1e-6) and r["predicted"] == int(r["score"] >= 0.3)
        assert r["spans"] == ",".join(f"{s}:{e}" for s, e, p in spots if p >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    hit = {r["doc_id"]: r["predicted"] for r in got if r["held_out"] and r["doc_id"] < 400}
    assert all(hit[i] == int(i % 4 == 0) for i in hit)


def test_without_both_labels_all_scores_are_0(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert toxicity.train(docs, spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, toxic int")) is None
    assert [r["toxicity"]["score"] for r in toxicity.toxicity(docs, None).collect()] == [0.0, 0.0]


def test_held_out_rows(spark):
    rows = toxicity.op3_toxicity(spark, MID).join(spark.read.parquet(f"{MID}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    hit, toxic, said = (sum(f(r) for r in rows) for f in (lambda r: r["predicted"] and r["toxic"], lambda r: r["toxic"], lambda r: r["predicted"]))
    print("held out", hit, toxic, said, len(rows))
    assert hit / toxic > 0.9 and hit / said > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_blocks_of_documents_change_nothing(monkeypatch):
    rng = random.Random(8)
    rows = [(f"d{rng.randrange(40)}", rng.randint(3, 9)) for _ in range(200)]
    rows = [(d, int(d[-1] in "13"), n, [i for i in range(n) if rng.random() < 0.3]) for d, n in rows]
    windows = pd.DataFrame([(*r, [rng.randrange(5) for _ in r[3]]) for r in rows], columns=["doc", "toxic", "length", "at", "feature"])
    params = np.random.default_rng(2).normal(size=10)
    whole = toxicity.Chains(windows, 5)
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    split = toxicity.Chains(windows, 5)
    assert len(whole.blocks) == 1 and len(split.blocks) > 5 and split.blocks[-1][1] == len(whole.toxic) and split.blocks[-1][3] == 200
    (a, ga), (b, gb) = whole.likelihood(params), split.likelihood(params)
    assert math.isclose(a, b, rel_tol=1e-12) and np.allclose(ga, gb, rtol=1e-9)


def test_the_prior_is_chosen_without_held_out_rows(spark):
    rows = toy()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    same = [[(i, 1 - y if turned and zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows] for turned in (False, True)]
    got = [toxicity.choose_prior(docs, spark.createDataFrame(x, "doc_id long, toxic int"), (1.0, 100.0), folds=2) for x in same]
    assert got[0] == got[1] and list(got[0]) == [1.0, 100.0] and max(got[0].values()) < 0.3
