"""What scoring costs: words beyond the table aren't stored by a lexicon, are dealt by key once, and those that
occur once meet no count."""

import math

import numpy as np
import pytest
from test_lmscore import naive

from fieldnotes.llm import lmscore


def test_a_lexicon_does_not_grow_by_the_words_it_meets():
    own = {f"o{i}": i for i in range(lmscore.OWN)}
    known = lmscore.Vocabulary(own, dict.fromkeys(own, 0.0) | {"known": -1.5}, [0.0] * lmscore.OWN + [-2.0 - i for i in range(lmscore.SHARED)], [0.0] * lmscore.SHARED)
    lexicon = lmscore.Lexicon(known)
    before = len(lexicon)
    classes, share = lexicon.read(["o3", "known", "\ud800", *(f"new{i}" for i in range(5000))])
    assert len(lexicon) == before == len(known.share)
    assert classes[0] == 3 and all(classes[1:] >= lmscore.OWN)
    assert math.isclose(share, -1.5 + sum(known.rare[c] for c in classes[2:]))


def test_words_that_occur_once_are_dealt_once_and_meet_no_count(spark, tmp_path, monkeypatch):
    common = [f"c{i}" for i in range(lmscore.OWN)]
    rows = [(i, " ".join(common + [f"once{i}x{j}" for j in range(3 * i)])) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    whole = lmscore.vocabulary(docs)
    kept = {}
    monkeypatch.setattr(lmscore, "TABLE", lmscore.OWN)
    monkeypatch.setattr(lmscore, "train", lambda codes, f=lmscore.train: kept.setdefault("net", f(codes)))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lmscore.op8_lm_scoring(spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r["doc_id"]: r["log_prob"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange hashpartitioning") == 4  # words, counts, sums of texts, scores of texts
    assert "> 1)" in plan
    assert len(got) == len(rows)
    for i, text in rows:
        assert math.isclose(got[i], naive(kept["net"], whole, text.split()), rel_tol=1e-4)


@pytest.mark.parametrize("scale", [0.5, 2.3, 30.0])
def test_a_step_is_the_gradient_for_small_and_large_weights(scale):
    rng = np.random.default_rng(8)
    net = lmscore.Network(rng.normal(0, 0.3, lmscore.parameters()))
    net.last[:] = rng.uniform(-scale, scale, net.last.shape)
    near, token = rng.integers(0, lmscore.CLASSES, (40, 2 * lmscore.SIDE)), rng.integers(0, lmscore.CLASSES, 40)
    was = lmscore.Network(net.flat)
    net.learn(near, token, 0.1)
    x = was.embed.astype(np.float64)[near].reshape(40, -1)
    t = np.tanh(x @ was.join + was.offset)
    z = t @ was.out.astype(np.float64) + was.prior
    p = np.exp(z - z.max(axis=1)[:, None])
    d = (np.eye(lmscore.CLASSES)[token] - p / p.sum(axis=1)[:, None]) * 0.1 / 40
    dh = d @ was.out.T * (1 - t * t)
    embed = was.embed.astype(np.float64)
    np.add.at(embed, near, (dh @ was.join.T).reshape(40, 2 * lmscore.SIDE, lmscore.DIM))
    tolerance = 1e-5 * max(1, scale)
    for got, want in ((net.out, was.out + t.T @ d), (net.prior, was.prior + d.sum(axis=0)), (net.join, was.join + x.T @ dh), (net.offset, was.offset + dh.sum(axis=0)), (net.embed, embed)):
        assert np.allclose(got, want, atol=tolerance)
