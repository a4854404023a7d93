"""The language model gives every word its own probability, and learns from every text."""

import collections
import math
import random
import zlib

import numpy as np
from test_operators_llm import DOCS

from fieldnotes.llm import lmscore


def test_shares_of_a_class_sum_to_one(spark):
    rng = np.random.default_rng(6)
    words = [f"w{int(k)}" for k in rng.zipf(1.3, 6000) % 3000]
    docs = spark.createDataFrame([(i, " ".join(words[i::20]), "en", "a", 0) for i in range(20)], DOCS)
    known = lmscore.vocabulary(docs, table=400)
    mass = np.zeros(lmscore.CLASSES)
    lexicon = lmscore.Lexicon(known)
    for w in set(words):
        c, share = lexicon.read([w])
        mass[c[0]] += np.exp(share)
    assert np.allclose(mass[mass > 0], 1) and (mass > 0).sum() > lmscore.OWN
    rare, common = (sorted(known.share, key=known.share.get)[k] for k in (0, -lmscore.OWN - 1))
    two = spark.createDataFrame([(0, rare, "en", "a", 0), (1, common, "en", "a", 0)], DOCS)
    got = {r["doc_id"]: r["lm"]["log_prob"] for r in lmscore.lm_score(two, lmscore.Network(np.zeros(lmscore.parameters())), known).collect()}
    assert got[0] < got[1]


def test_every_text_is_learned_from(spark):
    start = lmscore.Network().flat
    for i in range(6):
        docs = spark.createDataFrame([(i, f"only text number {i} of the corpus", "en", "a", 0)], DOCS)
        assert not np.array_equal(lmscore.train(lmscore.encoded(docs, lmscore.vocabulary(docs))).flat, start)


def naive(net, known, words):
    """Sum of the conditional log-probabilities, word by word."""
    kind = lambda w: known.own[w] if w in known.own else lmscore.OWN + zlib.crc32(w.encode()) % lmscore.SHARED
    total = 0.0
    for i, w in enumerate(words):
        near = [kind(words[j]) if 0 <= j < len(words) else lmscore.PAD for j in (i - 2, i - 1, i + 1, i + 2)]
        x = np.concatenate([net.embed[k] for k in near]).astype(np.float64)
        z = np.tanh(x @ net.join + net.offset) @ net.out + net.prior
        total += z[kind(w)] - math.log(np.exp(z).sum()) + known.share.get(w, known.rare[kind(w)])
    return total


def test_scores_equal_a_naive_model_of_counts_and_network(spark, tmp_path, monkeypatch):
    """The query, against counts and a network evaluated in plain Python from the same parameters."""
    rng = random.Random(2)
    vocab = [f"w{int(300 * rng.random() ** 3)}" for _ in range(900)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(60)))) for i in range(40)] + [(90, None), (91, " \t"), (92, "Twice twice"), (92, "Twice twice"), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    monkeypatch.setattr(lmscore, "train", lambda codes, f=lmscore.train: kept.setdefault("net", f(codes)))
    got = lmscore.op8_lm_scoring(spark, str(tmp_path)).collect()
    net = kept["net"]
    counts = collections.Counter(w for _, t in rows for w in (t or "").lower().split())
    top = sorted(counts, key=lambda w: (-counts[w], w))[: lmscore.OWN]
    known = lmscore.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"))
    assert known.own == {w: i for i, w in enumerate(top)}
    classes = collections.defaultdict(int)
    for w, n in counts.items():
        if w not in known.own:
            classes[zlib.crc32(w.encode()) % lmscore.SHARED] += n
    for w, n in counts.items():
        want = 0.0 if w in known.own else math.log(n / classes[zlib.crc32(w.encode()) % lmscore.SHARED])
        assert math.isclose(known.share[w], want, abs_tol=1e-9)
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append((t or "").lower().split())
    for r in got:
        words = texts[r["doc_id"]][0]
        assert r["n_tokens"] == len(words) and math.isclose(r["log_prob"], naive(net, known, words), rel_tol=1e-4, abs_tol=1e-6)
        assert (r["mean_log_prob"] is None) == (not words)
