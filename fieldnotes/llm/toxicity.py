"""Toxicity: a linear-chain conditional random field tags toxic spans.

The chain has two tags, clean and toxic.  A token's potential is the sum of the weights of its
features: the word, its prefixes of 3 to 6 characters, the word before it and the word after it;
transitions are learned too.

Documents carry only a label, and that is all the tokens get of it: every token of a clean document is
clean, and some token of a toxic document is toxic.  The chain maximises the probability of these
labelled sequences of tags, under a Gaussian prior: of the one clean sequence, and of all but the clean one.
Forward-backward gives both sums and the gradient.  Features are those that toxic documents use more
than chance allows for all features of their sort (near copies count once); the prior of words
and prefixes is around their log-odds, that of what stands beside a token around 0, so that context has to
earn its weight.

A document is scored from the marginals: their greatest and their sum (the expected number of
toxic tokens), mapped to a probability by a logistic curve fitted on the training documents.
Offending offsets are the spans of tokens whose marginal is at least one half.

Only features that lean to toxic carry a weight, so nearly all tokens of a text have the same
potential.  Between the others the chain is advanced by a power of one 2 x 2 matrix, taken from its
spectrum: exact, and linear in the few tokens that matter, however long the text.

Training is bounded by ``SAMPLE`` toxic and ``CLEAN * SAMPLE`` clean documents, the first by a hash of the
id, and takes their whole texts: these are kept in the shared folder and read by the executors, which give
the driver counts of features, windows of ``WIDTH`` tokens that have one (numbers, no text), and two
marginals a document.  There, marginals are computed for ``BLOCK`` windows at a time.  Scoring reads whole texts, in Arrow batches, without a shuffle.

Defined cases: null and empty texts score like a text without toxic tokens; repeated labels of a
document count once (the least), and so do repeated rows; labels of no document, null ids and other values
than 0 and 1 aren't learned from; without labels of both kinds every score is 0; very long texts are
tagged whole; other columns stay, and where ``into`` names one, it is replaced; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldnotes.llm import scratch
from fieldnotes.llm.common import fetched, held_out, read, small_batches, uniform

SAMPLE = 1500
#: Clean documents in the sample for each toxic one.
CLEAN = 3
THRESHOLD = 0.3
#: A feature must have this share of its uses, smoothed, in toxic documents, after balancing classes.
SHARE = 0.9
#: Toxic documents that must have a feature.
DOCS = 3
#: How far, in nats beyond the number of features tried, its uses must be from chance.
MARGIN = 3.0
#: A document counts for a feature by its uses, up to so many.
USES = 4
#: Tokens of a training chain.
WIDTH = 64
STEPS = 150
#: Windows whose marginals are held at once.
BLOCK = 4096
#: Weight of the prior, chosen by ``choose_prior`` from rows that may be learned from; and what a leaning word has beyond its log-odds.
PRIOR = 100.0
LEAN = 1.0
#: What ``choose_prior`` tries, and its folds.
PRIORS = (3.0, 10.0, 30.0, 100.0)
FOLDS = 2
CACHE = 400_000
_TOKEN = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return [m.group().lower() for m in _TOKEN.finditer(text or "")]


def features_of(word: str) -> list[str]:
    """The word itself and its prefixes; a prefix ends in ``*``."""
    return [word, *(word[:n] + "*" for n in range(3, 7) if len(word) > n)]


def features_at(words: list[str], i: int) -> list[str]:
    """All features of a token: its own, the word before it (``<``) and the word after it (``>``)."""
    beside = ["<" + words[i - 1]] if i else []
    return [*features_of(words[i]), *beside, *([">" + words[i + 1]] if i + 1 < len(words) else [])]


def min_hashes(words: list[str]) -> list[int]:
    """Three min-hashes of 3-word shingles.  Documents that agree in one are near copies: they would make
    any rare word look like a sign of their label."""
    shingles = {" ".join(words[i : i + 3]).encode() for i in range(max(1, len(words) - 2))}
    return [min(zlib.crc32(s, k) for s in shingles) for k in range(3)]


def uses_of(words: list[str]) -> Counter:
    """How often each feature occurs in a document, up to ``USES``."""
    out: Counter = Counter()
    for w, k in Counter(words).items():
        for f in features_of(w):
            out[f] += k
    for a, b in zip(words, words[1:], strict=False):
        out["<" + a] += 1
        out[">" + b] += 1
    return Counter({f: min(k, USES) for f, k in out.items()})


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def leaning(bad: dict[str, tuple[int, int, int]], good: dict[str, int], n_bad: int, n_good: int) -> dict[str, float]:
    """Features that lean to toxic, with the weights they start from.

    ``bad``: feature -> (uses in toxic documents, documents, uses of the word that makes up most of it);
    ``good``: feature -> uses in clean documents.
    """
    beside = sum(f[0] in "<>" for f in bad)
    base, chance = n_bad / (n_bad + n_good), [np.log(max(1, tried)) + MARGIN for tried in (len(bad) - beside, beside)]
    out = {}
    for f, (k, docs, most) in bad.items():
        g = good.get(f, 0)
        # a prefix must stand for several words: where one makes up most of it, the word will do
        if docs < DOCS or f.endswith("*") and 2 * most > k or (k / n_bad) / (k / n_bad + g / n_good) < SHARE:
            continue
        gain = k * np.log(k / (k + g) / base) + (g * np.log(g / (k + g) / (1 - base)) if g else 0.0)
        if gain * docs / k > chance[f[0] in "<>"]:  # uses within a document aren't independent
            out[f] = 0.0 if f[0] in "<>" else float(LEAN + np.log((k + 0.5) / n_bad) - np.log((g + 0.5) / n_good))
    return out


class Chains:
    """Training chains: windows of tokens by document, with the features active at each token.  They are
    summed in blocks of whole documents, so that marginals are held for one block alone."""

    def __init__(self, windows: pd.DataFrame, features: int):
        ids, doc = np.unique(windows["doc"].to_numpy(), return_inverse=True)
        order = np.argsort(doc, kind="stable")
        windows, self.doc = windows.iloc[order], doc[order]
        self.features, self.length = features, windows["length"].to_numpy(np.int64)
        self.width = int(self.length.max(initial=1))
        sizes = np.array([len(x) for x in windows["at"]], np.int64)
        flat = lambda c: np.concatenate([np.asarray(x, np.int32) for x in windows[c]]) if sizes.sum() else np.zeros(0, np.int32)
        self.at, self.cols, self.ends = flat("at"), flat("feature"), np.concatenate([[0], np.cumsum(sizes)])
        self.toxic = np.zeros(len(ids), bool)
        self.toxic[self.doc] = windows["toxic"].to_numpy(bool)
        firsts = np.searchsorted(self.doc, np.arange(len(ids) + 1))
        begins = np.flatnonzero(np.diff(firsts[:-1] // BLOCK, prepend=-1))
        self.blocks = [(lo, hi, firsts[lo], firsts[hi]) for lo, hi in zip(begins, [*begins[1:], len(ids)], strict=True)]

    def likelihood(self, params: np.ndarray) -> tuple[float, np.ndarray]:
        """Log-likelihood of the labelled documents and its gradient in the weights, the bias of the toxic
        tag and the transitions."""
        value, grad = 0.0, np.zeros(self.features + 5)
        for block in self.blocks:
            v, g = self._of_block(params, *block)
            value, grad = value + v, grad + g
        return value, grad

    def _of_block(self, params: np.ndarray, first: int, last: int, lo: int, hi: int) -> tuple[float, np.ndarray]:
        """The same of the documents from ``first`` to before ``last``, whose windows are ``lo`` to before ``hi``."""
        k, b, t = self.features, hi - lo, self.width
        length, doc, toxic = self.length[lo:hi], self.doc[lo:hi] - first, self.toxic[first:last]
        spots = slice(self.ends[lo], self.ends[hi])
        cols, rows = self.cols[spots], np.repeat(np.arange(b), np.diff(self.ends[lo : hi + 1])) * t + self.at[spots]
        mask = np.arange(t)[None, :] < length[:, None]
        trans = params[k + 1 :].reshape(2, 2)
        emit = np.bincount(rows, params[cols], b * t).reshape(b, t) + params[k]
        marg, pairs, log_z = forward_backward(emit, trans, mask)
        clean = np.bincount(doc, (length - 1) * trans[0, 0] - log_z, last - first)  # log P(no toxic token)
        clean = np.minimum(clean, -1e-9)
        log_any = np.log(-np.expm1(clean))
        # a toxic document's expectations given any toxic token, less those without that knowledge
        pull = np.where(toxic, np.exp(clean - log_any), -1.0)[doc]
        error = (marg * mask * pull[:, None]).ravel()
        both = (pairs * mask[:, 1:, None, None]).sum(axis=1)
        both[:, 0, 0] -= length - 1  # the clean sequence has only pairs of clean tags
        grad = np.concatenate([np.bincount(cols, error[rows], k), [error.sum()], (both * pull[:, None, None]).sum(axis=0).ravel()])
        return float(np.where(toxic, log_any, clean).sum()), grad

    def fit(self, start: np.ndarray, steps: int = STEPS, weight: float | None = None) -> np.ndarray:
        """Gradient ascent, with a Gaussian prior of that weight (``PRIOR``) around where the parameters start."""
        weight = PRIOR if weight is None else weight
        prior = np.concatenate([start, [-6.0], np.zeros(4)])
        params, grad2 = prior.copy(), np.zeros(len(prior))
        for i in range(steps):
            g = self.likelihood(params)[1] / len(self.toxic) * 100 - weight * (params - prior)
            grad2 = 0.9 * grad2 + 0.1 * g * g
            params = params + 0.1 / (1 + i / 50) * g / (np.sqrt(grad2) + 1e-3)
        return params


class Crf:
    """Weights of the chain.  Potentials are of the toxic tag against the clean one."""

    def __init__(self, weight: dict[str, float], bias: float, trans: np.ndarray, curve: np.ndarray | None = None):
        self.table, self.bias, self.trans = weight, bias, trans
        self.curve = np.zeros(3) if curve is None else curve
        step = np.exp(self.trans)
        step = step * np.array([1.0, np.exp(self.bias)])[None, :]  # from tag p to tag q of a plain token
        values, left = np.linalg.eig(step)
        order = np.argsort(-values.real)
        values, left = values.real[order], left.real[:, order]
        right = np.linalg.inv(left)
        self.first, self.second = np.outer(left[:, 0], right[0]), np.outer(left[:, 1], right[1])
        self.decay = float(values[1] / values[0])
        self.step = np.exp(self.trans)
        self.cache: dict[str, tuple[float | None, ...] | None] = {}

    def parts(self, word: str) -> tuple[float | None, ...] | None:
        """What a word adds to the potential of its token, of the next and of the one before, None where it
        has no feature; None for nothing at all."""
        get = self.table.get
        own = [w for f in features_of(word) if (w := get(f)) is not None]
        got = (sum(own) if own else None, get("<" + word), get(">" + word))
        return None if got == (None, None, None) else got

    def spots(self, text: str) -> tuple[list[tuple[int, float, int, int]], int]:
        """(number, what is added to the plain potential, start, end) of the tokens that have such, and the
        number of all tokens."""
        cache, out, n, pending, last = self.cache, [], 0, None, None
        for m in _TOKEN.finditer(text):
            word = m.group().lower()
            got = cache.get(word, 0)
            if got == 0:
                if len(cache) >= CACHE:
                    cache.clear()
                got = cache[word] = self.parts(word)
            if got is not None or pending is not None:
                own, after, before = got or (None, None, None)
                if before is not None and last is not None:
                    if out and out[-1][0] == n - 1:
                        at, e, *span = out[-1]
                        out[-1] = (at, e + before, *span)
                    else:
                        out.append((n - 1, before, *last))
                if own is not None or pending is not None:
                    out.append((n, (own or 0.0) + (pending or 0.0), *m.span()))
                pending = after
            last = m.span()
            n += 1
        return out, n

    def _power(self, n: int) -> np.ndarray:
        return self.first + self.decay**n * self.second

    def tag(self, text: str | None) -> tuple[list[tuple[int, int, float]], float, float]:
        """Tokens that carry a weight as (start, end, marginal), their greatest marginal, and the sum."""
        spots, n = self.spots(text or "")
        if not spots:
            return [], 0.0, 0.0
        alphas, alpha, last = [], None, -1
        plain = np.array([1.0, np.exp(self.bias)])
        for at, e, _, _ in spots:
            if alpha is None:
                alpha = np.ones(2) if at == 0 else (plain @ self._power(at - 1)) @ self.step
            else:
                alpha = (alpha @ self._power(at - last - 1)) @ self.step
            alpha = alpha * np.array([1.0, np.exp(min(self.bias + e, 50.0))])
            alpha = alpha / alpha.sum()
            alphas.append(alpha)
            last = at
        beta, marg, nxt = self._power(n - 1 - last) @ np.ones(2), [], None
        for (at, e, _, _), alpha in zip(reversed(spots), reversed(alphas), strict=True):
            if nxt is not None:
                here = np.array([1.0, np.exp(min(self.bias + nxt[1], 50.0))])
                beta = self._power(nxt[0] - at - 1) @ (self.step @ (here * beta))
            beta = beta / beta.sum()
            p = alpha * beta
            marg.append(float(p[1] / p.sum()))
            nxt = (at, e)
        marg.reverse()
        return [(s, e, p) for (_, _, s, e), p in zip(spots, marg, strict=True)], max(marg), sum(marg)

    def score(self, top: float, total: float) -> float:
        return float(_sigmoid(self.curve @ np.array([1.0, top, np.log1p(total)])))


def forward_backward(emit: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic tag (chains, tokens), of pairs (chains, tokens - 1, 2, 2), and the logarithm
    of each chain's sum over all sequences of tags.

    ``emit``: potential of the toxic tag against the clean one; ``mask``: which tokens exist
    (a prefix of each row).
    """
    b, t = emit.shape
    e = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))], axis=-1)
    m = np.exp(trans)
    alpha, beta = np.zeros((b, t, 2)), np.ones((b, t, 2))
    z = e[:, 0].sum(-1, keepdims=True)
    alpha[:, 0], log_z = e[:, 0] / z, np.log(z[:, 0])
    for i in range(1, t):
        a = (alpha[:, i - 1] @ m) * e[:, i]
        z = a.sum(-1, keepdims=True)
        alpha[:, i] = a / z
        log_z = log_z + np.where(mask[:, i], np.log(z[:, 0]), 0.0)
    for i in range(t - 2, -1, -1):
        z = (e[:, i + 1] * beta[:, i + 1]) @ m.T
        beta[:, i] = np.where(mask[:, i + 1 : i + 2], z / z.sum(-1, keepdims=True), 1.0)
    p = alpha * beta
    marg = p[..., 1] / p.sum(-1)
    pairs = alpha[:, :-1, :, None] * m * (e * beta)[:, 1:, None, :]
    return marg, pairs / pairs.sum(axis=(2, 3), keepdims=True), log_z


def curve_of(top: np.ndarray, total: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The logistic curve from a document's greatest marginal and its expected number of toxic tokens."""
    x = np.column_stack([np.ones(len(y)), top, np.log1p(total)])
    w = np.zeros(3)
    for _ in range(2000):
        w += 4.0 * (x.T @ (y - _sigmoid(x @ w)) / max(1, len(y)) - 0.0005 * w)
    return w


def drawn(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame | None:
    """(doc, toxic, text): the sample, a table in the shared folder; None without both labels."""
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("draw", uniform(F.lit("toxicity"), F.col("doc_id")))
    parts = [known.filter(F.col("toxic") == label).orderBy("draw", "doc_id").limit(n) for label, n in ((1, sample), (0, CLEAN * sample))]
    chosen = scratch.cut(parts[0].unionAll(parts[1]).select("doc_id", "toxic"), "chosen")
    if {r["toxic"] for r in chosen.select("toxic").distinct().collect()} != {0, 1}:
        return None
    # at most (1 + CLEAN) * sample ids
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
    return scratch.cut(texts.select(F.col("doc_id").cast("string").alias("doc"), "toxic", "text").repartition(texts.sparkSession.sparkContext.defaultParallelism), "sample")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Crf | None:
    """A chain from the labelled rows that may be learned from; None without both labels."""
    rows = drawn(docs, labels, sample)
    return None if rows is None else fitted(rows, *chains_of(rows))


def choose_prior(docs: DataFrame, labels: DataFrame, priors: tuple[float, ...] = PRIORS, folds: int = FOLDS, sample: int = SAMPLE) -> dict[float, float]:
    """The mean log loss of each weight of the prior, over folds of the rows that may be learned from: each
    fold is scored by chains trained on the others."""
    fold = F.pmod(F.crc32(F.concat(F.lit("fold:"), F.col("doc_id").cast("string"))), F.lit(folds))
    losses: dict[float, list[np.ndarray]] = {p: [] for p in priors}
    for k in range(folds):
        rows, rest = (drawn(docs, labels.filter(part), sample) for part in (fold != k, fold == k))
        if rows is None or rest is None:
            continue
        start, windows = chains_of(rows)
        for prior in priors:
            got = fetched(toxicity(rest, fitted(rows, start, windows, prior)).select("toxic", "toxicity.score"))
            p = np.clip(got["score"].to_numpy(), 1e-6, 1 - 1e-6)
            losses[prior].append(-np.log(np.where(got["toxic"] == 1, p, 1 - p)))
    return {p: float(np.concatenate(x).mean()) for p, x in losses.items() if x}


def chains_of(rows: DataFrame) -> tuple[dict[str, float], pd.DataFrame]:
    """The features that lean to toxic in a sample, with the weights they start from, and its windows, which
    number the features in order."""
    sc = rows.sparkSession.sparkContext

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc": batch["doc"], "h": [min_hashes(words_of(t)) for t in batch["text"]]})

    known, copies = set(), set()
    for r in rows.filter("toxic = 1").mapInPandas(hashed, "doc string, h array<long>").orderBy("doc").collect():
        least = set(enumerate(r["h"]))
        if least & known:
            copies.add(r["doc"])
        known |= least
    left_out = sc.broadcast(copies)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])  # uses and documents if toxic, uses if clean
        for batch in batches:
            for doc, toxic, text in zip(batch["doc"], batch["toxic"], batch["text"], strict=True):
                if toxic and doc in left_out.value:
                    continue
                words = words_of(text)
                for f, k in uses_of(words).items():
                    got = found[f]
                    got[0 if toxic else 2] += k
                    got[1] += toxic
        if found:
            yield pd.DataFrame([(f, *x) for f, x in found.items()], columns=["feature", "bad", "docs", "good"])

    counts = rows.mapInPandas(counted, "feature string, bad long, docs long, good long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("bad", "docs", "good")])
    counts = fetched(counts.filter(F.col("docs") >= DOCS))
    words = [(f, k) for f, k in zip(counts["feature"], counts["bad"], strict=True) if f[0] not in "<>" and f[-1] != "*"]
    most: Counter = Counter()
    for w, k in words:
        for f in features_of(w)[1:]:
            most[f] = max(most[f], k)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad = {f: (k, d, most[f]) for f, k, d in zip(counts["feature"], counts["bad"], counts["docs"], strict=True)}
    start = leaning(bad, dict(zip(counts["feature"], counts["good"], strict=True)), sizes[1], sizes[0])
    index = {f: i for i, f in enumerate(sorted(start))}
    shared = sc.broadcast(index)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = shared.value
        for batch in batches:
            out = []
            for doc, toxic, text in zip(batch["doc"], batch["toxic"], batch["text"], strict=True):
                words, found = words_of(text), defaultdict(lambda: ([], []))
                for i in range(len(words)):
                    for f in features_at(words, i):
                        if f in place:
                            at, cols = found[i // WIDTH]
                            at.append(i % WIDTH)
                            cols.append(place[f])
                for w, (at, cols) in sorted((found or ({0: ([], [])} if words else {})).items()):
                    out.append((doc, int(toxic), min(WIDTH, len(words) - w * WIDTH), at, cols))
            yield pd.DataFrame(out, columns=["doc", "toxic", "length", "at", "feature"])

    found = fetched(rows.mapInPandas(windows, "doc string, toxic int, length int, at array<int>, feature array<int>"))
    return start, found.sort_values("doc", kind="stable", ignore_index=True)


def fitted(rows: DataFrame, start: dict[str, float], windows: pd.DataFrame, prior: float | None = None) -> Crf:
    """A chain from a sample and what ``chains_of`` gives of it."""
    index = {f: i for i, f in enumerate(sorted(start))}
    k, at = len(index), np.array([start[f] for f in index])
    params = Chains(windows, k).fit(at, weight=prior) if len(windows) else np.concatenate([np.zeros(k), [-6.0], np.zeros(4)])
    crf = Crf({f: float(params[i]) for f, i in index.items()}, float(params[k]), params[k + 1 :].reshape(2, 2))
    marks = fetched(toxicity(rows, crf).select("toxic", "toxicity.top", "toxicity.total")).sort_values(["toxic", "top", "total"])
    crf.curve = curve_of(marks["top"].to_numpy(), marks["total"].to_numpy(), marks["toxic"].to_numpy(np.float64))
    return crf


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("marginal", T.DoubleType())])
_RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("top", T.DoubleType()), T.StructField("total", T.DoubleType())])


def toxicity(docs: DataFrame, crf: Crf | None, into: str = "toxicity") -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``toxicity`` (or ``into``): score, offending spans
    (characters, end exclusive, with their marginals), the greatest marginal and the sum of all."""
    if crf is None:
        zero = F.lit(0.0)
        return docs.withColumn(into, F.struct(zero.alias("score"), F.array().cast(T.ArrayType(_SPAN)).alias("spans"), zero.alias("top"), zero.alias("total")))
    crf.cache = {}
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            rows = []
            for text in texts:
                marks, top, total = model.tag(text)
                rows.append((model.score(top, total), [{"start": s, "end": e, "marginal": p} for s, e, p in marks if p >= 0.5], top, total))
            yield pd.DataFrame(rows, columns=["score", "spans", "top", "total"])

    return docs.withColumn(into, F.pandas_udf(tag, _RESULT)(F.col("text")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: n_spans, and spans as start:end, comma-joined (code points)."""
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, train(docs, read(spark, sf_dir, "labels")))
    score = F.col("toxicity.score")
    listed = F.transform("toxicity.spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        score.alias("score"),
        (score >= THRESHOLD).cast("int").alias("predicted"),
        F.size("toxicity.spans").cast("long").alias("n_spans"),
        F.array_join(listed, ",").alias("spans"),
    )
