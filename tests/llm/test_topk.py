"""Near ties whose sums are beyond what a narrow type holds."""

import numpy as np
import pytest

from fieldnotes.llm import topk


def exact(ids, xs, own, q, k):
    out = []
    for i, (o, v) in enumerate(zip(own, q, strict=True)):
        scores = [(-int(np.dot(v.astype(object), x.astype(object))), int(d)) for d, x in zip(ids, xs, strict=True) if d != o]
        out += [(i, d, -s) for s, d in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize(("block", "query"), [((0, 362), (2000, 2049)), ((0, 20), (-(10**6), 10**6)), ((-3000, 3000), (-3000, 3000)), ((-(10**7), 10**7), (-(10**7), 10**7)), ((0, 8), (0, 8))])
def test_large_components_of_queries(block, query):
    draw = np.random.default_rng(1)
    ids, xs = np.arange(200), draw.integers(*block, (200, 128))
    near = xs[:1] + (np.arange(128) == np.arange(30)[:, None])  # near ties
    xs = np.concatenate([xs, near])
    ids = np.arange(len(xs))
    q = draw.integers(*query, (80, 128))
    own = np.arange(1000, 1080)
    rows, found, score = topk.ImpactIndex(ids, xs).search(own, q, 5)
    assert list(zip(rows.tolist(), found.tolist(), score.tolist(), strict=True)) == exact(ids, xs, own, q, 5)
