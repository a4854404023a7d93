"""Alignment of two tokenizers against whole texts encoded by their own libraries."""

import hashlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldnotes.llm import alignment

FILES = [Path(alignment.TOKENIZERS, f) for f in (alignment.A_FILE, alignment.B_FILE)]
TEXTS = [
    "Plain words, and more words.", "", None, " ", "a ", "  a  b ", "x\ny  z\n ", "<|endoftext|> <s> </s> <0x41>", "a▁b c", "naïve café à la carte", "日本 語 です", "\x00 a \t b\r\n c",
    "it's we'll I'm  '  s", "  x 　 y", "\U0001f600 \U0001f600 z", "Plain words, and more words.", "w" * 3000 + " end", "the " * 4000 + "end",
]


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*(f.read_bytes() for f in FILES))


@pytest.fixture(scope="module")
def own():
    a = tokenizers.Tokenizer.from_file(str(FILES[0]))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=str(FILES[1]))


def naive(pair, own, text):
    """(A ids, B ids, groups, links) of a text encoded whole; links are pairs of overlapping tokens."""
    spaced = " " + (text or "")
    a, b = own[0].encode(spaced, add_special_tokens=False).ids, own[1].encode(text or "")
    if not text or any(b"".join(t[i] for i in ids) != spaced.encode() for t, ids in ((pair.a_bytes, a), (pair.b_bytes, b))):
        return [], [], [], Counter()
    ranges = []
    for table, ids in ((pair.a_bytes, a), (pair.b_bytes, b)):
        ends = np.cumsum([len(table[i]) for i in ids]).tolist()
        ranges.append(list(zip([0, *ends[:-1]], ends, ids, strict=True)))
    cuts = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
    groups, links, lo = [], Counter(), 0
    for hi in cuts:
        ga, gb = ([r for r in side if lo <= r[0] < hi] for side in ranges)
        groups.append(",".join(str(r[2]) for r in ga) + "|" + ",".join(str(r[2]) for r in gb))
        links.update((x[2], y[2]) for x in ga for y in gb if x[0] < y[1] and y[0] < x[1])
        lo = hi
    return a, b, groups, links


def rows_of(pair, own, texts):
    all_ = [naive(pair, own, t) for t in texts]
    counts = sum((x[3] for x in all_), Counter())
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for a, b, groups, links in all_:
        sums = sum(counts[p] * n for p, n in links.items()), sum(n for p, n in links.items() if counts[p] == best[p[1]])
        out.append((len(a), len(b), len(groups), sum(links.values()), sums[1], sums[0], hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return out, counts


@pytest.mark.parametrize("pairs", [10**6, 0])  # counts broadcast, counts joined
def test_align_equals_whole_texts(spark, pair, own, pairs):
    docs = spark.createDataFrame([(i % 7 or None, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, keys string").repartition(3)
    found, counts = alignment.align(docs, pairs=pairs, into="ALIGNMENT")
    assert found.columns == ["doc_id", "keys", "ALIGNMENT"]
    want, n = rows_of(pair, own, TEXTS)
    got = [(r["doc_id"], *r["ALIGNMENT"]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(((i % 7 or None, *w) for i, w in enumerate(want)), key=repr)
    assert {(r["a"], r["b"]): r["n"] for r in counts.collect()} == dict(n)


@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(" ab'é\n.,1▁ 日\U0001f600A"), min_size=1, max_size=60))
def test_parts_of_any_text(pair, own, text):
    figures, _ = alignment.align_run(alignment.Parts(pair), [text, text + " x"])
    for i, t in enumerate((text, text + " x")):
        a, b, groups, links = naive(pair, own, t)
        assert [figures[c][i] for c in ("n_a", "n_b", "n_groups", "n_links")] == [len(a), len(b), len(groups), sum(links.values())]
        assert figures["groups_sha256"][i] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")


def test_parts_are_forgotten(pair, own, monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN", 3)
    known = alignment.Parts(pair)
    for text in ("one two three", "four five six seven eight nine", "one two ten"):
        figures, _ = alignment.align_run(known, [text])
        assert figures["n_a"] == [len(naive(pair, own, text)[0])]


def test_components():
    got = alignment.components(7, np.array([0, 1, 2, 5]), np.array([3, 3, 4, 6]))
    assert got.tolist() == [0, 0, 2, 0, 2, 5, 5]
    n = np.arange(999)
    assert not alignment.components(1000, n, n + 1).any()


def test_no_rows(spark):
    found, counts = alignment.align(spark.createDataFrame([], "doc_id long, text string"))
    assert found.collect() == [] and counts.collect() == []
