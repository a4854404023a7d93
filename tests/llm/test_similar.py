"""Near-duplicates by shingle similarity against brute force."""

import collections
import itertools
import random

import pytest
from oracle import SMALL
from test_operators_llm import DOCS

from fieldnotes.llm import simhash, similar


def brute_kept(texts):
    """The ids that are the least of their class of texts with a Jaccard similarity of at least 0.8."""
    sets, part = {}, {i: i for i in texts}
    for i, t in texts.items():
        words = (t or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    for a, b in itertools.combinations(sorted(texts), 2):
        same, total = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if same * 5 >= total * 4 and part[a] != part[b]:
            low, high = sorted((part[a], part[b]))
            part = {i: low if p == high else p for i, p in part.items()}
    return sorted(i for i, p in part.items() if p == i)


@pytest.mark.parametrize(("late", "broadcast"), [(similar.LATE, similar.BROADCAST_ROWS), (100, 0), (0, 10)])
def test_near_copies_equal_brute_force(spark, monkeypatch, late, broadcast):
    """Near copies of some texts, each with a few words changed, and a passage that most texts hold."""
    monkeypatch.setattr(similar, "LATE", late)
    monkeypatch.setattr(similar, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(30)]
    bases = [[f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 160))] for _ in range(12)]
    texts = {0: None, 1: "", 2: "two words", 3: "Two Words", 4: " "}
    for i in range(5, 200):
        words = list(rng.choice(bases))
        for _ in range(rng.choice((0, 1, 1, 2, 4))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(words + (passage if rng.random() < 0.6 else []))
    rows = [(i, t, "en", "a", 0) for i, t in texts.items()]
    got = sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).select("doc_id").collect())
    assert got == brute_kept(texts) and len(got) < 150
    again = collections.Counter(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows + rows[:120], DOCS)).select("doc_id").collect())
    assert again == {i: 2 if i < 120 else 1 for i in got}  # repeated rows stay with their first


def test_near_copies_among_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = sorted(r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect())
    assert got == brute_kept(texts)


def test_rows_that_share_an_id_or_have_none_are_documents_of_their_own(spark):
    long = [" ".join(f"w{k}{i}" for i in range(40)) for k in range(3)]
    rows = [(1, long[0]), (9, long[0]), (9, long[1]), (None, long[1]), (None, long[2]), (None, long[2] + " more"), (9, long[0])]
    kept = simhash.keep_one(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)).select("doc_id", "text").collect()
    got = sorted((str(r["doc_id"]), r["text"]) for r in kept)
    assert got[:2] == [("1", long[0]), ("9", long[1])] and len(got) == 3 and got[2][0] == "None" and got[2][1].startswith(long[2])
