"""Line deduplication against brute force, with rows that share an id, hot keys and short lines."""

import collections
import hashlib
import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from fieldnotes.llm import graphs, linededup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def mutate(rng, s, n):
    for _ in range(n):
        i, c = rng.randrange(len(s) + 1), rng.choice("abé ")
        s = rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :]])
    return s


def linked(a, b):
    most = min(min(len(a), len(b)) // 10, 2)
    return abs(len(a) - len(b)) <= most and distance(a, b) <= most


def brute_lines(docs):
    """The (id, text, line number) of the lines that go from (id, text) rows."""
    spots = collections.defaultdict(set)
    for i, text in docs:
        own = xxhash.xxh64_intdigest((text or "").encode(), 42) & (2**31 - 1)
        for n, raw in enumerate(text.split("\n")) if text is not None else ():
            line = re.sub(r"[ \t\n\x0b\f\r]+", " ", raw).strip(" ")
            if line:
                spots[line].add((i is None, i if i is not None else 0, own, n, text))
    root = {x: x for x in spots}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    long = sorted((x for x in spots if len(x) >= 10), key=len)
    for k, a in enumerate(long):
        for b in itertools.takewhile(lambda b, a=a: len(b) - len(a) <= 2, long[k + 1 :]):
            if find(a) != find(b) and linked(a, b):
                root[find(a)] = find(b)
    classes = collections.defaultdict(set)
    for x, s in spots.items():
        classes[find(x)] |= s
    return {(None if s[0] else s[1], s[4], s[3]) for c in classes.values() for s in c if s != min(c)}


def brute_texts(docs):
    gone = brute_lines(docs)
    return [(i, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, t, n) not in gone)) for i, t in docs]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def check(spark, docs):
    """The texts of all rows, and the query's figures."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    got = [(r["doc_id"], r["text"]) for r in linededup.dedup_lines(frame(spark, docs)).collect()]
    assert sorted(got, key=key) == sorted(brute_texts(docs), key=key)


def test_banded_automaton_equals_edit_distance(spark):
    rng = random.Random(7)
    pairs = [("", ""), ("", "ab"), ("abc", ""), ("", "abc"), ("ab", "ba"), ("aaa", "aaaa")]
    for _ in range(150):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(12)))
        pairs.append((a, mutate(rng, a, rng.randrange(5)) if a else "b"))
    df = spark.createDataFrame([(a, b, k % 3) for k, (a, b) in enumerate(pairs)], "a string, b string, k int")
    got = df.select("a", "b", "k", linededup.within_edits(F.col("a"), F.col("b")).alias("two"), linededup.within_edits(F.col("a"), F.col("b"), F.col("k")).alias("some")).collect()
    for r in got:
        assert (r["two"], r["some"]) == (distance(r["a"], r["b"]) <= 2, distance(r["a"], r["b"]) <= r["k"])


@pytest.mark.parametrize("together", [1, 2])
def test_keys_meet_for_all_lines_within_two_edits(spark, together):
    rng = random.Random(together)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abé ") for _ in range(rng.randrange(10, 30)))
        b = mutate(rng, a, rng.randrange(3))
        pairs.append((a, b) if len(a) <= len(b) else (b, a))
    keys = lambda c: F.array(*linededup.line_keys(F.encode(c, "UTF-32"), F.length(c), together))
    n = linededup.indexed_keys(together)
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.arrays_overlap(F.slice(keys("a"), 1, n), keys("b")).alias("met")).collect()
    assert [(r["a"], r["b"]) for r in rows if not r["met"]] == []


@pytest.mark.parametrize("broadcast", [linededup.BROADCAST_ROWS, 0])
def test_lines_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", broadcast)
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice([8, 9, 10, 12, 19, 20, 24, 45, 60]))) for _ in range(18)]
    docs = []
    for i in range(60):
        docs.append((i, "\n".join(mutate(rng, rng.choice(base), rng.randrange(4)) if rng.random() < 0.7 else rng.choice(["x", " ", "", "\t y  z"]) for _ in range(rng.randrange(5)))))
    docs += [(70, None), (71, ""), (None, base[0]), (None, base[0] + "\n" + base[1]), (None, base[0]), (None, None), (3, base[2] + "\nmy own line"), (3, base[3] + "\n" + base[2]), docs[5], docs[5]]
    check(spark, docs)


def test_no_unique_line_is_lost_where_rows_share_an_id(spark):
    check(spark, [(9, "x x\nonly here A"), (9, "z z\nx x"), (None, "x x\nonly here B"), (None, "q q\nx x")])
    kept = "\n".join(r["text"] for r in linededup.dedup_lines(frame(spark, [(9, "x x\nonly here A"), (9, "z z\nx x")])).collect())
    assert "only here A" in kept and kept.count("x x") == 1


def test_query_counts(spark, tmp_path):
    line = "the same line of the same text"
    docs = [(1, line), (4, line), (4, line), (5, f"{line}s\n\nnot it"), (None, line), (6, None), (7, " ")]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["removed_sha256"]) for r in linededup.op7_line_dedup(spark, str(tmp_path)).collect()), key=str)
    digest = lambda gone: hashlib.sha256(",".join(map(str, gone)).encode()).hexdigest()
    gone = collections.defaultdict(list)
    for i, t, n in brute_lines(docs):
        gone[i, t].append(n)
    want = [(i, sum(bool(x.strip()) for x in (t or "").split("\n")), len(gone[i, t]), digest(sorted(gone[i, t]))) for i, t in docs]
    assert rows == sorted(want, key=str) and all(r[2] <= r[1] for r in rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hot_keys_lose_no_link(spark, seed):
    """Lines that share a segment: with a number at its end or in its middle, with another rest, short."""
    rng = random.Random(seed)
    head = "this line begins like very many others of its kind, "
    texts = [f"{head}{rng.randrange(400)}" for _ in range(60)] + [f"page {rng.randrange(300)} of a long line with a number" for _ in range(60)]
    texts += [head + "".join(rng.choice("abcdefgh ") for _ in range(26)) for _ in range(25)]
    texts += [mutate(rng, t, rng.randrange(3)) for t in rng.sample(texts, 40)] + [f"section {rng.randrange(60)}" for _ in range(40)]
    lines = linededup.lines_of(frame(spark, list(enumerate(texts))))
    some = sorted({re.sub(" +", " ", t).strip() for t in texts})
    root = {t: t for t in some}
    for a, b in itertools.combinations(some, 2):
        if linked(a, b) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {t: low if r == high else r for t, r in root.items()}
    for bucket, levels in ((4, 1), (4, 2), (10**6, 1)):
        edges, met = linededup.near_lines(lines, bucket, levels)
        part = {r["line"]: r["component"] for r in met.join(graphs.components(edges), "node").collect()}
        firsts = collections.defaultdict(list)
        for t in some:
            firsts[part.get(t, t)].append(t)
        assert sorted(map(sorted, firsts.values())) == sorted(sorted(t for t in some if root[t] == r) for r in set(root.values()))
