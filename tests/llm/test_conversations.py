"""The prefix trie against one that is built conversation by conversation, and against its SQL."""

import hashlib
import random
import re
import zlib

import pytest
from oracle import SMALL, check, connect

from fieldnotes.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def naive(rows):
    given = {}
    for c, t, role, text in rows:
        if c is not None:
            given.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    given = {c: [x[2:] for x in sorted(turns)] for c, turns in given.items()}
    rebuilt = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        rebuilt[c] = tuple(given.get(donor, [])[:h] + own[h:])
    members, children = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    saved, leaves, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below, convs = children.get(node, []), members[node]
        saved[node] = (len(convs) - 1) * len(WORD.findall(node[-1][1]) if node else []) + sum(saved[k] for k in below)
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(below), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows, parts=5):
    found = conversations.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert found.columns == COLUMNS
    return sorted([tuple(r) for r in found.collect()], key=repr)


@pytest.fixture
def split(spark):
    """Ranges aren't merged, so that conversations lie in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_awkward_rows(spark, split):
    draw = random.Random(13)
    rows = [(draw.choice([None, *range(-45, 130)]), draw.choice([None, 0, 1, 2, 3, 4, 5]), draw.choice(["user", "assistant", None]), draw.choice(["a b", "c", "", None, "a  b\tc"])) for _ in range(700)]
    assert trie(spark, rows) == naive(rows)


def test_hot_conversation_and_copies(spark, split):
    rows = [(40, i, "user", f"hot {i % 7}") for i in range(500)] + [(41, i, "user", f"hot {i % 7}") for i in range(450)]  # long, with a common start
    rows += [(200 + i, t, "user", f"same {t}") for i in range(300) for t in range(2)]  # copies: ends of one node in several ranges
    rows += [(7, None, None, None)] * 40 + [(1000 + i, 0, "user", "only start") for i in range(50)] + [(9, 0, "user", "w " * 20_000)]
    assert trie(spark, rows) == naive(rows)


def test_turnless_absent_and_empty(spark):
    rows = [(c, 0, "user", "x") for c in range(21, 40)]  # their group's first is absent, so many have no turn left
    got = trie(spark, rows)
    assert got == naive(rows) and any(r[1] == 0 and r[3] == 19 for r in got)
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "user", "x")]) == []


def test_ambiguous_joins_of_role_and_text(spark):
    rows = [(0, 0, "a", "b:c"), (20, 0, "a:b", "c"), (40, 0, "", "a"), (60, 0, "a", "")]
    assert trie(spark, rows) == naive(rows)


def test_query_equals_sql(spark):
    check(connect(SMALL), conversations.op13_prefix_trie(spark, SMALL), conversations.op13_sql())
