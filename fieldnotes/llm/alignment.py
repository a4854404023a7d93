"""Cross-tokenizer alignment: minimal groups of tokens of two tokenizers that cover the same bytes.

A token of the first tokenizer (A) and one of the second (B) are joined by an edge if their byte ranges
overlap.  Ranges of one tokenizer don't overlap each other, so there is exactly one edge for each byte at
which a token of either begins: the two tokens that cover it.  The connected components of this bipartite
graph, by union-find, are the minimal groups: they end where tokens of both end.  The members of a
component, expanded to its edges, are the links.

No token of A or B reaches over the start of a space that follows a visible character: A's pattern
begins a new word there, and B has no piece with an inner space (``Pair`` looks whether this holds for the
files it is given, and takes whole texts as one part if not).  So a text falls into parts that are encoded
on their own.  A task encodes distinct parts once while it remembers them, many in one call, and a document's
figures are sums over its parts.

Plan: one pass over the texts in Arrow batches writes a row a document with its links by pair of ids, each
pair once, to the shared folder.  From that, tasks add up their pairs and a shuffle of partial counts gives
the corpus-wide count of each pair.  The counts are broadcast while there are at most ``PAIRS`` pairs of ids,
else documents' pairs are joined with them; both give the same rows.

Defined cases: null and empty texts, and texts that a tokenizer can't give back byte by byte (B reads
U+2581 as a space), have no tokens, zeros and '' as digest; special tokens' strings in a text are plain text;
repeated rows count as often as they occur; very long texts are encoded whole, part by part; ties for the
highest count of a B id all count as best; other columns stay, and where ``into`` names one, it is replaced;
an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldnotes.llm import scratch
from fieldnotes.llm.common import binaries, free_name, others, read, small_batches

#: Where the vocabulary files are.
TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct pairs of ids whose counts are broadcast (24 bytes each).
PAIRS = 2_000_000
#: Bytes of text that are encoded at a time, if no single text is longer.
RUN_BYTES = 6_000_000
#: Bytes of parts given to a tokenizer in one call.
CALL_BYTES = 200_000
#: Pairs a task holds before it hands out partial counts.
HELD = 1_000_000
#: Distinct parts a task remembers from one run of texts to the next; what it forgets is encoded again.
KNOWN = 400_000
SPACE = "▁"
# Fixed value: how byte-level vocabularies split a text into words before any merge.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: visible Latin-1 characters stand for
    themselves, the other bytes for the code points from 256 on, in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: What stands behind an id in the digest: another id of the same tokenizer, the other tokenizer, the next group.
MARKS = pa.array([b",", b"|", b";"], pa.binary())


def _values(strings: pa.Array) -> tuple[bytes, np.ndarray]:
    """The joined bytes of an array without nulls, and where in them each of its values begins and ends."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return strings.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]], offsets - offsets[0]


class Pair:
    """Two tokenizers, and the bytes of their tokens.

    A's file lists its merges in the order of their ids, and then the same ids come from the ranks of its
    tokens, which is much faster; else the library that the file is made for encodes.
    """

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        model = json.loads(a)
        alphabet, vocabulary = byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        special = {t["content"] for t in model.get("added_tokens", [])}
        self.a_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.a_tokens, self.b_tokens = pa.array(self.a_bytes, pa.binary()), pa.array(self.b_bytes, pa.binary())
        self.decimals = pa.array([str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))], pa.binary())
        split = model.get("pre_tokenizer") or {}
        words = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and model.get("normalizer") is None
        self.cuts = words and b"\x0a\x08identity" in b and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.ranks = None
        if words and all(vocabulary["".join(m)] == 256 + i for i, m in enumerate(merges)):
            ranks = {self.a_bytes[i]: i for t, i in vocabulary.items() if t not in special}
            self.ranks = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids by both tokenizers; the text begins with the space that B adds by itself."""
        a = self.ranks.encode_ordinary(text) if self.ranks else self.a.encode(text, add_special_tokens=False).ids
        return np.array(a, np.int64), np.array(self.b.encode(text[1:]), np.int64)

    def exact(self, text: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        return all(_values(table.take(pa.array(ids)))[0] == text for table, ids in ((self.a_tokens, a), (self.b_tokens, b)))


def starts_of_parts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the parts of texts begin: with each text, and at spaces after a visible ASCII character or a
    Latin-1 letter, if something follows in the text.  ``data``: texts, one after the other."""
    start = np.zeros(len(data), bool)
    visible = (data > 0x20) & (data < 0x7F)
    visible[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
    start[1:] = (data[1:] == 0x20) & visible[:-1]
    start[ends - 1] = False  # a blank at the end belongs to what is before it
    start[0] = True
    start[ends[:-1]] = True
    return np.flatnonzero(start)


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over edges (u, v) of n nodes, all edges at a time: the larger root is hung below the
    smaller one, and paths are halved, until every edge lies within a tree.  Gives each node's root."""
    parent = np.arange(n)
    while len(u):
        ru, rv = parent[u], parent[v]
        apart = ru != rv
        if not apart.any():
            break
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


class Parts:
    """What is known of distinct parts: figures for each, links of each, and the text of its groups."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.place: dict[bytes, int] = {}
        self.groups: list[bytes] = []
        self.bad, self.n_a, self.n_b, self.n_groups, self.n_links, self.first, self.key = (np.zeros(0, t) for t in (bool, *[np.int64] * 6))

    def places(self, texts: list[bytes]) -> np.ndarray:
        """Numbers of parts, each with a space at its start; those not yet known are encoded."""
        new = [t for t in texts if t not in self.place]
        if new:
            if len(self.place) + len(new) > KNOWN:
                self.__init__(self.pair)
                new = texts
            self._learn(new)
        return np.array([self.place[t] for t in texts], np.int64)

    def _learn(self, texts: list[bytes]) -> None:
        mark, before = SPACE.encode(), len(self.place)
        self.place.update(zip(texts, range(before, before + len(texts)), strict=True))
        self._bad = np.zeros(len(texts), bool)
        self._made: list[tuple[np.ndarray, ...]] = []
        self._groups = [b""] * len(texts)
        run, size = [], 0
        for i, text in enumerate(texts):
            # a part after which another may follow
            if self.pair.cuts and mark not in text and (0x20 < text[-1] < 0x7F or text[-2] == 0xC3):
                run.append(i)
                size += len(text)
                if size >= CALL_BYTES:
                    self._together(texts, run)
                    run, size = [], 0
            else:
                self._alone(texts, i)
        if run:
            self._together(texts, run)
        which, n_a, n_b, n_groups, n_links, key = (np.concatenate([m[i] for m in self._made] or [np.zeros(0, np.int64)]) for i in range(6))
        starts = len(self.key) + np.cumsum(n_links) - n_links
        for name, values in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links), ("first", starts)):
            column = np.zeros(len(texts), np.int64)
            column[which] = values
            setattr(self, name, np.concatenate([getattr(self, name), column]))
        self.key = np.concatenate([self.key, key])
        self.bad = np.concatenate([self.bad, self._bad])
        self.groups += self._groups

    def _alone(self, texts: list[bytes], i: int) -> None:
        ids = self.pair.encode(texts[i].decode())
        self._bad[i] = not (self.pair.exact(texts[i], *ids) and self._add(np.array([i]), np.array([len(texts[i])]), *ids))

    def _together(self, texts: list[bytes], which: list[int]) -> None:
        joined = b"".join([texts[i] for i in which])
        ids = self.pair.encode(joined.decode())
        if not (self.pair.exact(joined, *ids) and self._add(np.array(which), np.array([len(texts[i]) for i in which]), *ids)):
            for i in which:
                self._alone(texts, i)

    def _add(self, which: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
        """Take parts that were encoded together; False if tokens reach over the end of a part."""
        end = np.cumsum(sizes)
        a_start, b_start, part_start = (np.cumsum(n) - n for n in (self.pair.a_length[a], self.pair.b_length[b], sizes))
        begins = np.zeros((3, end[-1]), bool)
        for row, at in zip(begins, (a_start, b_start, part_start), strict=True):
            row[at] = True
        if not (begins[0][part_start].all() and begins[1][part_start].all()):
            return False
        at = np.flatnonzero(begins[0] | begins[1])
        la, lb, part = (np.cumsum(row)[at] - 1 for row in begins)  # the tokens and the part that cover each such byte
        root = components(len(a) + len(b), la, len(a) + lb)
        heads = np.flatnonzero(root[: len(a)] == np.arange(len(a)))  # a component's least node is its first A token
        part_of_a, part_of_b = np.searchsorted(part_start, a_start, side="right") - 1, np.searchsorted(part_start, b_start, side="right") - 1
        n_a, n_b, n_groups, n_links = (np.bincount(x, minlength=len(which)) for x in (part_of_a, part_of_b, part_of_a[heads], part))
        self._made.append((which, n_a, n_b, n_groups, n_links, (a[la] << 32) | b[lb]))
        # tokens in the order of the digest: groups, in a group A before B
        order = np.argsort(np.concatenate([2 * root[: len(a)], 2 * root[len(a) :] + 1]), kind="stable")
        side, of = order >= len(a), root[order]
        turn = np.ones(len(order), bool)
        turn[:-1] = of[1:] != of[:-1]
        over = np.zeros(len(order), bool)
        over[:-1] = ~side[:-1] & side[1:] & ~turn[:-1]
        ids = self.pair.decimals.take(pa.array(np.concatenate([a, b])[order]))
        listed, offsets = _values(pc.binary_join_element_wise(ids, MARKS.take(pa.array(np.where(turn, 2, np.where(over, 1, 0)))), b""))
        bounds = offsets[np.cumsum([0, *(n_a + n_b)])].tolist()
        for w, lo, hi in zip(which.tolist(), bounds[:-1], bounds[1:], strict=True):
            self._groups[w] = listed[lo:hi]
        return True


def align_run(known: Parts, texts: list[str]) -> tuple[dict[str, list], list[tuple[bytes, bytes]]]:
    """Figures of each text, which isn't empty, and its links: keys (A id << 32 | B id) and how many each."""
    encoded = [(" " + t).encode() for t in texts]
    ends = np.cumsum([len(e) for e in encoded])
    data = np.frombuffer(b"".join(encoded), np.uint8)
    starts = starts_of_parts(data, ends) if known.pair.cuts else np.concatenate([[0], ends[:-1]])
    offsets = pa.array(np.append(starts, len(data)), pa.int64())
    parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets.buffers()[1], pa.py_buffer(data)]).dictionary_encode()
    ids = known.places(binaries(parts.dictionary))[parts.indices.to_numpy()]
    first = np.searchsorted(starts, np.concatenate([[0], ends[:-1]]))
    good = ~np.logical_or.reduceat(known.bad[ids], first)
    figures = {name: np.where(good, np.add.reduceat(getattr(known, name)[ids], first), 0).tolist() for name in ("n_a", "n_b", "n_groups", "n_links")}
    bounds = np.append(first, len(ids)).tolist()
    # each document's links, every pair once
    links = []
    for lo, hi, ok in zip(bounds[:-1], bounds[1:], good.tolist(), strict=True):
        own = ids[lo:hi] if ok else ids[:0]
        n = known.n_links[own]
        at = np.repeat(known.first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key, times = np.unique(known.key[at], return_counts=True)
        links.append((key.tobytes(), times.astype(np.int32).tobytes()))
    listed = list(map(known.groups.__getitem__, ids.tolist()))
    figures["groups_sha256"] = [hashlib.sha256(b"".join(listed[lo:hi])[:-1]).hexdigest() if ok else "" for lo, hi, ok in zip(bounds[:-1], bounds[1:], good.tolist(), strict=True)]
    return figures, links


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def _runs(texts: list[str | None]) -> Iterator[list[int]]:
    """Numbers of texts that aren't empty, about ``RUN_BYTES`` of them at a time."""
    run, size = [], 0
    for i, text in enumerate(texts):
        if text:
            run.append(i)
            size += len(text)
            if size >= RUN_BYTES:
                yield run
                run, size = [], 0
    if run:
        yield run


def _aligner(shared):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Parts(Pair(*shared.value))
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            figures = {name: [0] * len(texts) for name in _FIGURES} | {"groups_sha256": [""] * len(texts)}
            keys, times = [b""] * len(texts), [b""] * len(texts)
            for run in _runs(texts):
                found, links = align_run(known, [texts[i] for i in run])
                for name, values in found.items():
                    for i, value in zip(run, values, strict=True):
                        figures[name][i] = value
                for i, (k, t) in zip(run, links, strict=True):
                    keys[i], times[i] = k, t
            rest = [(c, batch.column(c)) for c in batch.schema.names if c != "_text"]
            made = [(name, pa.array(values, pa.string() if name == "groups_sha256" else pa.int64())) for name, values in figures.items()]
            columns = [*rest, *made, ("keys", pa.array(keys, pa.binary())), ("times", pa.array(times, pa.binary()))]
            yield pa.RecordBatch.from_arrays([x for _, x in columns], names=[name for name, _ in columns])

    return align


def _sum(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(key), np.int64)
    np.add.at(out, at, np.concatenate(times))
    return key, out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of pairs, added up in a task."""
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def give() -> pa.RecordBatch:
        key, n = _sum(keys, times)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    for batch in batches:
        keys.append(np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64))
        times.append(np.frombuffer(b"".join(batch.column("times").to_pylist()), np.int32).astype(np.int64))
        if sum(map(len, keys)) > 4 * HELD:
            key, n = _sum(keys, times)
            keys, times = [key], [n]
            if len(key) > HELD:
                yield give()
                keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    yield give()


def links_of(docs: DataFrame, folder: str = TOKENIZERS, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """All rows and columns of ``docs`` but ``text``, with the figures and ``keys``, ``times`` of each text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(Path(folder, name).read_bytes() for name in (a_file, b_file)))
    rest = [c for c in docs.columns if c.lower() != "text"]
    kinds = [T.StructField(f.name, f.dataType) for f in docs.schema.fields if f.name in rest]
    made = [*(T.StructField(n, T.LongType()) for n in _FIGURES), T.StructField("groups_sha256", T.StringType()), T.StructField("keys", T.BinaryType()), T.StructField("times", T.BinaryType())]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col("text").alias("_text"))
    return rows.mapInArrow(_aligner(shared), T.StructType([*kinds, *made]))


def pair_counts(links: DataFrame) -> DataFrame:
    """(key, n): how many links of all texts join a pair of ids."""
    return links.select("keys", "times").mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _b(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << 32) - 1))


def _by_broadcast(links: DataFrame, counts: DataFrame) -> DataFrame:
    table = counts.toArrow()
    key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(key)
    key, n = key[order], n[order]
    _, at = np.unique(key & ((1 << 32) - 1), return_inverse=True)
    most = np.zeros(at.max(initial=-1) + 1, np.int64)
    np.maximum.at(most, at, n)
    shared = links.sparkSession.sparkContext.broadcast((key, n, n == most[at]))
    kind = T.StructType([*(f for f in links.schema.fields if f.name not in ("keys", "times")), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, best = shared.value
        for batch in batches:
            lists = [np.frombuffer(x, np.int64) for x in batch.column("keys").to_pylist()]
            at = np.searchsorted(key, np.concatenate([*lists, np.zeros(0, np.int64)]))
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), np.int32).astype(np.int64)
            ends = np.cumsum([0, *map(len, lists)])
            sums = [np.concatenate([[0], np.cumsum(x)])[ends] for x in (times * best[at], times * n[at])]
            rest = [(c, batch.column(c)) for c in batch.schema.names if c not in ("keys", "times")]
            columns = [*rest, *((c, pa.array(np.diff(s))) for c, s in zip(("n_best", "count_sum"), sums, strict=True))]
            yield pa.RecordBatch.from_arrays([x for _, x in columns], names=[c for c, _ in columns])

    return links.mapInArrow(look_up, kind)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, times = ([np.frombuffer(x, t) for x in batch.column(c).to_pylist()] for c, t in (("keys", np.int64), ("times", np.int32)))
        row = np.repeat(batch.column("row").to_numpy(), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(np.concatenate([*times, np.zeros(0, np.int32)]).astype(np.int64))], names=["row", "key", "times"])


def _by_join(links: DataFrame, counts: DataFrame, row: str) -> DataFrame:
    """Pairs are joined by the pair: one that most documents have is a skewed key of a plain join, whose
    other side has one row for it, so that its partition is split."""
    most = counts.groupBy(_b(F.col("key")).alias("b")).agg(F.max("n").alias("most"))  # as many rows as B has ids
    known = counts.join(F.broadcast(most), _b(F.col("key")) == F.col("b")).select("key", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    each = links.select(F.col(row).alias("row"), "keys", "times").mapInArrow(_unpack, "row long, key long, times long")
    sums = each.join(known, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return links.drop("keys", "times").join(sums, F.col(row) == F.col("row"), "left").drop("row").withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})


def align(docs: DataFrame, folder: str = TOKENIZERS, into: str = "alignment", pairs: int = PAIRS, a_file: str = A_FILE, b_file: str = B_FILE) -> tuple[DataFrame, DataFrame]:
    """``docs`` without ``text`` and with a struct ``alignment`` (or ``into``): n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256; and (a, b, n), the corpus-wide counts of linked ids."""
    small_batches(docs.sparkSession)
    kept = docs.select(*others(docs, "text", into))
    row = free_name(docs, "_row")
    held = F.struct(*[F.col(f"`{c}`") for c in kept.columns]) if kept.columns else F.lit(None).cast("int")
    links = scratch.cut(links_of(docs.select(held.alias("_kept"), F.col("text")), folder, a_file, b_file).withColumn(row, F.monotonically_increasing_id()), "links")
    counts = scratch.cut(pair_counts(links), "pairs")
    found = _by_broadcast(links, counts) if counts.count() <= pairs else _by_join(links, counts, row)
    figures = F.struct(*_FIGURES, "n_best", "count_sum", "groups_sha256").alias(into)
    out = found.select(*[F.col(f"_kept.`{c}`").alias(c) for c in kept.columns], figures)
    return out, counts.select(F.shiftright("key", 32).alias("a"), _b(F.col("key")).alias("b"), "n")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, _ = align(docs)
    return found.select("doc_id", "alignment.*")
