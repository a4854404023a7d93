"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

Lines are compared trimmed, with runs of blanks as one.  Equal lines are one class.  Two lines are
linked if they are within one edit for every ``CHARS`` = 10 characters of the shorter, at most
``EDITS`` = 2; classes are what links reach.  Of each class the first line stays (least doc_id, then
text, then line number); the others are removed.

The join: a line is cut into EDITS + 1 even segments.  If two lines are within EDITS edits, some
segment of one occurs in the other unchanged, at a position shifted by what the edits around it
allow.  So every line is indexed by (length, number of the segment, segment), and it
probes, for its own length and up to EDITS less, only the substrings that can match there: of
those, the positions given by the multi-match-aware bounds from both ends.  A pair whose counts of
frequent letters differ by more than the edits can explain is dropped inside the join.  Candidates are
verified, between their common prefix and suffix, by an automaton over the 2 * EDITS + 1 diagonals of
the band, one bit each, a word per number of edits, advanced by a few bit operations a character.

Hot keys: the lines of a key that more than ``BUCKET`` lines share aren't paired.  What all lines of
the key have in common at both ends goes, which changes no distance.  Where what is left is short,
lines are linked through all texts within one edit of it: two texts are within two edits exactly if
they share such a text, so a star to the least line of each gives the links, linearly.  Where it is
long, the key's lines are cut into one segment more and meet by every two segments that match at
once, and so on (``levels``); a key that is still hot at the last level, by which lines share most of
their characters in two or more places, has its pairs dealt over all tasks by both ends.

Plan: keys are made from one scan in whole-stage code and met by an aggregate with partial results
(least and greatest line of a key), so a hot key is a row a task; no text is shuffled.  The keys that meet are
joined to the keys of a second scan: broadcast up to ``BROADCAST_ROWS``, with the lines' texts; beyond, by a
shuffled hash of the keys, and a third scan gives the texts of the lines that met.  Candidates of all levels
are verified together.  Each table's shuffle files go once it is written (``scratch.cut``), so the disk holds the
largest shuffle, the one of the keys, and not the sum of all; large sides are hashed against, not sorted.
Links are between numbers given to those lines; a line is known by 128 bits of hash.

Defined cases: null texts have no lines; blank lines are never removed; rows with one doc_id and one
text are one document, all of whose rows lose the same lines; rows with one doc_id and other texts are
other documents, in the order of a hash of the text, and so are rows without an id, which come last;
lines of a very long text are lines like any other; an empty table stays empty; other columns stay.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldnotes.llm import common, graphs, scratch
from fieldnotes.llm.common import bounded, free_name, others, read

EDITS = 2
#: Characters of the shorter line for each edit that may be between linked lines.
CHARS = 10
#: Keys that meet, of one long each, that may be broadcast.
BROADCAST_ROWS = 4_000_000
#: Documents whose removed lines are broadcast to all.
BROADCAST_GONE = 250_000
#: Lines of a key that are paired with each other; the lines of hotter keys are linked without.
BUCKET = 64
#: Segments that must match at once, level by level, for lines of hot keys.
LEVELS = 2
#: Texts within one edit that a line's rest may have in a hot key (about its length times its letters).
BALL = 1500
#: Letters whose counts rule out candidates; any choice is right, frequent ones rule out most.
LETTERS = "etaoinsrhludcmgb"
#: Spots are doc_id, 31 bits of the text's hash and line number in one decimal.
_SLOT = 1 << 31


def hashed(few: DataFrame, most: int) -> DataFrame:
    """A table that is broadcast while it has at most ``most`` rows, else hashed after a shuffle: the other
    side, which may hold texts, is never sorted on disk."""
    return F.broadcast(few) if few.count() <= most else few.hint("shuffle_hash")


def odd_blanks(text: Column) -> Column:
    """That a text has other blanks than single spaces."""
    odd = text.contains("  ")
    for blank in "\t\x0b\f\r":
        odd = odd | text.contains(blank)
    return odd


def normal(line: Column, odd: Column) -> Column:
    """The line without blanks at its ends, runs of blanks as one; ``odd``: if its text has such."""
    return F.trim(F.when(odd & odd_blanks(line), F.regexp_replace(line, r"\s+", " ")).otherwise(line))


def document(text: Column) -> list[Column]:
    """128 bits of hash that tell a row from others with its id."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("#"), text).alias("t2")]


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, line_no, line, h1, h2): the normalised lines that count, with 128 bits of hash of
    their document and of themselves."""
    # what is of the text is computed before it is cut, else it would be for each of its lines
    texts = docs.select("doc_id", *document(F.col("text")), odd_blanks(F.col("text")).alias("odd"), F.split("text", "\n").alias("parts"))
    one = texts.select("doc_id", "t1", "t2", "odd", F.posexplode("parts").alias("line_no", "raw"))
    # told from the raw line, so that a filter doesn't normalise it a second time
    one = one.filter((F.trim("raw") != "") & (~F.col("odd") | F.col("raw").rlike(r"\S")))
    one = one.select("doc_id", "t1", "t2", "line_no", normal(F.col("raw"), F.col("odd")).alias("line"))
    return one.select("doc_id", "t1", "t2", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("#"), "line").alias("h2"))


def allowed(n: Column, m: Column) -> Column:
    """Edits that may be between lines of two lengths."""
    return F.least(F.floor(F.least(n, m) / CHARS), F.lit(EDITS)).cast("int")


def letter_counts(line: Column) -> Column:
    """How often each of the frequent letters occurs, modulo 16, four bits each in a long."""
    packed = F.lit(0).cast("long")
    for i, c in enumerate(LETTERS):
        n = F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
        packed = packed.bitwiseOR(F.shiftleft(n.bitwiseAND(15).cast("long"), 4 * i))
    return packed


def counts_apart(a: Column, b: Column) -> Column:
    """Sum over the letters of how far the counts are apart at least; an edit adds 2 at most."""
    part = lambda x, i: F.shiftrightunsigned(x, 4 * i).bitwiseAND(15)
    out = F.lit(0).cast("long")
    for i in range(len(LETTERS)):
        d = (part(a, i) - part(b, i)).bitwiseAND(15)
        out = out + F.least(d, 16 - d)
    return out


def _bounds(length: Column, i: int | Column, parts: int = EDITS + 1) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of a line: the last ones are one longer."""
    short = F.floor(length / parts).cast("int")
    longer = (length % parts).cast("int")
    before = F.greatest(F.lit(i) - (F.lit(parts) - longer), F.lit(0))
    return (short * i + before).cast("int"), (short + (F.lit(i) >= F.lit(parts) - longer).cast("int")).cast("int")


def _part(wide: Column, start: Column, size: Column) -> Column:
    """Characters of a text in UTF-32, four bytes each, so that a position needs no scan."""
    return F.substring(wide, start * 4 + 1, size * 4)


def _plan(together: int) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
    """(how much shorter the indexed line is, its segments that match, their shifts in the other line).

    Of EDITS + ``together`` segments, ``together`` are untouched.  For one of them, i, that starts at p in
    a line shorter by d, the start s in the other line obeys |s - p| <= i (the segments before it are
    all touched, or the first untouched one would do) and |s - p - d| <= EDITS - i (so are those
    after it).  For several, what the shifts take in edits, from one to the next and to d, is at most
    EDITS.  The plan begins with a line's own segments, unshifted: those are indexed, all are probed.
    """
    parts, out = EDITS + together, []
    for d in range(EDITS + 1):
        for of in itertools.combinations(range(parts), together):
            for shifts in itertools.product(range(-EDITS, EDITS + 1), repeat=together):
                path = [0, *shifts, d]
                if together == 1:
                    fits = abs(shifts[0]) <= of[0] and abs(shifts[0] - d) <= EDITS - of[0]
                else:
                    fits = sum(abs(y - x) for x, y in itertools.pairwise(path)) <= EDITS
                if fits:
                    out.append((d, of, shifts))
    return sorted(out, key=lambda p: (p[0] > 0 or any(p[2]), p))


def indexed_keys(together: int) -> int:
    """How many keys of the plan, the first, are a line's own segments."""
    return sum(d == 0 and not any(shifts) for d, _, shifts in _plan(together))


def line_keys(wide: Column, length: Column, together: int = 1) -> list[Column]:
    """A key for each entry of the plan, of a line in UTF-32."""
    keys, parts = [], EDITS + together
    for d, of, shifts in _plan(together):
        other = length - d
        spots = [(start + shift, size) for (start, size), shift in zip((_bounds(other, i, parts) for i in of), shifts, strict=True)]
        inside = [F.when(start >= 0, _part(wide, start, size)) for start, size in spots] if together > 1 else [_part(wide, *spots[0])]
        keys.append(F.xxhash64(other.cast("int"), F.lit("".join(map(str, (together, *of)))), *inside))
    return keys


def _common(pair: Column) -> Column:
    """A struct that has texts a and b with ``lo``, the length of their common prefix, found by halving.
    All that steps read is in the state: an expression from outside would be computed anew for every
    step."""

    def longer(s: Column, step: Column) -> Column:
        end = s["lo"] + step
        same = (end <= F.least(F.length(s["a"]), F.length(s["b"]))) & (F.substring(s["a"], s["lo"] + 1, step) == F.substring(s["b"], s["lo"] + 1, step))
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), F.when(same, end).otherwise(s["lo"]).alias("lo"), s["most"].alias("most"))

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(25, -1, -1)]), pair, longer)


def _strip(pair: Column) -> Column:
    """The struct without the common prefix of a and b; both reversed, so that the next call strips the
    suffix."""

    def rest(s: Column) -> Column:
        a, b = F.substr(s["a"], s["lo"] + 1), F.substr(s["b"], s["lo"] + 1)
        return F.struct(F.reverse(a).alias("a"), F.reverse(b).alias("b"), F.lit(0).alias("lo"), s["most"].alias("most"))

    return F.get(F.transform(F.array(_common(pair)), rest), 0)


def _pair(a: Column, b: Column, most: Column) -> Column:
    return F.struct(F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b"), F.lit(0).alias("lo"), most.alias("most"))


def within_edits(a: Column, b: Column, most: Column | None = None) -> Column:
    """True if the edit distance of two texts is at most ``most`` (EDITS at most, and if none is given).

    Common prefix and suffix, which edits needn't touch, go first; the rest is for the automaton.
    """
    middle = _strip(_strip(_pair(a, b, F.lit(EDITS) if most is None else most)))
    return F.get(F.transform(F.array(middle), lambda m: _automaton(m["a"], m["b"], m["most"], EDITS)), 0)


def _automaton(a: Column, b: Column, most: Column, edits: int) -> Column:
    """The banded automaton for up to ``edits``; accepts at most ``most`` of them.  Bit d + edits of word e: the first i characters of a can become the
    first i + d of b by e edits."""
    la, lb = F.length(a), F.length(b)
    width = 2 * edits + 1
    full = (1 << width) - 1
    blank = F.array_repeat(F.lit(""), edits)
    padded = F.concat(blank, F.split(b, ""), blank, blank)
    # an entry for each character of a: itself, and the characters of b on the diagonals
    band = F.arrays_zip(F.split(a, "").alias("x"), *[F.slice(padded, k + 1, F.greatest(la, F.lit(1))).alias(f"y{k}") for k in range(width)])

    def closed(words: list[Column]) -> list[Column]:
        out = [words[0]]
        for w in words[1:]:
            out.append(w.bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(full))
        return out

    def step(state: Column, at: Column) -> Column:
        mask = F.lit(0)
        for k in range(width):
            mask = mask.bitwiseOR(F.when(at[f"y{k}"] == at["x"], 1 << k).otherwise(0))
        old = [F.get(state, e) for e in range(edits + 1)]
        new = [old[0].bitwiseAND(mask)]
        for e in range(1, edits + 1):
            new.append(old[e].bitwiseAND(mask).bitwiseOR(old[e - 1]).bitwiseOR(F.shiftright(old[e - 1], 1)))
        return F.array(*closed(new))

    start = F.array(*closed([F.lit(1 << edits) if e == 0 else F.lit(0) for e in range(edits + 1)]))
    final = F.aggregate(band, start, step)
    goal = F.element_at(F.array(*[F.lit(1 << k) for k in range(width)]), lb - la + edits + 1)
    ok = F.get(final, most).bitwiseAND(goal) != 0
    return F.when(F.abs(lb - la) > most, F.lit(False)).when((la == 0) | (lb == 0), F.lit(True)).otherwise(ok)


def line_id(row: Column) -> Column:
    """A row of keys is two longs: the lowest bit of the second says whether the key is indexed, the
    others are the line's."""
    return row.bitwiseAND(-2)


def planned_keys(sized: DataFrame, together: int, *carried: str) -> DataFrame:
    """Lines (id, wide, n) -> (id, at, key), the keys of ``line_keys`` by a table of the plan's entries: an
    expression for each of the many entries of a plan for two segments takes longer to compile than to run."""
    parts, plan = EDITS + together, _plan(together)
    rows = [(at, d, "".join(map(str, (together, *of))), *of, *shifts) for at, (d, of, shifts) in enumerate(plan)]
    names = [f"{name}{i}" for name in ("of", "shift") for i in range(together)]
    entries = sized.sparkSession.createDataFrame(rows, "at int, less int, tag string, " + ", ".join(f"{name} int" for name in names))
    each = sized.crossJoin(F.broadcast(entries)).withColumn("other", F.col("n") - F.col("less"))
    inside = []
    for i in range(together):
        start, size = _bounds(F.col("other"), F.col(f"of{i}"), parts)
        start = start + F.col(f"shift{i}")
        inside.append(F.when(start >= 0, _part(F.col("wide"), start, size)))
    return each.select("id", *carried, "at", F.xxhash64(F.col("other").cast("int"), "tag", *inside).alias("key"))


def key_rows(lines: DataFrame, together: int, *carried: str) -> DataFrame:
    """(line, id) of lines -> (key, row) for all their keys, and columns carried along; the lowest bit of
    id isn't used."""
    sized = lines.select(line_id(F.col("id")).alias("id"), *carried, F.encode("line", "UTF-32").alias("wide"), F.length("line").alias("n"))
    both = F.col("id").bitwiseOR((F.col("at") < indexed_keys(together)).cast("long"))
    if together > 1:
        return planned_keys(sized, together, *carried).select("key", both.alias("row"), *carried)
    # keys as columns: a projection shares the expressions they have in common, a generator doesn't
    keys = line_keys(F.col("wide"), F.col("n"), together)
    names = [f"key{i}" for i in range(len(keys))]
    keyed = sized.select("id", *carried, *[k.alias(name) for k, name in zip(keys, names, strict=True)])
    return keyed.select("id", *carried, F.posexplode(F.array(*names)).alias("at", "key")).select("key", both.alias("row"), *carried)


def met_keys(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The keys by which an indexed line meets another line, and whether they may be broadcast.

    A key's least and greatest line tell whether it has two, so that a hot key costs a row a task; the
    rows, nearly all of which stand alone, are made again rather than shuffled with their key.
    """
    ends = rows.groupBy("key").agg(F.min("row").alias("least"), F.max("row").alias("most"), F.bit_or("row").alias("any"))
    ends = ends.filter((line_id(F.col("least")) != line_id(F.col("most"))) & (F.col("any").bitwiseAND(1) == 1))
    keys = scratch.cut(ends.select("key"), "keys")
    return keys, keys.count() <= BROADCAST_ROWS


def met_rows(lines: DataFrame, together: int, *carried: str) -> tuple[DataFrame, bool]:
    """The distinct (key, row) of keys that meet, and whether the columns to carry came along: only if
    keys are broadcast, since they would be shuffled with every key else."""
    keys, small = met_keys(key_rows(lines, together))
    rows = key_rows(lines, together, *carried).join(F.broadcast(keys), "key", "left_semi") if small else key_rows(lines, together).join(keys.hint("shuffle_hash"), "key", "left_semi")
    return scratch.cut(rows.distinct(), "met"), small


def meetings(met: DataFrame, texts: DataFrame, by: str, bucket: int) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs (u, v) of numbers from keys of at most ``bucket`` rows, and the (key, node) of
    hotter ones, if any."""
    hot = scratch.cut(met.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > bucket).select("key"), "hot")
    some = hot.limit(1).count() > 0
    few = met.join(hot, "key", "left_anti") if some else met
    signed = few.select("key", F.col("row").bitwiseAND(1).alias("indexed"), line_id(F.col("row")).alias(by)).join(texts.select("node", "counts", *({by} - {"node"})), by)
    a = signed.filter("indexed = 1").select("key", F.col("node").alias("u"), F.col("counts").alias("cu"))
    b = signed.select("key", F.col("node").alias("v"), F.col("counts").alias("cv"))
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("u") != F.col("v")) & (counts_apart(F.col("cu"), F.col("cv")) <= 2 * EDITS))
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    if not some:
        return pairs, None
    many = met.join(hot, "key", "left_semi").select("key", line_id(F.col("row")).alias(by)).distinct()
    return pairs, many.join(texts.select("node", *({by} - {"node"})), by).select("key", "node")


def within_one(text: Column, letters: Column) -> Column:
    """All texts over some letters within one edit of a text, which is of those letters itself."""
    n = F.length(text)
    # positions are taken from a split of the text, which has an entry (of none) where it is empty
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    left, right = (lambda i: F.substring(text, F.lit(1), i - 1)), (lambda i: F.substr(text, i))
    less = F.transform(at, lambda i: F.concat(left(i), right(i + 1)))
    other = F.flatten(F.transform(at, lambda i: F.transform(letters, lambda c: F.concat(left(i), c, right(i + 1)))))
    more = F.flatten(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.transform(letters, lambda c: F.concat(left(i), c, right(i)))))
    return F.array_distinct(F.concat(F.array(text), less, other, more))


def rests(many: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, node) of hot keys -> (key, node, n, rest, letters): lines without what all lines of their
    key have in common at both ends, and the letters of all rests; null where a line would have
    more than ``BALL`` texts within one edit."""
    line = texts.select("node", "line")
    first = many.groupBy("key").agg(F.min("node").alias("node")).join(line, "node").select("key", F.col("line").alias("centre"))
    both = many.join(line, "node").join(first, "key")
    ends = lambda a, b: _common(_pair(a, b, F.lit(0)))["lo"]
    both = both.select("key", "node", "line", F.length("line").alias("n"), ends(F.col("line"), F.col("centre")).alias("front"), ends(F.reverse("line"), F.reverse("centre")).alias("back"))
    both = scratch.cut(both, "ends")
    common = both.groupBy("key").agg(F.min("front").alias("p"), F.min("back").alias("s"), F.min("n").alias("short"), F.max("n").alias("long"))
    common = common.select("key", "p", F.least("s", F.col("short") - F.col("p")).alias("s"), "long")
    cut = both.join(common, "key").select("key", "node", "n", F.col("long") - F.col("p") - F.col("s"), F.substring("line", F.col("p") + 1, F.col("n") - F.col("p") - F.col("s")).alias("rest"))
    cut = cut.toDF("key", "node", "n", "room", "rest")
    small = cut.filter((F.col("room") + 1) * 2 <= BALL)
    letters = small.select("key", "room", F.explode(F.split("rest", "")).alias("c")).filter("c <> ''").distinct().groupBy("key", "room").agg(F.collect_list("c").alias("letters"))
    letters = letters.filter((F.col("room") + 1) * 2 * F.size("letters") <= BALL).select("key", "letters")
    return scratch.cut(cut.select("key", "node", "n", "rest").join(letters, "key", "left"), "rests")


def linked_rests(cut: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all lines of a hot key that are linked, through the texts within one
    edit of their rests; their number is in proportion to the lines."""
    spot = lambda z: [F.xxhash64("key", z).alias("z1"), F.xxhash64(F.lit("#"), "key", z).alias("z2")]
    near = cut.select("key", "node", "n", F.explode(within_one(F.col("rest"), F.col("letters"))).alias("z")).select("node", "n", *spot(F.col("z")))
    # two edits: both lines are long enough; each of them has a text in common with the other
    two = near.filter(F.col("n") >= EDITS * CHARS)
    centre = two.groupBy("z1", "z2").agg(F.min("node").alias("u"), F.max("node").alias("last")).filter(F.col("u") != F.col("last")).drop("last")
    star = two.join(centre, ["z1", "z2"]).filter("node <> u").select("u", F.col("node").alias("v"))
    # one edit, where the shorter line allows no more: a line is within one edit of the other
    own = cut.select(F.col("node").alias("u"), F.col("n").alias("m"), *spot(F.col("rest")))
    short = F.least("n", "m") < EDITS * CHARS
    one = near.filter(F.col("n") <= EDITS * CHARS).join(own.filter(F.col("m") <= EDITS * CHARS), ["z1", "z2"]).filter(short & (F.col("u") != F.col("node"))).select("u", F.col("node").alias("v"))
    return scratch.cut(star.unionAll(one).distinct(), "stars")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are linked."""
    x, y = texts.select(F.col("node").alias("u"), F.col("line").alias("a")), texts.select(F.col("node").alias("v"), F.col("line").alias("b"))
    # rows are few but each is costly: a number of partitions that isn't lowered by their size
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.join(x, "u").join(y, "v").repartition(parts)
    return both.filter(within_edits(F.col("a"), F.col("b"), allowed(F.length("a"), F.length("b")))).select("u", "v")


def dealt_pairs(many: DataFrame, texts: DataFrame) -> DataFrame:
    """All pairs of the lines of a key whose letter counts allow it, over tasks by blocks of both ends."""
    blocks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = many.join(texts.select("node", "counts"), "node").select("key", "node", "counts", F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("at"))
    b = signed.select(F.col("key").alias("key2"), F.col("node").alias("v"), F.col("counts").alias("cv"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("at2"))
    pairs = signed.join(b, (F.col("key") == F.col("key2")) & (F.col("at") == F.col("at2")) & (F.col("node") < F.col("v")) & (counts_apart(F.col("counts"), F.col("cv")) <= 2 * EDITS))
    return pairs.select(F.col("node").alias("u"), "v").distinct()


def near_lines(lines: DataFrame, bucket: int = BUCKET, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) whose components are those of all links, and (node, h1, h2, line) of the lines that
    meet another."""
    long = lines.filter(F.length("line") >= CHARS).select(line_id(F.col("h1")).alias("id"), "h1", "h2", "line")
    met, small = met_rows(long, 1, "h1", "h2", "line")
    if small:
        texts = met.select(line_id(F.col("h1")).alias("id"), "h1", "h2", "line").distinct()
        met = met.select("key", "row")
    else:
        ids = met.select(line_id(F.col("row")).alias("id")).distinct()
        texts = long.join(hashed(scratch.cut(ids, "ids"), BROADCAST_ROWS), "id", "left_semi").distinct()
    # an id may be of several lines; a number is of one
    texts = scratch.cut(texts.select("*", letter_counts(F.col("line")).alias("counts"), (F.monotonically_increasing_id() * 2).alias("node")), "texts")
    by, met_pairs, stars = "id", [], []
    for level in range(1, levels + 1):
        pairs, many = meetings(met, texts, by, bucket)
        met_pairs.append(pairs)
        if many is None:
            break
        cut = rests(many, texts)
        stars.append(linked_rests(cut.filter("letters IS NOT NULL")))
        left = scratch.cut(cut.filter("letters IS NULL").select("key", "node"), "left")
        if not left.limit(1).count():
            break
        if level == levels:
            met_pairs.append(dealt_pairs(left, texts))
            break
        again = texts.join(left.select("node").distinct(), "node", "left_semi")
        met, by = met_rows(again.select("line", F.col("node").alias("id")), level + 1)[0], "node"
    candidates = scratch.cut(reduce(DataFrame.unionAll, met_pairs).distinct(), "candidates")
    edges = reduce(DataFrame.unionAll, stars, verified(candidates, texts))
    return edges.distinct(), texts


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, line_no) of every line that isn't the first of its class."""
    lines = lines_of(docs.select("doc_id", "text"))
    edges, texts = near_lines(lines)
    parts = graphs.components(scratch.cut(edges, "links"))
    classes = bounded(scratch.cut(texts.select("node", "h1", "h2").join(parts, "node").select("h1", "h2", "component"), "classes"))
    number = dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint")
    own = F.col("t1").bitwiseAND(_SLOT - 1)
    if number:
        # one number, which a hash aggregate can hold; null ids come last
        slot = F.lit(_SLOT).cast("decimal(10,0)")
        wide = F.col("doc_id").cast("decimal(19,0)") * F.lit(_SLOT * _SLOT).cast("decimal(19,0)")
        low = (own.cast("decimal(10,0)") * slot + F.col("line_no")).cast("decimal(38,0)")
        spot = (F.coalesce(wide.cast("decimal(38,0)"), F.lit("9" + "0" * 37).cast("decimal(38,0)")) + low).cast("decimal(38,0)")
    else:
        spot = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", own.alias("own"), "line_no")
    narrow = scratch.cut(lines.select("h1", "h2", "doc_id", "t1", "t2", "line_no"), "lines").withColumn("spot", spot)
    groups = narrow.groupBy("h1", "h2").agg(F.min("spot").alias("first"), F.count("*").alias("n"))
    linked = groups.join(classes, ["h1", "h2"]).select("h1", "h2", "first", "component")
    least = linked.groupBy("component").agg(F.min("first").alias("stays"))
    linked = linked.join(least, "component").select("h1", "h2", "stays")
    single = groups.join(classes, ["h1", "h2"], "left_anti").filter("n > 1").select("h1", "h2", F.col("first").alias("stays"))
    stays = hashed(scratch.cut(linked.unionAll(single), "stays"), common.BROADCAST_ROWS)
    return narrow.join(stays, ["h1", "h2"]).filter(F.col("spot") != F.col("stays")).select("doc_id", "t1", "t2", "line_no")


def _gone(docs: DataFrame) -> DataFrame:
    """(gone_id, gone_t1, gone_t2, gone): the removed lines of each document, repeated rows as one."""
    gone = removed_lines(docs).groupBy("doc_id", "t1", "t2").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("t1").alias("gone_t1"), F.col("t2").alias("gone_t2"), "gone")
    return scratch.cut(gone, "gone")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, their texts without the removed lines.

    A text all of whose lines go is empty; its document stays.  A column n_chars follows.
    """
    row, id_, one, two, lines, split = (free_name(docs, n) for n in ("gone_row", "gone_key", "gone_t1", "gone_t2", "gone", "gone_parts"))
    gone = hashed(_gone(docs).toDF(id_, one, two, lines), BROADCAST_GONE)
    marked = docs.withColumn(row, F.struct(*document(F.col("text"))))
    same = marked["doc_id"].eqNullSafe(gone[id_]) & (marked[row]["t1"] == gone[one]) & (marked[row]["t2"] == gone[two])
    joined = marked.join(gone, same, "left").withColumn(split, F.when(F.col(lines).isNotNull(), F.split("text", "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(lines))
    text = F.when(F.col(lines).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(split), i)), "\n"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(lines).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*others(docs))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (that count), n_removed, removed_sha256 (numbers of the removed lines)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    gone = hashed(_gone(docs), BROADCAST_GONE)
    # lines that aren't blank, by what they begin with
    count = F.regexp_count("text", F.lit(r"(?md)^[\x20\t\x0B\f\r]*+[^\n\x20\t\x0B\f\r]"))
    sized = docs.select("doc_id", F.struct(*document(F.col("text"))).alias("row"), F.coalesce(count, F.lit(0)).cast("long").alias("n_lines"))
    same = sized["doc_id"].eqNullSafe(gone["gone_id"]) & (sized["row"]["t1"] == gone["gone_t1"]) & (sized["row"]["t2"] == gone["gone_t2"])
    joined = sized.join(gone, same, "left")
    digest = F.sha2(F.coalesce(F.array_join("gone", ","), F.lit("")), 256)
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), digest.alias("removed_sha256"))
