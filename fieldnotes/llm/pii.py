"""Personal data by weak supervision, in DataFrame operations only.

Base spans are what strict patterns and their checks accept: e-mail addresses, IPv4 addresses,
payment cards that pass Luhn, phone numbers.  Wider patterns propose further candidates: written-out
e-mail addresses, IPv6 addresses, card-like numbers that fail Luhn, phone numbers without a plus.
Four labelers vote for, against or not at all on every candidate: *regex* (the strict pattern and
its checks), *gazetteer* (top-level domains, calling codes, issuer prefixes, reserved networks),
*context* (words just before the span) and *shape* (what touches it).

Expectation-maximisation estimates each labeler's reliability and each kind's prior from how votes
agree, without labels.  The result, a posterior for each pattern of votes, trains the final span
classifier, a logistic model over kind, votes and two marks of the span itself that no labeler sees: how
many digits it has, and whether it is separated.  Base spans always stay; the classifier decides which of
the other candidates join them, the likelier of two that overlap.  Both fits see only the histogram of
votes and marks, at most 4 * 3**4 * 8 rows whatever the input, so they run on the driver in plain
arithmetic.

Patterns scan left to right without recursion and without quadratic restarts: runs are possessive,
and a match starts only where its run starts or where the last match ended.  Offsets come from the
lengths of the pieces between matches, in code points, in one pass.

Plan: one scan of the texts, no shuffle of documents.  Candidates without text are kept in a table in
the shared folder; the histogram is a partial aggregate of it, the decision a projection.

Defined cases: null counts as empty; empty texts have no spans; repeated rows each get a row; very long
texts are scanned whole; without candidates the classifier adds nothing; other columns stay, and where
``into`` names one, it is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldnotes.llm import scratch
from fieldnotes.llm.common import free_name, read

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context", "shape")
CONTEXT = 40

_MAIL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # runs of fewer than 13 digits can't pass, and don't shift where a longer run begins
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?:\G|(?<!{_MAIL})){_MAIL}++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{2,4}\)|00[1-9][0-9]{0,2}|[0-9]{3})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: A text without this has no span of the kind.
NEEDS = {"email": "@|[\\(\\[]at[\\)\\]]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"[0-9][\x20().-]+[0-9]|\+[0-9]"}

# Top-level domains that vouch for an address.
DOMAINS = "com org net edu gov mil int info biz io co ai dev app me example test eu de fr es it nl be at ch uk us ca au nz jp cn in br mx ru pl se no fi dk pt ie cz gr tr ae".split()
# Calling codes of one to three digits.
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 220 221 225 233 234 237 244 249 250 251 254 255 256 260 263 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 380 381 382 385 386 387 389 420 421 852 853 855 856 880 886 961 962 963 964 965 966 967 968 970 971 972 973 974 975 976 977 992 993 994 995 996 998".split()
# Prefixes of card issuers.
ISSUERS = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|35|30[0-5]|36|38|6011|64[4-9]|65|62)"
# Words before a span that speak for or against it.
FOR = {
    "email": r"(?i)mail|contact|write to|courriel|correo|kontakt",
    "ip": r"(?i)\bip\b|address|host|server|adresse|direcci",
    "card": r"(?i)card|visa|master|amex|carte|karte|tarjeta|payment",
    "phone": r"(?i)phone|\btel\b|call|mobile|fax|whatsapp|telefon|t[ée]l[ée]phone|tel[ée]fono",
}
AGAINST = r"(?i)(?:version|order|invoice|isbn|issn|section|figure|ticket|serial|commit|sha|token|key)[^a-z]{0,12}$"


def _all(text: Column, pattern: str, kind: str) -> Column:
    """Every match of a pattern: start, end (code points), m, before, after."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    near = F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(CONTEXT)).alias("tail"), F.left(p, F.lit(1)).alias("head")))
    rest = F.slice(near, 2, F.greatest(F.size(near) - 1, F.lit(0)))
    rows = F.arrays_zip(found.alias("m"), F.slice(near, 1, F.greatest(F.size(near) - 1, F.lit(0))).alias("a"), rest.alias("b"))
    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")

    def add(state: Column, r: Column) -> Column:
        start = state["at"] + r["a"]["n"]
        end = start + F.length(r["m"])
        span = F.struct(start.alias("start"), end.alias("end"), r["m"].alias("m"), r["a"]["tail"].alias("before"), r["b"]["head"].alias("after"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda s: s["spans"])
    return F.when(text.rlike(NEEDS[kind]) & text.rlike(pattern), spans).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The checks of a base match."""
    digits = _digits(m)
    if kind == "ip":
        small = F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(small, lambda p: F.when(F.length(p) <= 3, F.coalesce(F.nullif(p, F.lit("")).cast("int"), F.lit(0)) <= 255).otherwise(False))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _gazetteer(kind: str, m: Column) -> Column:
    digits = _digits(m)
    if kind == "email":
        known = F.lower(F.regexp_extract(m, "([A-Za-z0-9-]+)$", 1)).isin(DOMAINS)
        return _vote(known, ~known)
    if kind == "ip":
        reserved = m.rlike(r"^(?:0|22[4-9]|2[3-5][0-9])\.")
        return _vote(~reserved, reserved)
    if kind == "card":
        known = digits.rlike(ISSUERS)
        return _vote(known, ~known)
    national = m.rlike(r"^(?:\([2-9]|[2-9])")
    abroad = m.rlike(r"^(?:\+|00)") & F.regexp_replace(digits, "^00", "").rlike(f"^(?:{'|'.join(CALLING)})")
    return _vote(national | abroad, ~(national | abroad))


def _marks(m: Column) -> Column:
    """How many digits a span has (none, under 9, under 13, more), and whether its parts are separated."""
    n = F.length(_digits(m))
    some = F.when(n == 0, 0).when(n < 9, 1).when(n < 13, 2).otherwise(3)
    return F.array(some, m.rlike(r"[0-9][\x20().-]+[0-9]").cast("int"))


def _voted(spans: Column, kind: str, base: bool) -> Column:
    """Candidates with their votes; base ones have failed or passed the checks."""

    def one(s: Column) -> Column:
        m, before, after = s["m"], s["before"], s["after"]
        ok = valid(kind, m) if base else F.lit(None).cast("boolean")
        touched = before.rlike(r"[A-Za-z0-9_=#/\"]$") | after.rlike(r"^[A-Za-z0-9_=#/\"]")
        apart = before.rlike(r"(?:^|[\s(:,;>])$") & (after.rlike(r"^[\s).,;:<]") | (after == ""))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.coalesce(ok, F.lit(False)).alias("base"),
            (F.length(_digits(m)).between(13, 19) if kind == "card" else F.lit(True)).alias("fit"),
            F.array(_vote(ok, ~ok) if base else F.lit(0), _gazetteer(kind, m), _vote(before.rlike(FOR[kind]), before.rlike(AGAINST)), _vote(apart, touched)).alias("votes"),
            _marks(m).alias("marks"),
        )

    return F.transform(spans, one)


def candidates(docs: DataFrame, into: str = "candidates") -> DataFrame:
    """All rows and columns of ``docs`` with an array ``candidates`` (or ``into``): kind, start, end, base,
    votes, marks.

    A match of a base pattern that fails its checks is a candidate for a card only; a wide match
    is one if it touches no base span.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    strict = F.flatten(F.array(*[_voted(_all(text, BASE[k], k), k, True) for k in KINDS]))
    wide = F.flatten(F.array(*[_voted(_all(text, WIDE[k], k), k, False) for k in WIDE]))
    out = docs.withColumn(into, F.struct(strict.alias("strict"), wide.alias("wide")))
    found = F.col(into)
    base = F.filter(found["strict"], lambda s: s["base"])
    failed = F.filter(found["strict"], lambda s: ~s["base"] & s["fit"] & (s["kind"] == KINDS.index("card")))
    out = out.withColumn(into, F.struct(base.alias("base"), F.concat(failed, found["wide"]).alias("more")))
    free = F.filter(found["more"], lambda s: ~F.exists(found["base"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    free = F.when(F.size(found["more"]) > 0, free).otherwise(found["more"])
    return out.withColumn(into, F.transform(F.concat(found["base"], free), lambda s: s.dropFields("fit")))


Pattern = tuple[int, tuple[int, ...], tuple[int, ...]]


class Classifier:
    """Reliabilities by expectation-maximisation, and the logistic model trained on its result."""

    def __init__(self, histogram: dict[Pattern, int], rounds: int = 60):
        self.prior = {k: 0.5 for k in range(len(KINDS))}
        self.hit, self.pass_ = [0.8] * len(LABELERS), [0.8] * len(LABELERS)
        voted: dict[tuple[int, tuple[int, ...]], int] = {}
        for (kind, votes, _), n in histogram.items():
            voted[kind, votes] = voted.get((kind, votes), 0) + n
        posterior: dict[tuple[int, tuple[int, ...]], float] = {}
        for _ in range(rounds):
            for kind, votes in voted:
                yes, no = math.log(self.prior[kind]), math.log(1 - self.prior[kind])
                for j, v in enumerate(votes):
                    if v:
                        yes += math.log(self.hit[j] if v > 0 else 1 - self.hit[j])
                        no += math.log(1 - self.pass_[j] if v > 0 else self.pass_[j])
                posterior[kind, votes] = 1 / (1 + math.exp(min(no - yes, 700)))
            for kind in self.prior:
                n = sum(c for (k, _), c in voted.items() if k == kind)
                self.prior[kind] = (1 + sum(c * posterior[k, v] for (k, v), c in voted.items() if k == kind)) / (2 + n)
            for j in range(len(LABELERS)):
                good = [(c * posterior[k, v], v[j]) for (k, v), c in voted.items() if v[j]]
                bad = [(c * (1 - posterior[k, v]), v[j]) for (k, v), c in voted.items() if v[j]]
                # priors keep a labeler better than chance, so that "personal" stays the tag it means
                self.hit[j] = min(0.999, max(0.55, (8 + sum(c for c, v in good if v > 0)) / (10 + sum(c for c, _ in good))))
                self.pass_[j] = min(0.999, max(0.55, (8 + sum(c for c, v in bad if v < 0)) / (10 + sum(c for c, _ in bad))))
        self.posterior = posterior
        self.offset, self.weight = [0.0] * len(KINDS), [1.0] * len(LABELERS)
        #: By kind and number of digits, and by kind if separated.
        self.digits, self.parted = [[0.0] * 4 for _ in KINDS], [0.0] * len(KINDS)
        total = sum(histogram.values()) or 1
        for _ in range(400):
            d_offset, d_weight = [-0.001 * x for x in self.offset], [-0.001 * x for x in self.weight]
            d_digits, d_parted = [[-0.001 * x for x in row] for row in self.digits], [-0.001 * x for x in self.parted]
            for (kind, votes, (digits, parted)), n in histogram.items():
                z = self.offset[kind] + self.digits[kind][digits] + self.parted[kind] * parted + sum(w * v for w, v in zip(self.weight, votes, strict=True))
                error = n / total * (posterior[kind, votes] - 1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
                d_offset[kind] += error
                d_digits[kind][digits] += error
                d_parted[kind] += error * parted
                for j, v in enumerate(votes):
                    d_weight[j] += error * v
            self.offset = [x + 2 * d for x, d in zip(self.offset, d_offset, strict=True)]
            self.weight = [x + 2 * d for x, d in zip(self.weight, d_weight, strict=True)]
            self.digits = [[x + 2 * d for x, d in zip(row, step, strict=True)] for row, step in zip(self.digits, d_digits, strict=True)]
            self.parted = [x + 2 * d for x, d in zip(self.parted, d_parted, strict=True)]

    def score(self, kind: Column, votes: Column, marks: Column) -> Column:
        """The log-odds that a candidate is personal data."""
        by_kind = lambda values: F.element_at(F.array(*values), kind + 1)
        number = lambda x: F.lit(float(x))
        z = by_kind([number(x) for x in self.offset]) + by_kind([number(x) for x in self.parted]) * F.get(marks, 1)
        z = z + F.element_at(by_kind([F.array(*map(number, row)) for row in self.digits]), F.get(marks, 0) + 1)
        for j, w in enumerate(self.weight):
            z = z + F.get(votes, j) * number(w)
        return z


def fit(found: DataFrame, column: str = "candidates") -> Classifier:
    """A classifier from the votes and marks of all candidates."""
    one = found.select(F.explode(column).alias("c")).groupBy("c.kind", "c.votes", "c.marks").agg(F.count("*").alias("n"))
    return Classifier({(r["kind"], tuple(r["votes"]), tuple(r["marks"])): r["n"] for r in one.collect()})


def decide(found: DataFrame, model: Classifier, column: str = "candidates", into: str = "spans") -> DataFrame:
    """The column of candidates becomes ``spans`` (or ``into``): kind, start, end, base, in the order of
    kinds and starts."""
    each = F.col(column)
    scored = F.transform(F.filter(each, lambda s: ~s["base"]), lambda s: F.struct((-model.score(s["kind"], s["votes"], s["marks"])).alias("against"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base")))
    likely = F.array_sort(F.filter(scored, lambda s: s["against"] <= 0))  # the likeliest first
    slim = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))
    none = F.filter(F.transform(each, slim), lambda s: F.lit(False))

    def add(kept: Column, s: Column) -> Column:
        free = ~F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
        return F.when(free, F.concat(kept, F.array(slim(s)))).otherwise(kept)

    added = F.aggregate(likely, none, add)
    spans = F.array_sort(F.concat(F.transform(F.filter(each, lambda s: s["base"]), slim), added))
    return found.withColumn(column, spans) if into == column else found.withColumn(into, spans).drop(column)


def find(docs: DataFrame, into: str = "spans") -> DataFrame:
    """All rows and columns of ``docs`` with ``spans`` (or ``into``); reads the documents twice."""
    own = free_name(docs, "candidates")
    found = candidates(docs, own)
    return decide(found, fit(found, own), own, into)


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scratch.cut(candidates(docs).select("doc_id", "candidates"), "candidates")
    spans = decide(found, fit(found))
    base = F.filter("spans", lambda s: s["base"])
    counts = [_count(base, i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
