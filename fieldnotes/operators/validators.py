"""Deterministic checks of drafted texts, opportunities and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldnotes.functions import money
from fieldnotes.functions import text as x

# Phrases no draft may hold, compared in lower case.
BANNED = (
    "i hope this email finds you well",
    "i came across your business",
    "quick question",
    "circle back",
    "touch base",
    "synergy",
    "synergies",
    "leverage",
    "leveraging",
    "revolutionary",
    "cutting-edge",
    "game-changer",
    "game changer",
    "10x",
    "crushing it",
    "move the needle for",
    "growth hack",
    "growth-hacked",
    "just checking in",
    "following up on my last",
    "to whom it may concern",
    "dear sir/madam",
    "unlock your potential",
    "take it to the next level",
)
URL = r"(?i)https?://|www\."


def anchors_in(body: Column, anchors: Column) -> Column:
    """How many anchors a text holds, letters of either case alike."""
    return F.size(F.filter(anchors, lambda a: F.lower(body).contains(F.lower(a)))).cast("long")


def email_compliance(drafts: DataFrame) -> DataFrame:
    """(draft_id, words, subject_words, anchors, banned, emojis, bracketed, ok) of (draft_id, subject, body, anchors)."""
    banned = F.filter(F.array(*[F.lit(p) for p in BANNED]), lambda p: F.lower("body").contains(p))
    out = drafts.select(
        "draft_id",
        x.word_count(F.col("body")).alias("words"),
        x.word_count(F.col("subject")).alias("subject_words"),
        anchors_in(F.col("body"), F.col("anchors")).alias("anchors"),
        F.array_join(banned, ",").alias("banned"),
        F.regexp_count("subject", F.lit(x.EMOJI)).cast("long").alias("emojis"),
        F.col("subject").rlike(r"^\s*\[").alias("bracketed"),
    )
    ok = (F.col("words") <= 120) & (F.col("subject_words") <= 7) & (F.col("anchors") >= 2) & (F.col("banned") == "") & (F.col("emojis") == 0) & ~F.col("bracketed")
    return out.withColumn("ok", ok)


def whatsapp_compliance(drafts: DataFrame) -> DataFrame:
    out = drafts.select(
        "draft_id",
        x.word_count(F.col("body")).alias("words"),
        F.col("body").rlike(URL).alias("has_url"),
        F.regexp_count("body", F.lit(x.EMOJI)).cast("long").alias("emojis"),
        anchors_in(F.col("body"), F.col("anchors")).alias("anchors"),
    )
    return out.withColumn("ok", (F.col("words") <= 40) & ~F.col("has_url") & (F.col("emojis") <= 1) & (F.col("anchors") >= 1))


def verbatim_quotes(drafts: DataFrame, column: str = "body", phrases: str = "phrases") -> DataFrame:
    """Whether a text quotes one of its input phrases word for word."""
    return drafts.withColumn("quoted", F.exists(phrases, lambda p: F.col(column).contains(p)))


def roi_payback(estimates: DataFrame) -> DataFrame:
    return estimates.select("opportunity_id", F.round(money.payback_months(F.col("setup"), F.col("expected"), F.col("run_cost")), 4).alias("payback_months"))


def roi_bounds(estimates: DataFrame, most: float = 50_000.0) -> DataFrame:
    ordered = (F.col("low") <= F.col("expected")) & (F.col("expected") <= F.col("high"))
    n = F.size("assumptions")
    return estimates.select("opportunity_id", ordered.alias("ordered"), (F.col("expected") <= most).alias("bounded"), n.between(2, 5).alias("enough_assumptions"), (ordered & (F.col("expected") <= most) & n.between(2, 5)).alias("ok"))


def rank_opportunities(rows: DataFrame, catalogue: DataFrame, least: int = 3, most: int = 7) -> DataFrame:
    """Known opportunities with two or more evidence items, best first, at most ``most`` a company;
    ``enough`` tells if a company has ``least``."""
    known = rows.join(catalogue.select("id"), "id", "left_semi").filter(F.col("evidence") >= 2)
    w = Window.partitionBy("company_id")
    ranked = known.withColumn("rank", F.row_number().over(w.orderBy(F.desc("priority_score"), "id")).cast("long")).filter(F.col("rank") <= most)
    return ranked.withColumn("enough", F.count("*").over(w) >= least)


def size_rules(rows: DataFrame, rules: dict[str, tuple[int, int]]) -> DataFrame:
    """Array columns within their bounds, a boolean column each."""
    return rows.select(*[c for c in rows.columns if c not in rules], *[F.size(c).between(*b).alias(f"{c}_ok") for c, b in rules.items()])


def guards(audits: DataFrame) -> DataFrame:
    """What a site's numbers call for: a headless retry, a human look, a rebuild, search fixes."""
    return audits.select(
        "site",
        (F.col("total_words") < 200).alias("empty_extraction"),
        (F.col("confidence") < 0.5).alias("low_confidence"),
        (F.col("performance") < 50).alias("rebuild"),
        (F.col("seo") < 70).alias("search_fixes"),
    )


# Word caps of a proposal's sections.
SECTIONS = {"executive_summary": 80, "the_problem": 120, "what_we_propose": 160, "expected_outcome": 120}


def proposal_caps(proposals: DataFrame) -> DataFrame:
    """(draft_id, words of each section, ok): sections within their caps, missing ones having no words."""
    words = {n: F.coalesce(x.word_count(F.col(n)), F.lit(0).cast("long")) for n in SECTIONS}
    ok = F.lit(True)
    for n, most in SECTIONS.items():
        ok = ok & (words[n] <= most)
    return proposals.select("draft_id", *[w.alias(n) for n, w in words.items()], ok.alias("ok"))


# Lists of a contract: (least, most) items, and characters an item may have.
LISTS = {"evidence": (3, None, None), "value_props": (None, 5, 100), "talking_points": (None, 3, None), "objections": (None, 3, None)}


def list_contracts(rows: DataFrame) -> DataFrame:
    """(id, a boolean for each list, longest value proposition, ok); a null list is an empty one."""
    checks = {}
    for name, (least, most, chars) in LISTS.items():
        items = F.coalesce(F.col(name), F.array().cast("array<string>"))
        ok = F.size(items) >= (least or 0)
        ok = ok & (F.size(items) <= most) if most is not None else ok
        checks[f"{name}_ok"] = ok & (F.size(F.filter(items, lambda v: F.length(v) > chars)) == 0) if chars else ok  # noqa: B023
    longest = F.coalesce(F.array_max(F.transform("value_props", F.length)), F.lit(0)).cast("long")
    every = F.lit(True)
    for ok in checks.values():
        every = every & ok
    return rows.select("id", *[ok.alias(n) for n, ok in checks.items()], longest.alias("longest_value_prop"), every.alias("ok"))
