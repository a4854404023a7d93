"""Technology rules against pages, and the gaps of a stack.

Rules are rows (name, category, kind, header, regex, weight).  A signal is tested only against its own kind's
value.  Few rules meet each value of their kind by a broadcast of the rule table.  Many are looked for by an
automaton of literals that their patterns can't match without: one pass over a value finds all rules whose
literal it has, and only these, and the rules without a literal, are tested.  Either way the JVM tests the
patterns, so both give the same rows.  Rule tables over ``BROADCAST_RULES`` are applied in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnotes.functions import text as x

try:
    import ahocorasick
except ImportError:  # many rules are then slower
    ahocorasick = None

#: From so many rules on the automaton pays.
MANY_RULES = 200
#: Rules that are broadcast at a time.
BROADCAST_RULES = 50_000
#: A literal of fewer characters is in too many values to be worth looking for.
LITERAL = 3
# Categories whose absence is worth a pitch.
GAPS = ("chat", "crm", "booking", "marketing", "reviews")


def values(pages: DataFrame) -> DataFrame:
    """(page_id, kind, header, value): what signals are tested against."""
    html = F.col("html")
    entry = lambda kind, header, value: F.struct(F.lit(kind).alias("kind"), header.cast("string").alias("header"), value.alias("value"))
    none = F.lit(None)
    listed = F.flatten(
        F.array(
            F.array(entry("html", none, html), entry("meta_generator", none, x.meta(html, "generator"))),
            F.transform(x.script_sources(html), lambda s: entry("script_src", none, s)),
            F.transform(x.json_ld_types(html), lambda t: entry("json_ld", none, t)),
            F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: entry("header", F.lower(e["key"]), e["value"])),
        )
    )
    return pages.select("page_id", F.explode(listed).alias("v")).select("page_id", "v.*").filter("value <> ''")


def required_literal(regex: str) -> str | None:
    """The longest text that whatever matches the pattern must hold, as far as that is plain to see; None for
    alternatives at the top, flags, and texts of under ``LITERAL`` characters."""
    runs, run, depth, i = [], "", 0, 0
    while i < len(regex):
        c, size, literal = regex[i], 1, False
        if c == "\\" and i + 1 < len(regex):
            size, literal = 2, not regex[i + 1].isalnum()
            c = regex[i + 1]
            if c == "Q":
                return None
        elif c == "[":
            j = i + 1 + (regex[i + 1 : i + 2] == "^")
            j += regex[j : j + 1] == "]"
            while j < len(regex) and regex[j] != "]":
                if regex[j] == "[" or regex[j : j + 2] == "&&":
                    return None
                j += 2 if regex[j] == "\\" else 1
            size = j + 1 - i
        elif c == "(":
            if regex.startswith("(?", i) and not regex.startswith("(?:", i):
                return None
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            return None
        elif c in "*?{" and run:
            run = run[:-1]  # may be there no time
        else:
            literal = c not in ".^$*+?{}|"
        i += size
        if literal and depth == 0:
            run += c
        else:
            if c == "{":
                i = regex.find("}", i) + 1 or len(regex)
            runs.append(run)
            run = ""
    best = max([*runs, run], key=len)
    return best if len(best) >= LITERAL else None


def _candidates(numbered: list[tuple[int, str, str | None, str]]):
    """A function of (kind, header, value) that gives the numbers of the rules whose literal a value has."""
    literals: dict[tuple[str, str | None], dict[str, list[int]]] = {}
    always: dict[tuple[str, str | None], list[int]] = {}
    for number, kind, header, regex in numbered:
        literal = required_literal(regex)
        if literal is None:
            always.setdefault((kind, header), []).append(number)
        else:
            literals.setdefault((kind, header), {}).setdefault(literal, []).append(number)

    def look(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        automata = {}
        for of, words in literals.items():
            automata[of] = ahocorasick.Automaton()
            for word, numbers in words.items():
                automata[of].add_word(word, numbers)
            automata[of].make_automaton()
        for kinds, headers, values_ in batches:
            out = []
            for kind, header, value in zip(kinds, headers, values_, strict=True):
                of = (kind, header)
                found = {n for _, numbers in automata[of].iter(value) for n in numbers} if of in automata else set()
                out.append([*always.get(of, ()), *sorted(found)])
            yield pd.Series(out)

    return F.pandas_udf(look, "array<int>")


def _matches(found: DataFrame, rules: DataFrame, n: int) -> DataFrame:
    """(page_id, name, category, rule_kind, regex, weight) of the rules that match, each once a page."""
    keep = ["page_id", "name", "category", "rule_kind", "regex", "weight"]
    rule = rules.select("name", "category", F.col("kind").alias("rule_kind"), F.lower("header").alias("rule_header"), "regex", "weight")
    if n < MANY_RULES or ahocorasick is None:
        on = (F.col("kind") == F.col("rule_kind")) & F.col("header").eqNullSafe(F.col("rule_header"))
        return found.join(F.broadcast(rule), on).filter(F.expr("value rlike regex")).select(keep).distinct()
    rows = sorted(rule.distinct().collect(), key=repr)  # at most BROADCAST_RULES
    look = _candidates([(i, r["rule_kind"], r["rule_header"], r["regex"]) for i, r in enumerate(rows)])
    numbered = found.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "number int, " + ", ".join(f"{c} {t}" for c, t in rule.dtypes))
    near = found.select("page_id", "value", F.explode(look("kind", "header", "value")).alias("number"))
    return near.join(F.broadcast(numbered), "number").filter(F.expr("value rlike regex")).select(keep).distinct()


def detect(pages: DataFrame, rules: DataFrame, least: float = 0.5) -> DataFrame:
    """(page_id, name, category, confidence, signals): technologies over the confidence bound.

    Confidence is the sum of the weights of the signals that match, each counted once, at most 1.
    """
    n = rules.count()
    slices = max(1, -(-n // BROADCAST_RULES))
    found = values(pages)
    numbered = rules.withColumn("slice", F.pmod(F.xxhash64("name", "kind", "regex"), F.lit(slices)))
    matched = reduce(DataFrame.unionByName, [_matches(found, numbered.filter(F.col("slice") == i) if slices > 1 else rules, n) for i in range(slices)])
    by_rule = matched.groupBy("page_id", "name", "category").agg(F.round(F.least(F.sum("weight"), F.lit(1.0)), 6).alias("confidence"), F.count("*").alias("signals"))
    return by_rule.filter(F.col("confidence") > least)


def gaps(pages: DataFrame, detected: DataFrame, categories: tuple[str, ...] = GAPS) -> DataFrame:
    """(page_id, category): the categories in which nothing was detected; all of them for a page
    without any technology."""
    wanted = F.array(*[F.lit(c) for c in categories])
    have = detected.groupBy("page_id").agg(F.collect_set("category").alias("have"))
    missing = F.array_except(wanted, F.coalesce("have", F.array().cast("array<string>")))
    return pages.select("page_id").distinct().join(have, "page_id", "left").select("page_id", F.explode(missing).alias("category"))
