"""Rules by an automaton of literals against rules one by one."""

import random

import pytest
from pyspark.sql import functions as F

from fieldnotes.operators import rules

RULE = "name string, category string, kind string, header string, regex string, weight double"


@pytest.mark.parametrize(
    ("regex", "want"),
    [
        ("wp-content/", "wp-content/"),
        (r"cdn\.shopify\.com", "cdn.shopify.com"),
        ("wixstatic.com", "wixstatic"),
        (".+", None),
        ("ab", None),
        ("data-reactroot|__NEXT_DATA__", None),
        ("(?:one|two)three", "three"),
        ("abcd?e", "abc"),
        ("abcd*", "abc"),
        ("abcd{0,2}efg", "abc"),
        ("abcd+efgh", "abcd"),
        ("[abc]{3}long[^]x]tail", "long"),
        ("(?i)word", None),
        (r"\bword\b\d+", "word"),
        (r"^start$", "start"),
        (r"a\Qb.c\E", None),
        (r"[a-z&&[^b]]long", None),
        (r"x\\yz", r"x\yz"),
    ],
)
def test_required_literal(regex, want):
    assert rules.required_literal(regex) == want


def test_many_rules_equal_few(spark, monkeypatch):
    draw = random.Random(5)
    words = ["".join(draw.choice("abcd") for _ in range(draw.randint(2, 5))) for _ in range(300)]
    shapes = ["{}", "{}[0-9]?", "(?:{}|zz)x", "{}|{}", "^{}", "{}.+{}", "{}{{2}}", "[a-d]+{}", "(?i){}"]
    given = []
    for i in range(400):
        shape = draw.choice(shapes)
        kind = draw.choice(["html", "script_src", "header"])
        given.append((f"n{i % 90}", "c", kind, draw.choice(["Server", "x-a"]) if kind == "header" else None, shape.format(*draw.choices(words, k=2)), draw.choice([0.3, 0.6])))
    pages = [
        (i, " ".join(draw.choices(words, k=6)) + f'<script src="/{draw.choice(words)}.js"></script>', {"server": draw.choice(words), "X-A": draw.choice(words)} if i % 3 else None)
        for i in range(40)
    ]
    pages.append((99, None, None))
    p = spark.createDataFrame(pages, "page_id long, html string, headers map<string,string>")
    r = spark.createDataFrame(given, RULE)
    found = {}
    for name, at in (("automaton", 1), ("one by one", 10**6)):
        monkeypatch.setattr(rules, "MANY_RULES", at)
        found[name] = sorted(map(tuple, rules.detect(p, r).collect()))
    monkeypatch.setattr(rules, "MANY_RULES", 1)
    monkeypatch.setattr(rules, "BROADCAST_RULES", 150)
    found["slices"] = sorted(map(tuple, rules.detect(p, r).collect()))
    assert found["automaton"] == found["one by one"] == found["slices"] and len(found["slices"]) > 100


def test_five_thousand_rules_in_one_scan(spark):
    r = spark.range(5000).select(F.concat(F.lit("rule"), "id").alias("name"), F.lit("c").alias("category"), F.lit("html").alias("kind"), F.lit(None).cast("string").alias("header"), F.concat(F.lit("tag-"), F.col("id"), F.lit("/")).alias("regex"), F.lit(0.6).alias("weight"))
    p = spark.range(60).select(F.col("id").alias("page_id"), F.concat(F.lit("a tag-"), F.col("id") * 7, F.lit("/ tag-9999/")).alias("html"), F.create_map().cast("map<string,string>").alias("headers"))
    assert sorted((x["page_id"], x["name"]) for x in rules.detect(p, r).collect()) == sorted((i, f"rule{i * 7}") for i in range(60))
