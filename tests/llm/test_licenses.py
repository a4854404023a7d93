"""Every notice is found as a line of a longer text."""

import textwrap

import pytest
from pyspark.sql import functions as F
from test_operators_llm import DOCS

from fieldnotes.llm import licenses


@pytest.mark.parametrize("rows", [256, 0])
def test_each_notice_is_found_as_a_line(spark, monkeypatch, rows):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", rows)
    notices = [n for n in licenses.NOTICES if "\n" not in n[1]] + [("Own", "Do as you please with it.")]
    docs = spark.createDataFrame([(i, f"a first line\n\n{text}\nand a last one", "en", "a", 0) for i, (_, text) in enumerate(notices)], DOCS)
    found = licenses.scan(docs, licenses.catalogue(spark, tuple(notices))).select("doc_id", "licenses.lines", "licenses.n_lines").collect()
    assert {r["doc_id"]: (r["lines"], r["n_lines"]) for r in found} == {i: ([name], 1) for i, (name, _) in enumerate(notices)}


def found(spark, rows, known=None, **more):
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(rows)], DOCS)
    out = licenses.scan(docs, known or licenses.catalogue(spark), **more)
    return [tuple(r) for r in out.orderBy("doc_id").select("licenses.whole", "licenses.lines", "licenses.n_lines").collect()]


@pytest.mark.parametrize("rows", [256, 0])
def test_whole_texts_with_other_copyright_lines_and_spellings(spark, monkeypatch, rows):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", rows)
    long = [(n, t) for n, t in licenses.NOTICES if len(t) > 200]
    head = ["Copyright (c) 2021 A. Person\n\n", " * Copyright 1999-2003, The Regents\n", "(c) 2020 Somebody\n", "© Somebody\n\n"]
    docs = [head[i % 4] + t.replace("Software", "SOFTWARE").replace(", ", ",  ") for i, (_, t) in enumerate(long)]
    assert [r[0] for r in found(spark, docs)] == [n for n, _ in long]


def test_only_lines_that_state_a_copyright_go(spark):
    known = licenses.catalogue(spark, (("Own", "Do as you please.\nCopyright holders may not be named.\n(c) You must say so."),))
    texts = ["Copyright 2020 X\nDo as you please.\nCopyright holders may not be named.\n(c) You must say so.", "Do as you please.\n(c) You must say so.", "Do as you please.\nCopyright holders may not be named."]
    assert [r[0] for r in found(spark, texts, known)] == ["Own", None, None]


def test_digests_alone_are_enough(spark):
    text = "Some terms,\nwith a second line"
    own = spark.range(1).select(licenses.digest(F.lit(text))).first()[0]
    known = licenses.catalogue(spark, (), (("Long", own),))
    assert found(spark, [text.upper(), "with a second line", None, "", "?!"], known) == [("Long", [], 0), *[(None, [], 0)] * 4]
    assert all(len(x) == 64 for _, x in licenses.DIGESTS)


@pytest.mark.parametrize("rows", [256, 0])
def test_repeated_rows_and_clashing_columns(spark, monkeypatch, rows):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", rows)
    text = "Released under the MIT License.\nReleased under the MIT License.\nlicensed under the MIT licence"
    docs = spark.createDataFrame([(1, text, "a", "b", "c")] * 3 + [(None, None, "a", "b", "c")], "doc_id long, text string, licenses string, license_row string, known string")
    out = licenses.scan(docs, licenses.catalogue(spark), into="terms").collect()
    assert [(r["licenses"], r["license_row"], r["known"]) for r in out] == [("a", "b", "c")] * 4
    assert sorted((r["terms"]["n_lines"], r["terms"]["lines"]) for r in out) == [(0, []), *[(3, ["MIT"])] * 3]


TITLES = {
    "MIT": ["MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License:"],
    "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "Zlib": ["zlib License", "The zlib License (Zlib)"],
    "BSL-1.0": ["", "Boost Software License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}


@pytest.mark.parametrize("width", [60, 72, 79])
def test_titles_reserved_rights_and_line_breaks(spark, width):
    """As in a file: title, statement, then the text in paragraphs of a width."""
    long = [(n, t) for n, t in licenses.NOTICES if len(t) > 200]
    docs, names = [], []
    for i, (name, text) in enumerate(long):
        body = "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))
        for title in TITLES[name]:
            docs.append(f"{title}\n\nCopyright (c) 2019-2024, A. Person\n{'All rights reserved.' if i % 2 else ''}\n\n{body}\n")
            docs.append(docs[-1].replace("\n", "\r\n"))
            names += [name, name]
    assert [r[0] for r in found(spark, docs)] == names


def test_only_whole_lines_are_titles(spark):
    known = licenses.catalogue(spark, (("Own", "Do as you please."),))
    texts = ["The MIT License\nDo as you please.", "The MIT License says\nDo as you please.", "Do as you please. All rights reserved.", "MIT License"]
    assert [r[0] for r in found(spark, texts, known)] == ["Own", None, None, None]


def test_spellings_are_words_and_span_lines(spark):
    form = spark.createDataFrame([("GPL, Version\n3 & on",), ("conversion of",), ("non-\ninfringement; sub-licence, \u201cas is\u201d",)], "text string").select(licenses.canonical(F.col("text"))).collect()
    assert [r[0] for r in form] == ["gpl v3 and on", "conversion of", "noninfringement sublicense as is"]


def test_statements_of_copyright(spark):
    gone = ["Copyright 2020 X and others", "Copyright: 1999-2003", "Copyright The Regents 1994. All rights reserved.", "(C) 2001, Y", "\u00a9 Z", "# Copyright X (c) Y"]
    kept = ["Copyright treaty adopted on 20 December 1996, or", "Copyright holders", "(c) You must"]
    out = spark.createDataFrame([(x,) for x in gone + kept], "text string").select(licenses.canonical(F.col("text"))).collect()
    assert [bool(r[0]) for r in out] == [False] * len(gone) + [True] * len(kept)
