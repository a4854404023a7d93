"""Blocks, readability and Markdown of awkward HTML; phone numbers; structured data."""

import pytest
from pyspark.sql import functions as F

from fieldnotes.functions import html as h
from fieldnotes.functions import phones


def markdown(spark, *pages):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id int, html string").select("id", h.parsed(F.col("html")).alias("page"))
    found = rows.select("id", h.as_markdown(h.main_blocks(F.col("page"))).alias("m"), h.words(h.main_blocks(F.col("page"))).alias("w")).orderBy("id").collect()
    return [r["m"] for r in found], [r["w"] for r in found]


RICH = """<html><head><title>T &amp; x</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></ul></nav>
<div id=main><h2>Hi <b>there</b></h2><p>One two <a href="/x"> three four</a> five.<p>Second <b>bold  <i>both</b> x<br>line<ul><li>a<li><p>b</p><ul><li>c</ul><li>d</ul>
<table><tr><th>K<th>V<tr><td>a|b<td><p>x</p><p>y</p></tr></table><dl><dt>Term<dd>Def one<dd>Def two</dl><pre>  code
   here </pre><ol><li>one<li>two</ol> tail text</div><div class="top ad-box">buy buy buy</div><footer>foot</footer><script>if (1 < 2) "</p>"</script>"""
RICH_MD = """## Hi **there**

One two [three four](/x) five.

Second **bold *both*** x
line

- a
- b
  - c
- d

| K | V |
| --- | --- |
| a\\|b | x y |

Term
: Def one
: Def two

```
  code
   here 
```

1. one
1. two

tail text"""  # noqa: W291


def test_markdown_keeps_tables_and_definitions_and_drops_noise(spark):
    got, words = markdown(spark, RICH)
    assert got == [RICH_MD]
    assert words == [32]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>a<p>b</div></p></td>c", "a\n\nb\n\nc"),
        ("<nav>only <a href='/x'>noise</a></nav>", "only [noise](/x)"),  # nothing else: it stays
        ("<b>open <p>x", "**open**\n\nx"),
        ("<b> </b>x<i></i>", "x"),
        ("<p hidden>gone</p><p style='display: none'>gone</p><p>here</p>", "here"),
        ("<table><tr><td>a<table><tr><td>in</td></tr></table></td></tr></table>", "| a in |\n| --- |"),
        ("<p>1 &lt; 2 &amp; 3&nbsp;4</p><!-- no --><style>p{}</style>", "1 < 2 & 3 4"),
        ("<article><header><h1>In</h1></header><p>text of it</p></article><header>out</header>", "# In\n\ntext of it"),
    ],
)
def test_broken_and_small_pages(spark, page, want):
    assert markdown(spark, page)[0] == [want]


def test_the_densest_container_wins(spark):
    links = "".join(f"<li><a href='/{i}'>link {i} of many words here</a></li>" for i in range(60))
    body = "".join(f"<div><p>{'real words ' * 12}</p></div>" for _ in range(4))
    page = f"<body><div id=left><ul>{links}</ul></div><div id=right>{body}</div><div id=low><p>short note</p></div></body>"
    got, words = markdown(spark, page)
    assert words == [96] and "link" not in got[0] and "short note" not in got[0]


def test_a_very_long_and_deep_page(spark):
    deep = "<div>" * 3000 + "<p>deep words</p>"
    long = "<p>" + "word " * 200_000 + "</p>"
    got, words = markdown(spark, deep, long)
    assert got[0] == "deep words" and words[1] == 200_000


@pytest.mark.parametrize(
    ("written", "country", "want"),
    [
        ("+971 4 123 4567", None, "+97141234567"),
        ("+971501234567", None, "+971501234567"),
        ("00971 50 123 4567", None, "+971501234567"),
        ("050 123 4567", "AE", "+971501234567"),
        ("04 123 4567", "AE", "+97141234567"),
        ("050 123 4567", None, None),
        ("+971 4 123", None, None),  # too short
        ("+971 4 123 4567 8901", None, None),  # too long
        ("+999 12345678", None, None),  # no such code
        ("+1 (706) 555-3138", None, "+17065553138"),
        ("+1 106 555 3138", None, None),  # no area begins with 1
        ("(706) 555-3138", "US", "+17065553138"),
        ("1 706 555 3138", "US", "+17065553138"),
        ("+44 (0)20 7946 0958", None, "+442079460958"),
        ("020 7946 0958", "GB", "+442079460958"),
        ("06 1234 5678", "IT", "+390612345678"),  # no trunk prefix: the zero stays
        ("+34 912 345 678", "US", "+34912345678"),
        ("", "US", None),
        (None, "US", None),
    ],
)
def test_phone_numbers(spark, written, country, want):
    row = spark.createDataFrame([(written,)], "w string").select(phones.e164(F.col("w"), country).alias("e")).first()
    assert row["e"] == want


def test_numbers_in_text(spark):
    text = "Call +971 4 123 4567 or (706) 555-3138, ref 12, card 4644 3483 9801 0899 1, v1.2.3"
    got = spark.createDataFrame([(text,)], "t string").select(F.filter(F.transform(phones.candidates(F.col("t")), lambda n: phones.e164(n, "US")), lambda n: n.isNotNull()).alias("n")).first()["n"]
    assert got == ["+97141234567", "+17065553138"]
    assert phones.PLAN == tuple(sorted(phones.PLAN, key=lambda r: (len(r[1]), r[1])))
    codes = [r[1] for r in phones.PLAN]
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)  # so a number has one code
