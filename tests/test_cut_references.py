"""Articles whose title and text end within a reference to a character, against the SQL."""

import duckdb
import pytest
from oracle import check
from pyspark.sql import functions as F

from fieldnotes.functions import html as h
from fieldnotes.plans import extraction

PAGE = '<html><head><title>{0}</title></head><body><nav><a href="/a?x=1&lt=2">a</a></nav><article><h1>{0}</h1><p><b>{0}.<br><p>b {0}</p></article></body></html>'


def test_references_that_are_cut(spark, tmp_path):
    whole = ["&quot;", "&lt;", "&amp;", "&amp;lt;", "&amp;amp;quot;", "&amp;#39;", "&amp;copy;", "&gt", "&copy", "&#39", "&#x27", "&notit", "&ltx;"]
    titles = sorted({f"{a}{w[:n]}{b}" for w in whole for n in range(1, len(w) + 1) for a, b in (("one ", ""), ("one", " two"))})
    rows = spark.createDataFrame([(i, PAGE.format(t)) for i, t in enumerate(titles)], "page_id long, html string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        rows.write.parquet(f"{tmp_path}/pages.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        check(con, extraction.articles(spark, str(tmp_path)), extraction.ARTICLES)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize(
    ("html", "cut", "closed"),
    [
        ("a &quot", 'a "', "a &quot"),
        ("&copy 2024 &copy; &#169; &#169", "© 2024 © © ©", "&copy 2024 © © &#169"),
        ("&notin; &notit; &amp &ampx &am", "∉ ¬it; & &x &am", "∉ &notit; & &x &am"),
    ],
)
def test_references_with_and_without_semicolon(spark, html, cut, closed):
    page = spark.createDataFrame([(f"<p>{html}</p>",), (None,)], "html string")
    for need, want in ((False, cut), (True, closed)):
        got = page.select(h.parsed(F.col("html"), need).alias("p")).select(h.as_markdown(h.main_blocks(F.col("p"))).alias("m")).collect()
        assert [r["m"] for r in got] == [want, ""]
