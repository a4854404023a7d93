"""Page, rule and validator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldnotes.functions import money, text as x, urls
from fieldnotes import scratch
from fieldnotes.operators import pages as p, rules, validators as v
from fieldnotes.plans.inline import Rows
from fieldnotes.plans.relations import SERVICES
from fieldnotes.sources import files, tables as t

HTML = Rows(
    "page_id long, url string, html string, server string, powered string",
    (
        1,
        "https://Shop.example.com/About?utm_source=x&b=2#top",
        '<html><head><title> Blue  Shop </title><meta name="viewport" content="w"><meta name="generator" content="WordPress 6"><meta name="description" content="Shoes"><link rel="icon" href="/f.ico"><script src="/wp-includes/a.js"></script><script src="https://www.googletagmanager.com/gtag/js?id=1"></script><script type="application/ld+json">{"@context": "https://schema.org", "@graph": [{"@type": ["Organization", "Dentist"]}, {"@type": "WebSite"}]}</script></head><body><nav>menu here</nav><h1>Blue <b>Shop</b></h1><p>We sell &amp; mend shoes.</p><table><tr><td>9</td></tr></table><a href="mailto:Hi@Shop.example.com">mail</a><a href="https://wa.me/971500000000">chat</a><a href="https://instagram.com/blueshop">ig</a><a href="/services/repair">repair</a>+971 50 123 4567 cookie<!-- wp-content/ --></body></html>',
        "cloudflare",
        "PHP/8",
    ),
    (2, "http://plain.example.org/", "<html><head><title>Plain</title></head><body><h2>One</h2><ul><li>a</li><li>b</li></ul><a href='/pricing'>p</a> visit calendly.com today a@b.co</body></html>", "nginx", None),
    (3, "https://shop.example.com/contact", '<html><body><script src="https://cdn.shopify.com/x.js"></script><h3>Contact</h3><a href="tel:+97150">call</a> a@b.co Hi@shop.example.com<script src="https://js.hs-scripts.com/1.js"></script><script src="https://hubspot.com/2.js"></script></body></html>', None, "Next.js"),
    (4, "https://empty.example.net", "", None, None),
)
# Technology rules (name, category, kind, header, pattern); weights are our own.
SIGNALS = Rows(
    "name string, category string, kind string, header string, regex string, weight double",
    *[
        (*row, 0.6)
        for row in (
            ("WordPress", "cms", "header", "x-powered-by", "WordPress"),
            ("WordPress", "cms", "html", None, "wp-content/"),
            ("WordPress", "cms", "meta_generator", None, "WordPress"),
            ("WordPress", "cms", "script_src", None, "/wp-includes/"),
            ("WooCommerce", "ecommerce", "html", None, "woocommerce"),
            ("WooCommerce", "ecommerce", "script_src", None, "/plugins/woocommerce/"),
            ("Shopify", "ecommerce", "header", "x-shopid", ".+"),
            ("Shopify", "ecommerce", "script_src", None, "cdn.shopify.com"),
            ("Wix", "cms", "meta_generator", None, "Wix.com"),
            ("Wix", "cms", "script_src", None, "wixstatic.com"),
            ("Squarespace", "cms", "meta_generator", None, "Squarespace"),
            ("Squarespace", "cms", "script_src", None, "squarespace.com"),
            ("Webflow", "cms", "meta_generator", None, "Webflow"),
            ("Webflow", "cms", "script_src", None, "webflow.com"),
            ("Cloudflare", "hosting", "header", "server", "cloudflare"),
            ("Cloudflare", "hosting", "header", "cf-ray", ".+"),
            ("Google Tag Manager", "tag_managers", "script_src", None, "googletagmanager.com/gtm.js"),
            ("GA4", "analytics", "script_src", None, "googletagmanager.com/gtag/js"),
            ("Meta Pixel", "analytics", "html", None, "connect.facebook.net/en_US/fbevents.js"),
            ("Hotjar", "analytics", "script_src", None, "static.hotjar.com"),
            ("Mailchimp", "marketing", "script_src", None, "list-manage.com"),
            ("Mailchimp", "marketing", "html", None, "mailchimp"),
            ("Intercom", "chat", "script_src", None, "widget.intercom.io"),
            ("Tawk.to", "chat", "script_src", None, "embed.tawk.to"),
            ("Calendly", "booking", "script_src", None, "assets.calendly.com"),
            ("HubSpot", "crm", "script_src", None, "js.hs-scripts.com"),
            ("HubSpot", "crm", "script_src", None, "hubspot.com"),
            ("jQuery", "frontend_js", "script_src", None, "jquery"),
            ("React", "frontend_js", "html", None, "data-reactroot|__NEXT_DATA__"),
            ("Next.js", "frontend_js", "html", None, "__NEXT_DATA__"),
            ("Next.js", "frontend_js", "header", "x-powered-by", "Next.js"),
        )
    ],
)
LONG = " ".join(["word"] * 118)
DRAFTS = Rows(
    "draft_id long, subject string, body string, anchors array<string>, phrases array<string>",
    (1, "Your booking page", f"{LONG} booking page", ["booking", "page"], ["word booking"]),
    (2, "Your booking page and more words than seven", f"{LONG} booking page extra", ["Booking", "Page"], ["Word Booking"]),
    (3, "[Action Required] now", "I hope this EMAIL finds you well, a Quick Question on synergy", ["synergy", "none"], ["synergy"]),
    (4, "Hi \U0001f600", "short body www.example.com \U0001f600\U0001f680", ["short"], ["missing"]),
    (5, "", "", [], []),
)
ESTIMATES = Rows(
    "opportunity_id string, low double, expected double, high double, setup double, run_cost double, assumptions array<string>",
    ("a", 1200.0, 2400.0, 3600.0, 1500.0, 80.0, ["x", "y"]),
    ("b", 3000.0, 2400.0, 3600.0, 1500.0, 2400.0, ["x", "y", "z"]),
    ("c", 1.0, 50000.0, 60000.0, 9000.0, 50001.0, ["x"]),
    ("d", 1.0, 50001.0, 60000.0, 9000.0, 1.0, ["1", "2", "3", "4", "5", "6"]),
)
PROPOSALS = Rows(
    "draft_id long, executive_summary string, the_problem string, what_we_propose string, expected_outcome string",
    (1, " ".join(["w"] * 80), " ".join(["w"] * 120), " ".join(["w"] * 160), " ".join(["w"] * 120)),
    (2, " ".join(["w"] * 81), "a b", "c", ""),
    (3, None, " ".join(["w"] * 121), " ".join(["w"] * 161), " ".join(["w"] * 121)),
)
CONTRACTS = Rows(
    "id string, evidence array<string>, value_props array<string>, talking_points array<string>, objections array<string>",
    ("a", ["1", "2", "3"], ["x" * 100], ["t"], []),
    ("b", ["1", "2"], ["x" * 101, "y"], ["1", "2", "3"], ["1", "2", "3"]),
    ("c", None, ["1", "2", "3", "4", "5", "6"], ["1", "2", "3", "4"], None),
)
OFFERS = Rows("company_id string, id string, priority_score double, evidence long", *[(c, s, round(0.9 - 0.1 * (i % 4), 2), 1 + i % 3) for c, n in (("c1", 11), ("c2", 3), ("c3", 2)) for i, s in enumerate([*SERVICES, "hologram"][-n:])])
ROI = Rows("opportunity_id string, expected double, assumptions array<string>", *[(x, 400.0 * (i + 1), ["a"] * (i % 3)) for i, x in enumerate(SERVICES[::2])])
QUOTES = Rows("lead_id string, floor_usd double, ceiling_usd double, ups long, downs long, asked double", ("a", 5000.0, 25000.0, 0, 0, 0.1), ("b", 5000.0, 25000.0, 2, 0, 0.5), ("c", 500.0, 1500.0, 0, 2, -0.1), ("d", 1500.0, 5000.0, 1, 1, 0.2))
AUDITS = Rows("site string, total_words long, confidence double, performance double, seo double", ("a", 199, 0.5, 49.9, 70.0), ("b", 200, 0.49, 50.0, 69.9), ("c", None, None, 90.0, None))
BUDGET_PAGES, BUDGET_BYTES = 25, 40_000
TEMPLATE = "Dear {{ name }}, we read {{host}} in {{ city }} for {{ unknown }}."
LANGUAGE = "en"


def headed(s):
    rows = HTML.df(s)
    named = F.map_filter(F.create_map(F.lit("Server"), F.col("server"), F.lit("X-Powered-By"), F.col("powered")), lambda k, value: value.isNotNull())
    return rows.withColumn("headers", named)


def crawled(s, d):
    """The table's pages with headers of their own: a server for each, and of every third the rest."""
    pages = t.table(s, d, "pages").select("page_id", "url", "html")
    server = F.when(F.col("page_id") % 2 == 0, "cloudflare").otherwise("nginx")
    strict = F.when(F.col("page_id") % 3 == 0, "max-age=31536000")
    named = F.create_map(F.lit("Server"), server, F.lit("Strict-Transport-Security"), strict)
    return pages.withColumn("headers", F.map_filter(named, lambda k, value: value.isNotNull()))


def proposed(s, d):
    """A proposal from each document: four pieces of its text."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    piece = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    return t.table(s, d, "documents").select(F.col("doc_id").alias("draft_id"), piece(1, 100).alias("executive_summary"), piece(101, 119).alias("the_problem"), piece(1, 170).alias("what_we_propose"), piece(20, 130).alias("expected_outcome"))


def mail_drafts(s, d):
    """A draft from each turn of a conversation: its first words as subject, the next two as anchors."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    c = t.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("draft_id"), "text", words.alias("w"))
    return c.select("draft_id", F.array_join(F.slice("w", 1, 6), " ").alias("subject"), F.col("text").alias("body"), F.slice("w", 2, 2).alias("anchors"), F.slice("w", 3, 1).alias("phrases"))


def submitted(s, d):
    """The pages' addresses as a bulk file, read back as a list of URLs."""
    path = scratch.folder(s, "urls.csv")
    t.table(s, d, "pages").select("url").write.csv(path, header=True)
    return files.url_list(s, path).select(urls.normalise(F.col("url")).alias("url")).groupBy("url").agg(F.count("*").alias("submitted")).withColumn("company_id", F.sha2(urls.host_of(F.col("url")), 256))


def frontier(s, d):
    pages = t.table(s, d, "pages")
    return pages.select("page_id", (F.col("page_id") % 5).alias("host"), urls.depth(F.col("url")).alias("depth"), F.octet_length("html").cast("long").alias("bytes"))


def skipped(s, d):
    reason = F.when(F.col("lang") != LANGUAGE, F.concat(F.lit("language "), F.col("lang")))
    return t.table(s, d, "documents").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("documents"))


def context_pages(s, d):
    """The pages a summary reads: the best eight of a host by link score of their own address."""
    score = sum((F.when(F.lower("url").contains(k), w).otherwise(0) for k, w in p.KEYWORDS.items()), F.lit(0)) - p.DEPTH_COST * urls.depth(F.col("url"))
    from pyspark.sql import Window

    rows = t.table(s, d, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"), score.cast("long").alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("score"), "page_id"))).filter("rank <= 8").withColumn("rank", F.col("rank").cast("long"))


def hashes(s, d):
    e = t.table(s, d, "events")
    entries = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("agent"), F.col("event_type"))
    return e.select("event_id", x.input_hash(entries).alias("input_hash"))


def mails(s, d):
    n = F.size(x.all_of(F.col("text"), x.EMAIL))
    return t.table(s, d, "documents").select("doc_id", n.cast("long").alias("emails"), F.size(x.all_of(F.col("text"), x.PHONE)).cast("long").alias("phones"), x.word_count(F.col("text")).alias("words")).filter("emails + phones > 0")


QUERIES = {
    "url_normalise": lambda s, d: t.table(s, d, "pages").select("page_id", urls.normalise(F.col("url")).alias("url")),
    "host_extract": lambda s, d: t.table(s, d, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"), urls.slug(urls.host_of(F.col("url"))).alias("slug"), urls.depth(F.col("url")).alias("depth")),
    "bulk_url_ingest": submitted,
    "page_facts": lambda s, d: p.page_facts(t.table(s, d, "pages")),
    "page_headings": lambda s, d: p.page_headings(t.table(s, d, "pages")),
    "page_markdown": lambda s, d: t.table(s, d, "pages").select("page_id", "html").unionByName(HTML.df(s).select("page_id", "html")).select("page_id", F.sha2(x.markdown(F.col("html")), 256).alias("markdown_sha256"), F.length(x.markdown(F.col("html"))).cast("long").alias("chars")),
    "site_words": lambda s, d: p.site_words(t.table(s, d, "pages").select("url", "html").unionByName(HTML.df(s).select("url", "html"))),
    "crawl_budget": lambda s, d: p.crawl_budget(frontier(s, d), BUDGET_PAGES, BUDGET_BYTES),
    "seo_findings": lambda s, d: p.seo_findings(HTML.df(s)),
    "seo_findings_pages": lambda s, d: p.seo_findings(crawled(s, d)).groupBy("check", "severity").agg(F.count("*").alias("pages")),
    "site_findings": lambda s, d: p.site_findings(t.table(s, d, "pages").select("url").unionByName(HTML.df(s).select("url"))),
    "severity_counts": lambda s, d: p.severity_counts(p.seo_findings(HTML.df(s))),
    "top_findings": lambda s, d: p.top_findings(p.seo_findings(HTML.df(s))),
    "contact_facts": lambda s, d: p.as_lists(p.contact_facts(HTML.df(s))),
    "document_contacts": mails,
    "link_scores": lambda s, d: p.link_scores(t.table(s, d, "pages").select("page_id", "html").unionByName(HTML.df(s).select(F.col("page_id") + 1_000_000, "html").toDF("page_id", "html"))),
    "context_pages": context_pages,
    "language_skips": skipped,
    "input_hashes": hashes,
    "tech_signals": lambda s, d: rules.detect(headed(s), SIGNALS.df(s)),
    "tech_signals_pages": lambda s, d: rules.detect(crawled(s, d), SIGNALS.df(s)).groupBy("name", "category", "confidence").agg(F.count("*").alias("pages")),
    "stack_gaps_pages": lambda s, d: rules.gaps(crawled(s, d), rules.detect(crawled(s, d), SIGNALS.df(s))).groupBy("category").agg(F.count("*").alias("pages")),
    "contact_facts_pages": lambda s, d: p.as_lists(p.contact_facts(t.table(s, d, "pages"))),
    "stack_gaps": lambda s, d: rules.gaps(headed(s), rules.detect(headed(s), SIGNALS.df(s))),
    "email_compliance": lambda s, d: v.email_compliance(DRAFTS.df(s)),
    "whatsapp_compliance": lambda s, d: v.whatsapp_compliance(DRAFTS.df(s)),
    "email_compliance_turns": lambda s, d: v.email_compliance(mail_drafts(s, d)),
    "whatsapp_compliance_turns": lambda s, d: v.whatsapp_compliance(mail_drafts(s, d)),
    "proposal_caps": lambda s, d: v.proposal_caps(PROPOSALS.df(s).unionByName(proposed(s, d).withColumn("draft_id", F.col("draft_id") + 1_000_000))),
    "list_contracts": lambda s, d: v.list_contracts(CONTRACTS.df(s)),
    "verbatim_quotes": lambda s, d: v.verbatim_quotes(DRAFTS.df(s)).select("draft_id", "quoted"),
    "contract_sizes": lambda s, d: v.size_rules(DRAFTS.df(s).select("draft_id", "anchors", "phrases"), {"anchors": (1, 2), "phrases": (1, 3)}),
    "threshold_guards": lambda s, d: v.guards(AUDITS.df(s)),
    "roi_payback": lambda s, d: v.roi_payback(ESTIMATES.df(s)),
    "roi_bounds": lambda s, d: v.roi_bounds(ESTIMATES.df(s)),
    "price_quote": lambda s, d: QUOTES.df(s).select("lead_id", money.quote(F.col("floor_usd"), F.col("ceiling_usd"), F.col("ups"), F.col("downs")).alias("price"), money.discounted(F.col("ceiling_usd"), F.col("asked")).alias("discounted"), money.convert(F.col("floor_usd"), F.lit(3.6725)).alias("floor_aed")),
    "rank_opportunities": lambda s, d: v.rank_opportunities(OFFERS.df(s), s.createDataFrame([(i,) for i in SERVICES], "id string")),
    "estimates_for_opportunities": lambda s, d: OFFERS.df(s).join(ROI.df(s).withColumnRenamed("opportunity_id", "id"), "id").select("company_id", "id", "expected", "assumptions"),
    "template_fill": lambda s, d: t.companies(s, d).select("company_id", x.fill(F.lit(TEMPLATE), {"name": F.col("name"), "host": F.col("host"), "city": F.col("city")}).alias("text")),
}

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
_BARE = "regexp_replace(trim(url), '#.*$', '')"
_KEPT = rf"array_to_string(list_filter(string_split(regexp_extract({_BARE}, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT starts_with(lower(q), 'utm_')), '&')"
_BASE = rf"regexp_replace({_BARE}, '\?.*$', '')"
_HEAD = rf"regexp_extract({_BASE}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)"
_NORMAL = rf"(lower({_HEAD}) || substr({_BASE}, length({_HEAD}) + 1) || CASE WHEN {_KEPT} = '' THEN '' ELSE '?' || {_KEPT} END)"
_DEPTH = r"CAST(len(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda q: q <> '')) AS BIGINT)"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"))


def _visible(html: str = "html") -> str:
    out = rf"regexp_replace(regexp_replace({html}, '{x.DROPPED}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in _ENTITIES:
        out = f"replace({out}, '{entity}', '{char}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def _count(text: str) -> str:
    return rf"CAST(len(list_filter(regexp_split_to_array({text}, '\s+'), lambda q: q <> '')) AS BIGINT)"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


_LINKS = f"""regexp_extract_all(html, '{_q(r'''(?i)<a\s[^>]*\bhref=["']([^"']*)["']''')}', 1)"""
_HEADINGS = "list_transform(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), lambda h: trim(regexp_replace(h, '<[^>]*>', '', 'g')))"
_META = lambda n: f"""regexp_extract(html, '{_q(rf'''(?i)<meta\b[^>]*(?:name|property)=["']{n}["'][^>]*content=["']([^"']*)["']''')}', 1)"""
_SRC = f"""regexp_extract_all(html, '{_q(r'''(?i)<script\b[^>]*\bsrc=["']([^"']*)["']''')}', 1)"""


def _markdown() -> str:
    out = rf"regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head\s*>', '', 'g'), '{x.DROPPED}', '', 'g')"
    for n in (1, 2, 3):
        out = rf"regexp_replace({out}, '(?is)<h{n}[^>]*>(.*?)</h{n}>', chr(10) || '{'#' * n} \1' || chr(10), 'g')"
    out = rf"regexp_replace({out}, '(?is)<li[^>]*>(.*?)</li>', chr(10) || '- \1', 'g')"
    out = rf"regexp_replace({out}, '(?is)<(?:b|strong)>(.*?)</(?:b|strong)>', '**\1**', 'g')"
    link = _q(r"""(?is)<a\b[^>]*\bhref=["']([^"']*)["'][^>]*>(.*?)</a>""")
    out = rf"regexp_replace({out}, '{link}', '[\2](\1)', 'g')"
    out = rf"regexp_replace({out}, '(?i)</p>|<br\s*/?>', chr(10), 'g')"
    out = rf"regexp_replace({out}, '{x.PLAIN_TAGS}', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({out}, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'))"


def _ld_types(html: str) -> str:
    """The list of types of a page's JSON-LD, with repeats."""
    blocks = rf"list_filter(regexp_extract_all({html}, '{_q(x.LD_BLOCK)}', 1), lambda k: json_valid(k))"
    found = rf"list_filter(flatten(list_transform({blocks}, lambda k: regexp_extract_all(k, '{_q(x.LD_TYPE)}', 1))), lambda k: k <> '')"
    return rf"""flatten(list_transform({found}, lambda k: regexp_extract_all(k, '"([^"]+)"', 1)))"""


_PASSED = {
    "viewport": """regexp_matches(html, '(?i)<meta\\b[^>]*name=["'']viewport')""",
    "favicon": """regexp_matches(html, '(?i)<link\\b[^>]*rel=["''](?:shortcut )?icon')""",
    "og_image": """regexp_matches(html, '(?i)<meta\\b[^>]*property=["'']og:image')""",
    "schema_org": f"len(list_filter({_ld_types('html')}, lambda q: q IN ({', '.join(repr(b) for b in p.BUSINESS)}))) > 0",
    "https": "starts_with(lower(url), 'https://')",
    "analytics": r"regexp_matches(html, '(?i)googletagmanager\.com|plausible\.io|google-analytics\.com')",
    "cookie_banner": "regexp_matches(html, '(?i)cookie')",
    "contact": rf"""(regexp_matches(html, '{x.EMAIL}') OR regexp_matches(html, '{x.PHONE}') OR regexp_matches(html, '(?i)href=["'']tel:\+?[0-9]{{7,15}}'))""",
    "hsts": "page_id % 3 = 0",
    "whatsapp": f"regexp_matches(html, '{_q(x.WHATSAPP)}')",
    "booking": r"regexp_matches(html, '(?i)calendly\.com|/book(?:ing)?\b')",
}


def _findings(pages: str, hsts: bool = False) -> str:
    return " UNION ALL ".join(
        f"SELECT page_id, '{n}' AS \"check\", '{c}' AS category, '{g}' AS severity, '{title}' AS title, '{hint}' AS fix_hint, url AS evidence_url, substr(html, 1, {p.EXCERPT}) AS evidence_excerpt FROM {pages} WHERE NOT {_PASSED[n]}"
        for n, c, g, title, hint in p.CHECKS
        if hsts or n != "hsts"
    )


def _facts(source: str = HTML.sql) -> str:
    parts = [
        f"SELECT {_HOST} AS host, 'email' AS kind, lower(unnest(regexp_extract_all(html, '{x.EMAIL}'))) AS value FROM {source}",
        f"SELECT {_HOST} AS host, 'phone' AS kind, regexp_replace(unnest(regexp_extract_all(html, '{x.PHONE}')), '[^0-9+]', '', 'g') AS value FROM {source}",
        f"SELECT {_HOST} AS host, 'whatsapp' AS kind, unnest(regexp_extract_all(html, '{_q(x.WHATSAPP)}')) AS value FROM {source}",
        f"SELECT {_HOST} AS host, 'schema' AS kind, unnest({_ld_types('html')}) AS value FROM {source}",
    ]
    parts += [f"SELECT {_HOST} AS host, '{n}' AS kind, unnest(regexp_extract_all(html, 'https?://(?:[a-z]+\\.)?{q}/[A-Za-z0-9_./-]+')) AS value FROM {source}" for n, q in p.NETWORKS.items()]
    return " UNION ".join(parts)


def _values(pages: str) -> str:
    return f"""
SELECT page_id, 'html' AS kind, NULL AS header, html AS value FROM {pages} UNION ALL
SELECT page_id, 'meta_generator', NULL, {_META("generator")} FROM {pages} UNION ALL
SELECT page_id, 'script_src', NULL, unnest({_SRC}) FROM {pages} UNION ALL
SELECT page_id, 'json_ld', NULL, unnest({_ld_types('html')}) FROM {pages}"""


_VALUES = f"""{_values(HTML.sql)} UNION ALL
SELECT page_id, 'header', 'server', server FROM {HTML.sql} UNION ALL SELECT page_id, 'header', 'x-powered-by', powered FROM {HTML.sql}"""
_CRAWLED = f"{_values('pages')} UNION ALL SELECT page_id, 'header', 'server', CASE WHEN page_id % 2 = 0 THEN 'cloudflare' ELSE 'nginx' END FROM pages"


def _tech(values: str) -> str:
    return f"""
SELECT page_id, name, category, round(least(sum(weight), 1.0), 6) AS confidence, count(*) AS signals FROM (
  SELECT DISTINCT v.page_id, r.name, r.category, r.kind, r.regex, r.weight FROM ({values}) v JOIN {SIGNALS.sql} r
  ON v.kind = r.kind AND v.header IS NOT DISTINCT FROM lower(r.header) AND regexp_matches(v.value, r.regex) WHERE v.value <> '')
GROUP BY 1, 2, 3 HAVING round(least(sum(weight), 1.0), 6) > 0.5"""


_TECH = _tech(_VALUES)
_SCORE = " + ".join(f"CASE WHEN contains(lower(link), '{k}') THEN {w} ELSE 0 END" for k, w in p.KEYWORDS.items())
_ANCHORS = "CAST(len(list_filter(anchors, lambda q: contains(lower(body), lower(q)))) AS BIGINT)"
_EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
_BANNED = f"array_to_string(list_filter([{', '.join(repr(b) for b in v.BANNED)}], lambda q: contains(lower(body), q)), ',')"

_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda q: q <> '')"
_TURNS = f"""SELECT conv_id * 1000 + turn AS draft_id, array_to_string(list_slice({_WORDS}, 1, 6), ' ') AS subject, text AS body,
  list_slice({_WORDS}, 2, 3) AS anchors, list_slice({_WORDS}, 3, 3) AS phrases FROM conversations"""
_PROPOSED = f"""SELECT doc_id AS draft_id, array_to_string(list_slice({_WORDS}, 1, 100), ' ') AS a, array_to_string(list_slice({_WORDS}, 101, 219), ' ') AS b,
  array_to_string(list_slice({_WORDS}, 1, 170), ' ') AS c, array_to_string(list_slice({_WORDS}, 20, 149), ' ') AS e FROM documents"""


def _email(drafts: str) -> str:
    return rf"""
SELECT *, words <= 120 AND subject_words <= 7 AND anchors >= 2 AND banned = '' AND emojis = 0 AND NOT bracketed AS ok FROM (
  SELECT draft_id, {_count("body")} AS words, {_count("subject")} AS subject_words, {_ANCHORS} AS anchors, {_BANNED} AS banned,
    CAST(len(regexp_extract_all(subject, '{_EMOJI}')) AS BIGINT) AS emojis, regexp_matches(subject, '^\s*\[') AS bracketed FROM {drafts})"""


def _whatsapp(drafts: str) -> str:
    return rf"""
SELECT *, words <= 40 AND NOT has_url AND emojis <= 1 AND anchors >= 1 AS ok FROM (
  SELECT draft_id, {_count("body")} AS words, regexp_matches(body, '{v.URL}') AS has_url, CAST(len(regexp_extract_all(body, '{_EMOJI}')) AS BIGINT) AS emojis, {_ANCHORS} AS anchors FROM {drafts})"""


SQL = {
    "url_normalise": f"SELECT page_id, {_NORMAL} AS url FROM pages",
    "host_extract": f"SELECT page_id, {_HOST} AS host, replace({_HOST}, '.', '-') AS slug, {_DEPTH} AS depth FROM pages",
    "bulk_url_ingest": f"SELECT url, submitted, sha256({_HOST}) AS company_id FROM (SELECT {_NORMAL} AS url, count(*) AS submitted FROM pages GROUP BY 1)",
    "page_facts": f"""
SELECT page_id, {_NORMAL} AS url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, {_count(_visible())} AS word_count,
  CAST(len({_HEADINGS}) AS BIGINT) AS n_headings, CAST(len({_LINKS}) AS BIGINT) AS n_links, {_META("description")} AS description FROM pages""",
    "page_headings": f"SELECT page_id, unnest(range(0, len({_HEADINGS}))) AS position, unnest({_HEADINGS}) AS heading FROM pages",
    "page_markdown": f"SELECT page_id, sha256({_markdown()}) AS markdown_sha256, CAST(length({_markdown()}) AS BIGINT) AS chars FROM (SELECT page_id, html FROM pages UNION ALL SELECT page_id, html FROM {HTML.sql})",
    "site_words": f"""
SELECT host, count(*) AS pages, CAST(sum(n) AS BIGINT) AS total_words, sum(n) < 200 AS is_empty
FROM (SELECT {_HOST} AS host, {_count(_visible())} AS n FROM (SELECT url, html FROM pages UNION ALL SELECT url, html FROM {HTML.sql})) GROUP BY 1""",
    "crawl_budget": f"""
SELECT page_id, host, depth, bytes, rank, CAST(bytes_so_far AS BIGINT) AS bytes_so_far FROM (
  SELECT *, row_number() OVER w AS rank, sum(bytes) OVER (PARTITION BY host ORDER BY depth, page_id ROWS UNBOUNDED PRECEDING) AS bytes_so_far
  FROM (SELECT page_id, page_id % 5 AS host, {_DEPTH} AS depth, CAST(strlen(html) AS BIGINT) AS bytes FROM pages) WINDOW w AS (PARTITION BY host ORDER BY depth, page_id))
WHERE rank <= {BUDGET_PAGES} AND bytes_so_far <= {BUDGET_BYTES}""",
    "seo_findings": _findings(HTML.sql),
    "seo_findings_pages": f"SELECT \"check\", severity, count(*) AS pages FROM ({_findings('pages', True)}) GROUP BY 1, 2",
    "site_findings": rf"""
WITH s AS (SELECT {_HOST} AS host, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path FROM (SELECT url FROM pages UNION ALL SELECT url FROM {HTML.sql})),
h AS (SELECT host, count(*) FILTER (WHERE path = '/robots.txt') AS r, count(*) FILTER (WHERE path = '/sitemap.xml') AS m, count(*) FILTER (WHERE contains(path, 'contact')) AS c FROM s GROUP BY 1)
SELECT host, 'robots_txt' AS "check", 'low' AS severity FROM h WHERE r = 0 UNION ALL SELECT host, 'sitemap_xml', 'low' FROM h WHERE m = 0 UNION ALL SELECT host, 'contact_page', 'medium' FROM h WHERE c = 0""",
    "severity_counts": f"SELECT severity, count(*) AS findings, count(DISTINCT page_id) AS pages FROM ({_findings(HTML.sql)}) GROUP BY 1",
    "top_findings": f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, "check") AS rank
FROM ({_findings(HTML.sql)})) WHERE rank <= 3""",
    "contact_facts": f"SELECT host, kind, array_to_string(list_sort(list(value)), ',') AS found, count(*) AS n FROM ({_facts()}) WHERE value IS NOT NULL GROUP BY 1, 2",
    "document_contacts": f"""
SELECT * FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '{x.EMAIL}')) AS BIGINT) AS emails, CAST(len(regexp_extract_all(text, '{x.PHONE}')) AS BIGINT) AS phones, {_count("text")} AS words FROM documents)
WHERE emails + phones > 0""",
    "link_scores": rf"""
SELECT page_id, link, CAST({_SCORE} - {p.DEPTH_COST} * len(list_filter(string_split(regexp_replace(regexp_replace(link, '^[A-Za-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda q: q <> '')) AS BIGINT) AS score
FROM (SELECT DISTINCT page_id, unnest({_LINKS}) AS link FROM (SELECT page_id, html FROM pages UNION ALL SELECT page_id + 1000000, html FROM {HTML.sql}))""",
    "context_pages": f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) AS rank FROM (
  SELECT page_id, {_HOST} AS host, CAST({_SCORE.replace("link", "url")} - {p.DEPTH_COST} * {_DEPTH} AS BIGINT) AS score FROM pages)) WHERE rank <= 8""",
    "language_skips": f"SELECT CASE WHEN lang <> '{LANGUAGE}' THEN 'language ' || lang ELSE 'kept' END AS reason, count(*) AS documents FROM documents GROUP BY 1",
    "input_hashes": """SELECT event_id, sha256('{"agent":"' || event_type || '","user":"' || CAST(user_id AS VARCHAR) || '"}') AS input_hash FROM events""",
    "tech_signals": _TECH,
    "stack_gaps": f"""
SELECT g.page_id, g.category FROM (SELECT page_id, unnest([{', '.join(repr(c) for c in rules.GAPS)}]) AS category FROM {HTML.sql}) g
WHERE NOT EXISTS (SELECT 1 FROM ({_TECH}) t WHERE t.page_id = g.page_id AND t.category = g.category)""",
    "tech_signals_pages": f"SELECT name, category, confidence, count(*) AS pages FROM ({_tech(_CRAWLED)}) GROUP BY 1, 2, 3",
    "stack_gaps_pages": f"""
SELECT g.category, count(*) AS pages FROM (SELECT page_id, unnest([{', '.join(repr(c) for c in rules.GAPS)}]) AS category FROM pages) g
WHERE NOT EXISTS (SELECT 1 FROM ({_tech(_CRAWLED)}) t WHERE t.page_id = g.page_id AND t.category = g.category) GROUP BY 1""",
    "contact_facts_pages": f"SELECT host, kind, array_to_string(list_sort(list(value)), ',') AS found, count(*) AS n FROM ({_facts('pages')}) WHERE value IS NOT NULL GROUP BY 1, 2",
    "email_compliance": _email(DRAFTS.sql),
    "whatsapp_compliance": _whatsapp(DRAFTS.sql),
    "email_compliance_turns": _email(f"({_TURNS})"),
    "whatsapp_compliance_turns": _whatsapp(f"({_TURNS})"),
    "proposal_caps": f"""
SELECT *, executive_summary <= 80 AND the_problem <= 120 AND what_we_propose <= 160 AND expected_outcome <= 120 AS ok FROM (
  SELECT draft_id, {", ".join(f"COALESCE({_count(n)}, 0) AS {n}" for n in v.SECTIONS)} FROM (SELECT * FROM {PROPOSALS.sql} UNION ALL SELECT draft_id + 1000000, a, b, c, e FROM ({_PROPOSED})))""",
    "list_contracts": f"""
SELECT *, evidence_ok AND value_props_ok AND talking_points_ok AND objections_ok AS ok FROM (
  SELECT id, COALESCE(len(evidence), 0) >= 3 AS evidence_ok, COALESCE(len(value_props), 0) <= 5 AND COALESCE(len(list_filter(value_props, lambda q: length(q) > 100)), 0) = 0 AS value_props_ok,
    COALESCE(len(talking_points), 0) <= 3 AS talking_points_ok, COALESCE(len(objections), 0) <= 3 AS objections_ok,
    COALESCE(list_max(list_transform(value_props, lambda q: length(q))), 0) AS longest_value_prop FROM {CONTRACTS.sql})""",
    "verbatim_quotes": f"SELECT draft_id, len(list_filter(phrases, lambda q: contains(body, q))) > 0 AS quoted FROM {DRAFTS.sql}",
    "contract_sizes": f"SELECT draft_id, len(anchors) BETWEEN 1 AND 2 AS anchors_ok, len(phrases) BETWEEN 1 AND 3 AS phrases_ok FROM {DRAFTS.sql}",
    "threshold_guards": f"SELECT site, total_words < 200 AS empty_extraction, confidence < 0.5 AS low_confidence, performance < 50 AS rebuild, seo < 70 AS search_fixes FROM {AUDITS.sql}",
    "roi_payback": f"SELECT opportunity_id, round(CASE WHEN expected - run_cost > 0 THEN setup / (expected - run_cost) END, 4) AS payback_months FROM {ESTIMATES.sql}",
    "roi_bounds": f"""
SELECT *, ordered AND bounded AND enough_assumptions AS ok FROM (SELECT opportunity_id, low <= expected AND expected <= high AS ordered, expected <= 50000 AS bounded,
  len(assumptions) BETWEEN 2 AND 5 AS enough_assumptions FROM {ESTIMATES.sql})""",
    "price_quote": f"""
SELECT lead_id, round(greatest(floor_usd * 0.5, least(ceiling_usd * 1.5, (floor_usd + ceiling_usd) / 2 * (1 + 0.25 * (ups - downs)))), 2) AS price,
  round(ceiling_usd * (1 - least(greatest(asked, 0.0), 0.2)), 2) AS discounted, round(floor_usd * 3.6725, 2) AS floor_aed FROM {QUOTES.sql}""",
    "rank_opportunities": f"""
SELECT company_id, id, priority_score, evidence, rank, count(*) OVER (PARTITION BY company_id) >= 3 AS enough FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY priority_score DESC, id) AS rank FROM {OFFERS.sql}
  WHERE evidence >= 2 AND id IN ({', '.join(repr(i) for i in SERVICES)})) WHERE rank <= 7""",
    "estimates_for_opportunities": f"SELECT company_id, id, expected, assumptions FROM {OFFERS.sql} o JOIN {ROI.sql} e ON o.id = e.opportunity_id",
    "template_fill": f"SELECT company_id, replace(replace(replace('{TEMPLATE}', '{{{{ name }}}}', name), '{{{{host}}}}', host), '{{{{ city }}}}', city) AS text FROM ({t.COMPANIES_SQL})",
}
