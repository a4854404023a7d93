"""Facts from crawled pages.

Facts are expressions on a page's HTML; sites are aggregates of them.  Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldnotes.functions import text as x
from fieldnotes.functions import urls
from fieldnotes.operators.ordered import running

# Hosts of networks, and path keywords.
NETWORKS = {"instagram": r"instagram\.com", "facebook": r"facebook\.com", "linkedin": r"linkedin\.com", "tiktok": r"tiktok\.com", "youtube": r"youtube\.com", "x": r"(?:twitter|x)\.com"}
#: Weights of path keywords and cost of a level of depth; the specification names words, not weights.
KEYWORDS = {"about": 5, "services": 5, "pricing": 5, "contact": 4, "faq": 3, "team": 2, "blog": 1}
DEPTH_COST = 1


def page_facts(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    return pages.select(
        "page_id",
        urls.normalise(F.col("url")).alias("url"),
        x.title(html).alias("title"),
        x.word_count(x.visible(html)).alias("word_count"),
        F.size(x.headings(html)).cast("long").alias("n_headings"),
        F.size(x.links(html)).cast("long").alias("n_links"),
        x.meta(html, "description").alias("description"),
    )


def page_headings(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.posexplode(x.headings(F.col("html"))).alias("position", "heading")).withColumn("position", F.col("position").cast("long"))


def _of_network(html: Column, name: str, host: str) -> Column:
    found = x.all_of(html, rf"https?://(?:[a-z]+\.)?{host}/[A-Za-z0-9_./-]+")
    return F.transform(found, lambda v: F.struct(F.lit(name).alias("kind"), v.alias("value")))


def contact_facts(pages: DataFrame) -> DataFrame:
    """By host: e-mail addresses, phones, WhatsApp links, JSON-LD types, each a sorted set; hosts
    of social networks in ``social``."""
    html = F.col("html")
    facts = pages.select(
        urls.host_of(F.col("url")).alias("host"),
        F.explode(
            F.flatten(
                F.array(
                    F.transform(x.all_of(html, x.EMAIL), lambda v: F.struct(F.lit("email").alias("kind"), F.lower(v).alias("value"))),
                    F.transform(x.all_of(html, x.PHONE), lambda v: F.struct(F.lit("phone").alias("kind"), F.regexp_replace(v, "[^0-9+]", "").alias("value"))),
                    F.transform(x.all_of(html, x.WHATSAPP), lambda v: F.struct(F.lit("whatsapp").alias("kind"), v.alias("value"))),
                    F.transform(x.json_ld_types(html), lambda v: F.struct(F.lit("schema").alias("kind"), v.alias("value"))),
                    *[_of_network(html, n, p) for n, p in NETWORKS.items()],
                )
            )
        ).alias("fact"),
    )
    return facts.select("host", "fact.kind", "fact.value").distinct()


def as_lists(facts: DataFrame) -> DataFrame:
    """A row per host and kind with the sorted values, comma-joined."""
    return facts.groupBy("host", "kind").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("found"), F.count_distinct("value").alias("n"))


def site_words(pages: DataFrame, least: int = 200) -> DataFrame:
    """Words over all pages of a host; under ``least`` the extraction counts as empty."""
    per = pages.select(urls.host_of(F.col("url")).alias("host"), x.word_count(x.visible(F.col("html"))).alias("n"))
    return per.groupBy("host").agg(F.count("*").alias("pages"), F.sum("n").alias("total_words")).withColumn("is_empty", F.col("total_words") < least)


def crawl_budget(candidates: DataFrame, max_pages: int, max_bytes: int) -> DataFrame:
    """Breadth-first within both budgets: pages up to the count, and while the bytes fit."""
    ranked = running(candidates, "host", ["depth", "page_id"], sums={"bytes_so_far": F.col("bytes")}, rank="rank")
    return ranked.filter((F.col("rank") <= max_pages) & (F.col("bytes_so_far") <= max_bytes))


def link_scores(pages: DataFrame) -> DataFrame:
    """Links of each page with a score by path keywords less depth."""
    links = pages.select("page_id", F.explode(x.links(F.col("html"))).alias("link")).distinct()
    score = sum((F.when(F.lower("link").contains(k), w).otherwise(0) for k, w in KEYWORDS.items()), F.lit(0))
    # relative links have no scheme; their depth counts from the site's root
    deep = F.size(F.filter(F.split(F.regexp_replace(F.regexp_replace("link", r"^[A-Za-z]+://[^/]*", ""), "[?#].*$", ""), "/"), lambda p: p != ""))
    return links.withColumn("score", (score - DEPTH_COST * deep).cast("long"))


# Schema.org's LocalBusiness and subtypes of it that count as a business's own markup.
BUSINESS = [
    "LocalBusiness",
    "AnimalShelter",
    "AutomotiveBusiness",
    "ChildCare",
    "Dentist",
    "DryCleaningOrLaundry",
    "EmergencyService",
    "EmploymentAgency",
    "EntertainmentBusiness",
    "FinancialService",
    "FoodEstablishment",
    "Restaurant",
    "GovernmentOffice",
    "HealthAndBeautyBusiness",
    "BeautySalon",
    "HomeAndConstructionBusiness",
    "InternetCafe",
    "LegalService",
    "Library",
    "LodgingBusiness",
    "Hotel",
    "MedicalBusiness",
    "MedicalClinic",
    "ProfessionalService",
    "RadioStation",
    "RealEstateAgent",
    "RecyclingCenter",
    "SelfStorage",
    "ShoppingCenter",
    "SportsActivityLocation",
    "Store",
    "TelevisionStation",
    "TouristInformationCenter",
    "TravelAgency",
]
#: Checks of a page: name, category, severity if it fails, title of the finding, how to mend it.
CHECKS = (
    ("viewport", "mobile", "high", "Mobile viewport not set", "Add a viewport meta tag with width=device-width"),
    ("favicon", "branding", "low", "No favicon", "Link an icon in the head"),
    ("og_image", "social", "medium", "No Open Graph image", "Add an og:image meta tag"),
    ("schema_org", "structured-data", "medium", "No business markup", "Describe the business as a schema.org LocalBusiness"),
    ("https", "security", "high", "Page is served without HTTPS", "Serve the site over HTTPS and redirect to it"),
    ("hsts", "security", "low", "No Strict-Transport-Security header", "Send the header with a max-age of a year"),
    ("analytics", "analytics", "medium", "No analytics found", "Install an analytics script"),
    ("cookie_banner", "compliance", "info", "No cookie banner found", "Ask for consent before setting cookies"),
    ("contact", "contact", "high", "No phone number or e-mail address", "Show a phone number or e-mail address"),
    ("whatsapp", "contact", "low", "No WhatsApp link", "Add a click-to-chat link"),
    ("booking", "conversion", "medium", "No way to book", "Offer online booking"),
)
#: What is shown of a page as evidence.
EXCERPT = 80


def seo_findings(pages: DataFrame) -> DataFrame:
    """A row per failed check of a page (url, html, and headers, by lower-case name, if there are any:
    only then is ``hsts`` checked), with the start of the page as evidence.  Lighthouse scores are inputs
    of the whole audit, not of a page; files of the site's root are in ``site_findings``."""
    html = F.col("html")
    business = F.array(*[F.lit(t) for t in BUSINESS])
    passed = {
        "viewport": html.rlike(r"(?i)<meta\b[^>]*name=[\"']viewport"),
        "favicon": html.rlike(r"(?i)<link\b[^>]*rel=[\"'](?:shortcut )?icon"),
        "og_image": html.rlike(r"(?i)<meta\b[^>]*property=[\"']og:image"),
        "schema_org": F.arrays_overlap(x.json_ld_types(html), business),
        "https": F.lower("url").startswith("https://"),
        "analytics": html.rlike(r"(?i)googletagmanager\.com|plausible\.io|google-analytics\.com"),
        "cookie_banner": html.rlike(r"(?i)cookie"),
        "contact": html.rlike(rf"{x.EMAIL}|{x.PHONE}|(?i)href=[\"']tel:\+?[0-9]{{7,15}}"),
        "whatsapp": html.rlike(x.WHATSAPP),
        "booking": html.rlike(r"(?i)calendly\.com|/book(?:ing)?\b"),
    }
    if "headers" in pages.columns:
        passed["hsts"] = F.exists(F.map_keys(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda k: F.lower(k) == "strict-transport-security")
    item = lambda n, c, s, t, h: F.struct(F.lit(n).alias("check"), F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(t).alias("title"), F.lit(h).alias("fix_hint"))
    failed = F.array(*[F.when(~passed[check[0]], item(*check)) for check in CHECKS if check[0] in passed])
    rows = pages.select("page_id", F.col("url").alias("evidence_url"), F.substring("html", 1, EXCERPT).alias("evidence_excerpt"), F.explode(F.filter(failed, lambda f: f.isNotNull())).alias("f"))
    return rows.select("page_id", "f.*", "evidence_url", "evidence_excerpt")


def site_findings(pages: DataFrame) -> DataFrame:
    """(host, check, severity) of crawled sites that lack a file of the root, or a contact page."""
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    sites = pages.select(urls.host_of(F.col("url")).alias("host"), F.lower(path).alias("path")).groupBy("host")
    checks = (("robots_txt", "low", F.col("path") == "/robots.txt"), ("sitemap_xml", "low", F.col("path") == "/sitemap.xml"), ("contact_page", "medium", F.col("path").contains("contact")))
    have = sites.agg(*[F.count_if(test).alias(n) for n, _, test in checks])
    failed = F.array(*[F.when(F.col(n) == 0, F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"))) for n, s, _ in checks])
    return have.select("host", F.explode(F.filter(failed, lambda f: f.isNotNull())).alias("f")).select("host", "f.*")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"), F.count_distinct("page_id").alias("pages"))


SEVERITIES = ("info", "low", "medium", "high")


def top_findings(findings: DataFrame, n: int = 3) -> DataFrame:
    """The n gravest findings of a page; ties by name."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    w = Window.partitionBy("page_id").orderBy(rank.desc(), "check")
    return findings.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("long"))
