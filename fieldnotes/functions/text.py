"""Text and HTML expressions; all built in, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: A phone number is approximated: an optional plus, 9 to 15 digits with separators.
PHONE = r"\+[0-9][0-9 ().-]{7,18}[0-9]"
WHATSAPP = r"https?://(?:wa\.me|api\.whatsapp\.com|(?:www\.)?whatsapp\.com)/[^\s\"'<>]*"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"


#: What isn't a page's own text.
DROPPED = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>|<footer\b.*?</footer\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->"
#: Tags that Markdown doesn't keep; tables and definition lists stay.
PLAIN_TAGS = r"(?i)</?(?:!doctype|html|head|body|main|section|article|header|aside|div|span|p|ul|ol|li|em|i|u|a|b|strong|h[1-6]|img|meta|link|title|br|hr|form|input|button|label|option|select)\b[^>]*>"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def visible(html: Column) -> Column:
    """The text of a page: scripts, styles, navigation, footers, comments and tags go."""
    out = F.regexp_replace(html, DROPPED, " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def headings(html: Column) -> Column:
    """Texts of h1 to h3, in order."""
    return F.transform(all_of(html, r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", 1), lambda h: F.trim(F.regexp_replace(h, "<[^>]*>", "")))


def links(html: Column) -> Column:
    return all_of(html, r"(?i)<a\s[^>]*\bhref=[\"']([^\"']*)[\"']", 1)


def meta(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf"(?i)<meta\b[^>]*(?:name|property)=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)


def script_sources(html: Column) -> Column:
    return all_of(html, r"(?i)<script\b[^>]*\bsrc=[\"']([^\"']*)[\"']", 1)


LD_BLOCK = r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"
#: A type, or a list of them, wherever it stands: at the top, in an array or ``@graph``, or nested.  Any other
#: string is passed over whole, so that what looks like a type within one isn't.
LD_TYPE = r'"@type"\s*:\s*("(?:[^"\\]|\\.)*"|\[(?:\s*"(?:[^"\\]|\\.)*"\s*,?)*\s*\])|"(?:[^"\\]|\\.)*"'


def json_ld_types(html: Column) -> Column:
    """The types of all JSON-LD objects of a page, sorted, each once; a block that isn't JSON has none."""
    blocks = F.filter(all_of(html, LD_BLOCK, 1), lambda b: F.try_parse_json(b).isNotNull())
    found = F.filter(F.flatten(F.transform(blocks, lambda b: all_of(b, LD_TYPE, 1))), lambda t: t != "")
    lists = F.transform(found, lambda t: F.from_json(F.when(t.startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]"))), "array<string>"))
    return sorted_set(F.flatten(lists))


def markdown(html: Column) -> Column:
    """Headings, list items, bold, links and paragraphs as Markdown; other tags go, tables stay."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?is)<head\b.*?</head\s*>", ""), DROPPED, "")
    for level in (1, 2, 3):
        out = F.regexp_replace(out, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n" + "#" * level + " $1\n")
    out = F.regexp_replace(out, r"(?is)<li[^>]*>(.*?)</li>", "\n- $1")
    out = F.regexp_replace(out, r"(?is)<(?:b|strong)>(.*?)</(?:b|strong)>", "**$1**")
    out = F.regexp_replace(out, r"(?is)<a\b[^>]*\bhref=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)")
    out = F.regexp_replace(out, r"(?i)</p>|<br\s*/?>", "\n")
    out = F.regexp_replace(out, PLAIN_TAGS, "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[\x20\t]+", " "), r"\s*\n\s*", "\n"))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """``{{ name }}`` replaced; unknown names stay."""
    for name, value in values.items():
        for form in (f"{{{{ {name} }}}}", f"{{{{{name}}}}}"):
            template = F.replace(template, F.lit(form), value)
    return template


def canonical_json(entries: Column) -> Column:
    """JSON of a map with sorted keys, so that its digest doesn't depend on their order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def input_hash(entries: Column) -> Column:
    return F.sha2(canonical_json(entries), 256)
