"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; '' where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def normalise(url: Column) -> Column:
    """Host in lower case, no fragment, no UTM parameters; path and other parameters as they are."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_")), "&")
    base = F.regexp_replace(bare, r"\?.*$", "")
    head = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    base = F.concat(F.lower(head), F.substr(base, F.length(head) + 1))
    return F.when(kept == "", base).otherwise(F.concat_ws("?", base, kept))


def slug(host: Column) -> Column:
    """A file name for a host: dots to dashes."""
    return F.regexp_replace(host, r"\.", "-")


def depth(url: Column) -> Column:
    """Number of non-empty path segments."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("long")
