"""URLs and HTML by regular expressions that Java and RE2 read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid")
HOST = "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def found(text: str | Column, pattern: str, group: int = 1) -> Column:
    """First match, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def host(url: str | Column, strip_www: bool = False) -> Column:
    """E10."""
    h = F.lower(found(url, HOST))
    return F.regexp_replace(h, "^www\\.", "") if strip_www else h


def normalise(url: Column) -> Column:
    """Lower-case host, no default port, / after a bare host; a URL without a host stays as it is."""
    scheme, h = F.lower(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)), F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    rest = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$", 1)
    bare = F.when(scheme == "https", F.regexp_replace(F.lower(h), ":443$", "")).when(scheme == "http", F.regexp_replace(F.lower(h), ":80$", "")).otherwise(F.lower(h))
    return F.when(h == "", url).otherwise(F.concat(scheme, F.lit("://"), bare, F.when(rest.rlike("^/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def strip_tracking(url: Column) -> Column:
    """Without tracking parameters; fragment, order and other parameters stay."""
    path, query, fragment = (F.regexp_extract(url, "^([^?#]*)(?:\\?([^#]*))?(#.*)?$", g) for g in (1, 2, 3))
    left = F.array_join(F.filter(F.split(query, "&"), lambda p: ~F.split_part(p, F.lit("="), F.lit(1)).isin(*TRACKING)), "&")
    return F.concat(path, F.when(left == "", "").otherwise(F.concat(F.lit("?"), left)), fragment)


def meta(html: str, names: str, attribute: str = "(?:property|name|http-equiv)") -> Column:
    """Content of the first meta tag with one of the names, in either attribute order."""
    a = f"(?i)<meta[^>]*{attribute}=[\"'](?:{names})[\"'][^>]*content=[\"']([^\"']*)[\"']"
    b = f"(?i)<meta[^>]*content=[\"']([^\"']*)[\"'][^>]*{attribute}=[\"'](?:{names})[\"']"
    return F.coalesce(found(html, a), found(html, b))


def links(html: str | Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?i)href=[\"']([^\"']*)[\"']"), F.lit(1))


def decode_entities(text: Column) -> Column:
    """Six entities in this order, so &amp;lt; becomes <."""
    for entity, char in (("&#x27;", "'"), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text
