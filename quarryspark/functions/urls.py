"""Url functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def path(url: Column) -> Column:
    """The path of a url, / if it has none."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def target(url: Column) -> Column:
    """Path and query of a url, as robots rules see them."""
    return F.concat(path(url), F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1))


def in_scope(url: Column, origin: Column, folder: Column) -> Column:
    """Whether a http url has the origin's host and lies in its folder, if there is one."""
    return F.coalesce(is_http(url) & (host(url) == host(origin)) & (folder.isNull() | path(url).startswith(folder)), F.lit(False))


def absolute(href: str, base: str) -> str:
    """href as seen from base; as it is where that makes no url."""
    from urllib.parse import urljoin, urlsplit

    try:
        found = urljoin(base, href.strip())
        return found if urlsplit(found).scheme else href
    except ValueError:
        return href


def domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def is_http(url: Column) -> Column:
    return url.rlike("(?i)^https?://[^/?#]")


def scope(url: Column) -> Column:
    """The folder that a crawl from url stays in; null for a root or a file."""
    p = path(url)
    return F.when((p == "/") | p.rlike(r"\.[A-Za-z0-9]{1,8}$"), F.lit(None)).otherwise(F.concat(F.regexp_replace(p, "/+$", ""), F.lit("/")))


def normalize_domain(s: Column) -> Column:
    """Folded, then without www., scheme and path, in this order."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(fold(s), r"^www\.", ""), r"^https?://", ""), "/.*$", "")


def in_domain(d: Column, names: list[str]) -> Column:
    """Whether d is one of names or below one."""
    hit = F.lit(False)
    for n in names:
        hit = hit | (d == n) | d.endswith("." + n)
    return hit
