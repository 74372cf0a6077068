"""The ways in which an address is turned into a source: they differ, and each caller needs its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def netloc(url: Column) -> Column:
    """What stands between the scheme and the path, as it is; '' without it."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def domain(url: Column) -> Column:
    """netloc in lower case without one leading 'www.'; port and user stay."""
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def host(url: Column) -> Column:
    """netloc without user and port, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":[0-9]*$", ""))


def briefing_source(url: Column) -> Column:
    """netloc or 'unknown'."""
    return F.when(netloc(url) == "", "unknown").otherwise(netloc(url))


def source_label(url: Column) -> Column:
    """GitHub, HN, arXiv, or RSS for all others."""
    h = host(url)
    return (
        F.when((h == "github.com") | h.endswith(".github.com") | h.endswith(".githubusercontent.com"), "GitHub")
        .when(h.isin("news.ycombinator.com", "hacker-news.firebaseio.com"), "HN")
        .when((h == "arxiv.org") | h.endswith(".arxiv.org"), "arXiv")
        .otherwise("RSS")
    )


def favicon(url: Column) -> Column:
    """The favicon address of a page's site, null for what isn't http(s)."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return F.when(scheme.isin("http", "https") & (netloc(url) != ""), F.concat(scheme, F.lit("://"), netloc(url), F.lit("/favicon.ico")))


def is_favicon(url: Column) -> Column:
    """Whether the path, without query and fragment, ends in /favicon.ico."""
    return F.regexp_replace(url, r"[?#].*$", "").endswith("/favicon.ico")


def arxiv_canonical(url: Column) -> Column:
    """An abstract's address over https, without a version."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), r"^http://", "https://"), r"v[0-9]+$", "")


def url_status(url: Column) -> Column:
    """'ok', or why an address is refused."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (
        F.when(u.isNull() | (u == ""), "empty")
        .when(~scheme.isin("http", "https"), "bad_scheme")
        .when(host(u) == "", "no_host")
        .otherwise("ok")
    )


def github_slug(url: Column) -> Column:
    """owner/name of a repository's address, null with fewer path parts."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", ""), "/"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.get(parts, 0), F.get(parts, 1)))
