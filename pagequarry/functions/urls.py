"""URL normalizers and URL predicates.

The normalizers differ on purpose, as the analyses that use them differ; none
stands in for another. Those with query re-encoding or address parsing are Arrow
batch functions, the rest are expressions.
"""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import parse_qs, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query keys that a snapshot's identity ignores, and default ports.
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")
DEFAULT_PORTS = {"http": 80, "https": 443}
# Hosts that are never fetched.
BLOCKED_HOSTS = ("localhost", "localhost.localdomain", "metadata.google.internal", "metadata", "instance-data")


def snapshot_url(url: str | None) -> str | None:
    """A URL's identity for snapshots.

    Scheme and host in lower case, default ports and the tracking keys gone, query
    keys sorted (values kept, blank ones too), no fragment, no slash at the end of
    a path (the root keeps its own).
    """
    if url is None:
        return None
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError:
        return url
    scheme = parts.scheme.lower()
    host = (parts.hostname or "").lower()
    if port and DEFAULT_PORTS.get(scheme) != port:
        host = f"{host}:{port}"
    query = {k: v for k, v in sorted(parse_qs(parts.query, keep_blank_values=True).items()) if k not in TRACKING_KEYS}
    path = parts.path.split(";")[0] if ";" in parts.path.rsplit("/", 1)[-1] else parts.path
    return urlunsplit((scheme, host, path.rstrip("/") or "/", urlencode(query, doseq=True), ""))


def shown_url(url: str | None) -> str | None:
    """A URL that is safe to print: no user information, query or fragment."""
    if url is None:
        return None
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return ""
    host = f"[{host}]" if ":" in host else host
    return urlunsplit((parts.scheme, host + port, parts.path, "", ""))


def _address(host: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    """The address that a host name spells, in any of the notations that resolvers accept."""
    host = host.strip("[]")
    try:
        return ipaddress.ip_address(host)
    except ValueError:
        pass
    parts = host.split(".")
    if not 1 <= len(parts) <= 4 or not all(re.fullmatch(r"0[xX][0-9a-fA-F]+|\d+", p) for p in parts):
        return None
    try:
        numbers = [int(p, 16) if p[:2].lower() == "0x" else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p) for p in parts]
    except ValueError:
        return None
    *heads, last = numbers
    if any(n > 255 for n in heads) or last >= 256 ** (4 - len(heads)):
        return None
    return ipaddress.IPv4Address(sum(n << 8 * (3 - k) for k, n in enumerate(heads)) + last)


def fetchable_url(url: str | None) -> bool:
    """Whether a URL is plain http(s) to a public host.

    Refused are other schemes, user information, backslashes, percent signs or white space in
    the authority, blocked names, and private or reserved addresses however they are spelled.
    """
    if not url or url != url.strip() or any(ord(c) < 32 for c in url):
        return False
    m = re.match(r"^(https?)://([^/?#]*)", url, re.IGNORECASE)
    if not m or not m[2] or any(c in m[2] for c in "@\\% \t"):
        return False
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").rstrip(".").lower()
        parts.port  # noqa: B018  raises for a bad port
        host = host if ":" in host else host.encode("idna").decode("ascii") if host else host
    except (ValueError, UnicodeError):
        return False
    if not host or host in BLOCKED_HOSTS or host.endswith((".localhost", ".local", ".internal")):
        return False
    found = _address(host)
    return found is None or found.is_global and not found.is_multicast


@F.pandas_udf(T.StringType())
def normalize_snapshot_url(urls: pd.Series) -> pd.Series:
    return urls.map(snapshot_url, na_action="ignore")


@F.pandas_udf(T.StringType())
def safe_output_url(urls: pd.Series) -> pd.Series:
    return urls.map(shown_url, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def is_fetchable_url(urls: pd.Series) -> pd.Series:
    return urls.map(fetchable_url)


@F.pandas_udf(T.BooleanType())
def is_sitemap_url(urls: pd.Series) -> pd.Series:
    """Absolute http(s) URL with a host, no user information, white space or fragment."""

    def ok(url: str | None) -> bool:
        if not url or re.search(r"\s", url):
            return False
        try:
            p = urlsplit(url)
            return p.scheme in ("http", "https") and bool(p.hostname) and p.username is None and not p.fragment
        except ValueError:
            return False

    return urls.map(ok)


def url_hash(normalized: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a normalized URL."""
    return F.substring(F.sha2(normalized, 256), 1, 16)


def part_of(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path of an absolute URL; '' if it has none."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)", group)


def host_of(url: Column) -> Column:
    """Host name in lower case, without user information and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part_of(url, 2), r"^[^@]*@", ""), r":\d*$", ""))


def normalize_backlink_url(url: Column) -> Column:
    """The whole URL in lower case, without query, fragment and slashes at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), r"[?#].*$", ""), r"/+$", "")


def link_domain(url: Column) -> Column:
    """Host without one dot at the end and without a leading www."""
    return F.regexp_replace(F.regexp_replace(host_of(url), r"\.$", ""), r"^www\.", "")


def report_domain(url: Column) -> Column:
    """Authority in lower case with every "www." taken out; the port stays."""
    return F.replace(F.lower(part_of(url, 2)), F.lit("www."), F.lit(""))


def section_of(url: Column) -> Column:
    """First path segment as /segment/, or / for the root."""
    first = F.regexp_extract(part_of(url, 3), r"^/*([^/]+)", 1)
    return F.when(first == "", F.lit("/")).otherwise(F.concat(F.lit("/"), first, F.lit("/")))


