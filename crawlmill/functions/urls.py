"""URL functions: normalization, resolution, parts, scope, traps, robots and retry decisions."""

from __future__ import annotations

import ipaddress
import posixpath
import re
from urllib.parse import quote, quote_plus, unquote, unquote_to_bytes, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlmill.functions import vectorized

MAX_URL = 8192
# Limits of the trap detector, default ports, retryable statuses, reserved address ranges.
MAX_SEGMENTS, MAX_RUN, MAX_PARAMETERS = 200, 8, 50
DEFAULT_PORTS = {"http": "80", "https": "443"}
RETRY_STATUSES = (408, 425, 429, 500, 502, 503, 504)
MAX_RETRY_AFTER_S = 900
RESERVED = tuple(
    ipaddress.ip_network(n)
    for n in (
        "0.0.0.0/8", "100.64.0.0/10", "192.0.0.0/24", "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
        "240.0.0.0/4", "2001:db8::/32", "2001:10::/28", "fc00::/7", "fe80::/10",
    )
)
_PARTS = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.S)
_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")
# Characters a path keeps unescaped.
_PATH_SAFE = "$&+,/:;=@-_.~!*'()"


def split_url(url: str) -> tuple[str, str, str, str] | None:
    """Scheme, authority, path and query; None for texts that are no URL."""
    if any(c < " " or c == "\x7f" for c in url):
        return None
    m = _PARTS.match(url)
    if not m:
        return None
    scheme, host, path, query = (x or "" for x in m.groups()[:4])
    if _BAD_ESCAPE.search(path):
        return None
    return scheme.lower(), host, path, query


def _host(authority: str) -> tuple[str, str] | None:
    """Lower-case ASCII host and port, or None where either is not allowed."""
    if not authority or "@" in authority or " " in authority:
        return None
    m = re.match(r"^(\[[0-9A-Fa-f:.]+\]|[^:\[\]]*)(?::(\d*))?$", authority)
    if not m:
        return None
    host, port = m.group(1).lower(), m.group(2) or ""
    if port and not 0 < int(port) < 65536:
        return None
    host = host.removesuffix(".")
    if host.startswith("["):
        try:
            return f"[{ipaddress.ip_address(host[1:-1])}]", port
        except ValueError:
            return None
    host = unquote(host)
    if not host:
        return None
    if not host.isascii():
        try:
            host = host.encode("idna").decode("ascii").lower()
        except UnicodeError:
            return None
    return (host, port) if re.match(r"^[a-z0-9._-]+$", host) else None


def _query(query: str) -> str:
    """Query with sorted keys and, within a key, sorted values; malformed pairs are left out."""
    pairs: dict[bytes, list[bytes]] = {}
    for part in query.split("&"):
        if not part or ";" in part or _BAD_ESCAPE.search(part):
            continue
        key, _, value = part.partition("=")
        name, said = (unquote_to_bytes(x.replace("+", " ")) for x in (key, value))
        pairs.setdefault(name, []).append(said)
    return "&".join(f"{quote_plus(k, safe='-_.~')}={quote_plus(v, safe='-_.~')}" for k in sorted(pairs) for v in sorted(pairs[k]))


def normalize_url(raw: str | None) -> str | None:
    """Identity of a URL, or None where it has none.

    Lower-case scheme and host, no default port, trailing host dot, credentials or fragment; a cleaned path
    that keeps its escapes; a sorted query. Only http and https. Null, empty and over-long texts give None.
    """
    if not raw or len(raw.encode("utf-8", "replace")) > MAX_URL:
        return None
    parts = split_url(raw)
    if parts is None or parts[0] not in DEFAULT_PORTS:
        return None
    scheme, authority, path, query = parts
    found = _host(authority)
    if found is None:
        return None
    host, port = found
    where = host + (f":{int(port)}" if port and port != DEFAULT_PORTS[scheme] else "")
    escaped = re.sub(r"[^\x21-\x7e]|[\"<>\\^`{|}]", lambda m: quote(m.group()), path) or "/"
    cleaned = posixpath.normpath(escaped)
    cleaned = "/" + cleaned.lstrip("/") if escaped.startswith("/") else cleaned
    if escaped.endswith("/") and cleaned != "/":
        cleaned += "/"
    plain = quote(unquote_to_bytes(cleaned), safe=_PATH_SAFE)
    if unquote_to_bytes(plain) == unquote_to_bytes(cleaned) and re.search(r"%2f", cleaned, re.I) is None:
        cleaned = plain
    said = _query(query)
    return f"{scheme}://{where}{cleaned}" + (f"?{said}" if said else "")


def resolve_url(base: str | None, raw: str | None) -> str | None:
    """Reference resolved against a base, without fragment; None unless http or https."""
    if not base or not raw or len(raw) > MAX_URL or split_url(raw.strip()) is None:
        return None
    try:
        found = urljoin(base, raw.strip()).partition("#")[0]
    except ValueError:
        return None
    return found if re.match(r"^https?://[^/]", found, re.I) else None


def classify_ip(value: str | None) -> str:
    """Class of an address: ``public`` is the only one a crawler may reach."""
    try:
        ip = ipaddress.ip_address(value or "")
    except ValueError:
        return "invalid_ip"
    ip = getattr(ip, "ipv4_mapped", None) or ip
    private = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7")]
    if ip.is_loopback:
        return "loopback"
    if any(ip.version == n.version and ip in n for n in private):
        return "private"
    if ip.is_link_local:
        return "link_local"
    if ip.is_multicast:
        return "multicast"
    if ip.is_unspecified:
        return "unspecified"
    if str(ip) == "255.255.255.255":
        return "non_global"
    return "reserved" if any(ip.version == n.version and ip in n for n in RESERVED) else "public"


@vectorized("string")
def normalized(urls: pd.Series) -> pd.Series:
    """Column form of ``normalize_url``; each distinct text of a batch is done once."""
    known = {u: normalize_url(u) for u in urls.dropna().unique()}
    return urls.map(known).astype(object).where(urls.notna(), None)


@vectorized("string")
def resolved(bases: pd.Series, urls: pd.Series) -> pd.Series:
    """Column form of ``resolve_url``."""
    return pd.Series([resolve_url(b, u) for b, u in zip(bases, urls)], dtype=object)


@vectorized("string")
def ip_class(values: pd.Series) -> pd.Series:
    """Column form of ``classify_ip``."""
    return values.map(classify_ip, na_action=None)


# Native expressions over normalized URLs.


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def port(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]*:(\d+)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def same_url(a: Column, b: Column) -> Column:
    """Whether two URLs are equal but for their fragments."""
    return F.regexp_replace(a, "#.*$", "") == F.regexp_replace(b, "#.*$", "")


def segment(url: Column) -> Column:
    """First directory of a path: ``/x/``, or ``/`` for the top, or ``unknown`` for no URL."""
    first = F.regexp_extract(path(url), r"^/*([^/]+)", 1)
    return F.when(host(url) == "", "unknown").when(first == "", "/").otherwise(F.concat(F.lit("/"), first, F.lit("/")))


def link_kind(target: Column, page: Column) -> Column:
    """``internal`` if both have one host."""
    return F.when(host(target) == host(page), "internal").otherwise("external")


def trap(url: Column) -> Column:
    """First crawl trap of a URL, or an empty text."""
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, s: Column) -> Column:
        run = F.when(a["last"] == s, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(s.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    longest = F.aggregate(segments, start, step, lambda a: a["most"])
    parameters = F.size(F.filter(F.split(query(url), "&"), lambda p: p != ""))
    return (
        F.when(F.size(segments) > MAX_SEGMENTS, "excessive_path_depth")
        .when(longest > MAX_RUN, "repeated_path_segment")
        .when(query(url).rlike("%(?![0-9A-Fa-f]{2})"), "malformed_query")
        .when(parameters > MAX_PARAMETERS, "excessive_query_parameters")
        .otherwise("")
    )


def scope_decision(url: Column, hosts: list[str], subdomains: bool = False, include_path: list[str] | None = None, exclude_path: list[str] | None = None, include_query: list[str] | None = None, exclude_query: list[str] | None = None) -> Column:
    """``allowed``, or why a URL is outside the scope: the first reason that holds."""
    if not 0 < len(hosts) <= 100:
        raise ValueError("between 1 and 100 hosts")
    for group in (include_path, exclude_path, include_query, exclude_query):
        if group and (len(group) > 100 or any(len(p) > 1024 for p in group)):
            raise ValueError("at most 100 patterns of 1024 characters")
    allowed = host(url).isin([h.lower() for h in hosts])
    if subdomains:
        for h in hosts:
            allowed = allowed | host(url).endswith("." + h.lower())

    def any_of(value: Column, patterns: list[str]) -> Column:
        return value.rlike("|".join(f"(?:{p})" for p in patterns))

    out = F.when(~allowed, "host is outside crawl scope")
    if include_path:
        out = out.when(~any_of(path(url), include_path), "path does not match include scope")
    if exclude_path:
        out = out.when(any_of(path(url), exclude_path), "path matches exclude scope")
    if include_query:
        out = out.when(~any_of(query(url), include_query), "query does not match include scope")
    if exclude_query:
        out = out.when(any_of(query(url), exclude_query), "query matches exclude scope")
    return out.otherwise("allowed")


def retry_decision(status: Column, transient_error: Column) -> Column:
    """Whether a fetch is worth another attempt, and why."""
    return (
        F.when(transient_error, "transient_network")
        .when(status.isNull(), "permanent_network")
        .when(status.isin(*RETRY_STATUSES), "transient_http")
        .otherwise("status_not_retryable")
    )


def retry_after_s(value: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header, whole seconds or an HTTP date, at most fifteen minutes."""
    said = F.trim(value)
    date = F.try_to_timestamp(F.regexp_replace(said, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    ahead = F.greatest(F.unix_timestamp(date) - F.unix_timestamp(now), F.lit(0))
    return F.when(said.rlike(r"^\d{1,9}$"), F.least(said.cast("long"), F.lit(MAX_RETRY_AFTER_S))).otherwise(F.coalesce(F.least(ahead, F.lit(MAX_RETRY_AFTER_S)), F.lit(0)))


def robots_status_policy(status: Column) -> Column:
    """What the status of a robots file means for its host."""
    return F.when(status.between(200, 299), "parse").when(status.isin(401, 403), "disallow_all").when(status.isin(404, 410), "allow_all").otherwise("retry")
