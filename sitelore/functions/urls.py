"""URL and host algebra.

``normalize`` is exact (entities, IDNA, query re-encoding) and runs as an Arrow function; everything on
URLs that are normal already is native.
"""

from __future__ import annotations

import html
import ipaddress
import re
from functools import lru_cache
from urllib.parse import parse_qsl, urlencode, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as K
from .udf import TEXT, FLAG, arrow, struct

_PARTS = re.compile(r"(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?", re.S)
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_TWO_LABELS, _ONE_LABEL = (re.compile(rf"[^.]+\.{x}$") for x in (K.TWO_LABELS, K.ONE_LABEL))
_LABEL = re.compile(r"(?!-)[a-z0-9-]{1,63}(?<!-)")
#: Characters that the standard URL reader drops wherever they stand, and control characters it strips in front.
_DROPPED = str.maketrans("", "", "\t\r\n")


class BadUrl(ValueError):
    pass


def _host(authority: str) -> tuple[str, str]:
    """(host, port) of the part between // and the path; a userinfo is dropped."""
    where = authority.rpartition("@")[2]
    if where.startswith("["):
        host, _, rest = where[1:].partition("]")
        port = rest.removeprefix(":")
    else:
        host, _, port = where.partition(":")
    host = host.lower().strip(".")
    if not host:
        raise BadUrl("URL has no hostname")
    try:
        host = host.encode("idna").decode("ascii")
    except UnicodeError:
        raise BadUrl("invalid international hostname") from None
    try:
        ipaddress.ip_address(host)
    except ValueError:
        if not all(_LABEL.fullmatch(x) for x in host.split(".")):
            raise BadUrl("invalid hostname") from None
    if port and (not port.isascii() or not port.isdigit() or int(port) > 65535):
        raise BadUrl("invalid port")
    return host, str(int(port)) if port else ""


def _query(query: str) -> str:
    wanted = [(k, v) for k, v in parse_qsl(query, keep_blank_values=True) if k.lower() not in K.TRACKING_KEYS and not k.lower().startswith(K.TRACKING_PREFIX)]
    return urlencode(wanted)


def normalize(raw: str | None, lenient_port: bool = False) -> str:
    """The normal form of a website value; raises BadUrl. ``lenient_port`` takes ``host:port`` without a scheme."""
    value = html.unescape(raw or "").strip().strip("\"'")
    if not value:
        raise BadUrl("empty website value")
    value = "https:" + value if value.startswith("//") else value
    scheme = _SCHEME.match(value)
    if scheme and lenient_port and re.match(r"[^:/?#]+\.[^:/?#]+:\d{1,5}(?:[/?#]|$)", value):
        scheme = None
    if scheme and scheme[1].lower() not in ("http", "https"):
        raise BadUrl(f"unsupported URL scheme: {scheme[1].lower()}")
    if "://" not in value:
        value = "https://" + value
    kind, authority, path, query = _PARTS.fullmatch(value.translate(_DROPPED)).groups()
    if (kind or "").lower() not in ("http", "https"):
        raise BadUrl(f"unsupported URL scheme: {(kind or '').lower()}")
    host, port = _host(authority or "")
    kept = _query(query or "")
    return f"{kind.lower()}://{host}{':' + port if port else ''}{re.sub('/{2,}', '/', path or '/')}{'?' + kept if kept else ''}"


def try_normalize(raw: str | None) -> tuple[str | None, str]:
    try:
        return normalize(raw), ""
    except (BadUrl, ValueError) as e:
        return None, str(e)


@lru_cache(maxsize=4096)
def link(base: str, href: str | None) -> str | None:
    """The page a link leads to, or None."""
    value = html.unescape((href or "").strip())
    if not value or value[0] in "#{[":
        return None
    scheme = _SCHEME.match(value)
    if scheme and scheme[1].lower() in K.OTHER_SCHEMES:
        return None
    try:
        return normalize(urljoin(base, value))
    except ValueError:
        return None


def host_of(url: str) -> str:
    return (_PARTS.fullmatch(url)[2] or "").rpartition("@")[2].partition(":")[0].lower().removeprefix("www.")


@lru_cache(maxsize=10_000)
def domain_of_host(host: str) -> str:
    """``registered_domain`` of one host."""
    found = _TWO_LABELS.search(host) or _ONE_LABEL.search(host)
    return found[0] if found else host


def domain_of(url: str) -> str:
    return domain_of_host(host_of(url))


@arrow(struct(url=TEXT, error=TEXT))
def normalized(raw: pd.Series) -> pd.DataFrame:
    """struct<url, error>: the normal form, or null and why not."""
    return pd.DataFrame([try_normalize(x) for x in raw], columns=["url", "error"], dtype=object)


@arrow(TEXT)
def linked(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([link(b or "", h) for b, h in zip(base, href)], dtype=object)


@arrow(FLAG)
def public_ip(value: pd.Series) -> pd.Series:
    return pd.Series([_public(x) for x in value], dtype=bool)


def _public(value: str | None) -> bool:
    try:
        ip = ipaddress.ip_address(value or "")
    except ValueError:
        return False
    return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)


@arrow(FLAG)
def allowed_host(host: pd.Series) -> pd.Series:
    """False for local names and for literal addresses that aren't public; what a name resolves to is not looked up."""

    def one(h):
        h = h or ""
        if not h or h == "localhost" or h.endswith(".local"):
            return False
        try:
            ipaddress.ip_address(h)
        except ValueError:
            return True
        return _public(h)

    return pd.Series([one(x) for x in host], dtype=bool)


_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def full_host(url: Column) -> Column:
    """Host of a URL, lower-cased, without userinfo and port."""
    authority = F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), "^.*@", "")
    return F.lower(F.regexp_replace(authority, ":[0-9]*$", ""))


def hostname(url: Column) -> Column:
    return F.regexp_replace(full_host(url), r"^www\.", "")


site_key = hostname


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def any_of(words) -> str:
    """A pattern of one group that matches any of the words as they are."""
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def registered_domain(host: Column) -> Column:
    """The label before the public suffix with the suffix; other hosts stay as they are."""
    cut = lambda suffix: F.nullif(F.regexp_extract(host, rf"([^.]+\.{suffix})$", 1), F.lit(""))
    return F.coalesce(cut(K.TWO_LABELS), cut(K.ONE_LABEL), host)


def domain_key(url: Column) -> Column:
    return registered_domain(hostname(url))


def same_domain(a: Column, b: Column) -> Column:
    return domain_key(a) == domain_key(b)


def without_tracking(query_: Column) -> Column:
    """A query string without its tracking parameters; the others keep their spelling."""
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query_, "&"), lambda p: (p != "") & ~key(p).isin(*K.TRACKING_KEYS) & ~key(p).startswith(K.TRACKING_PREFIX))
    return F.array_join(kept, "&")


def variants(url: Column, keep_port: bool = False) -> Column:
    """Ordered distinct variants of a normal URL: its own scheme, https, http, each with and without www."""
    host = full_host(url)
    other = F.when(host.startswith("www."), F.right(host, F.length(host) - 4)).otherwise(F.concat(F.lit("www."), host))
    port = F.regexp_extract(url, r"^[a-z]+://[^/?#]*?(:[0-9]+)(?:[/?#]|$)", 1) if keep_port else F.lit("")
    q = query(url)
    rest = F.concat(port, F.when(path(url) == "", F.lit("/")).otherwise(path(url)), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    schemes = (F.regexp_extract(url, r"^([a-z]+)://", 1), F.lit("https"), F.lit("http"))
    return F.array_distinct(F.array(*[F.concat(s, F.lit("://"), h, rest) for s in schemes for h in (host, other)]))


def frontier_key(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))
