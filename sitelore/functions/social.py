"""Social profiles: platform of a URL and its canonical form, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as K
from .email import lookup
from .urls import any_of, path


def platform(url: Column) -> Column:
    """Platform whose host or subdomain a URL has, or null."""
    out = None
    for name, hosts in K.SOCIAL_HOSTS.items():
        test = url.rlike(rf"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(?:[^/?#:@]*\.)?{any_of(hosts)}(?:[:/?#]|$)")
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out


def _profile(name: str) -> str:
    """Pattern whose first group is the part of a path that names a profile."""
    if name in K.SOCIAL_TWO_PARTS:
        deep = f"(?i:{'|'.join(K.SOCIAL_TWO_PARTS[name])})/[^/]+"
        return f"^/(@[^/]+|{deep})" if name == "youtube" else f"^/({deep})"
    if name == "tiktok":
        return "^/(@[^/]+)"
    no = "|".join(w.replace(".", r"\.") for w in K.SOCIAL_FIRST_REJECT[name])
    if name == "facebook":
        return rf"^/((?i:pages)/[^/]+/[^/]+|(?!(?i:pages|{no})(?:/|$))[^/]+)"
    return rf"^/(?!(?i:{no})(?:/|$))([^/]+)"


def canonical(url: Column, kind: Column) -> Column:
    """The profile's canonical URL, or null for what is no profile."""
    p = F.regexp_replace(F.regexp_replace(path(url), "/{2,}", "/"), "/+$", "")
    out = None
    for name, host in K.SOCIAL_CANONICAL.items():
        value = F.concat(F.lit(f"https://{host}/"), F.nullif(F.regexp_extract(p, _profile(name), 1), F.lit("")))
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return F.when(~p.rlike("(?i)" + any_of(K.SOCIAL_REJECT)), out)


def confidence(source: Column) -> Column:
    return lookup(K.SOCIAL_SOURCES, source, 0.0)
