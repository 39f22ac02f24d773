"""E-mail columns: candidates, validity, category, confidence, score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as K
from .text import unquote
from .urls import any_of, registered_domain


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?iU){K.EMAIL_PATTERN}"), F.lit(1))


def obfuscated(text: Column) -> Column:
    """Written-out addresses such as ``a [at] b (dot) c``, with the marks put in."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?iU){K.OBFUSCATED_PATTERN}"), F.lit(0)), deobfuscate)


def deobfuscate(text: Column) -> Column:
    for word, mark in (("at", "@"), ("dot", ".")):
        text = F.regexp_replace(text, rf"(?iU)\s*(?:\[|\(|\{{)\s*{word}\s*(?:\]|\)|\}})\s*", mark)
        text = F.regexp_replace(text, rf"(?iU)\s+{word}\s+", mark)
    return text


def address(raw: Column) -> Column:
    """The address in a raw value, lower-cased, or an empty string."""
    value = F.lower(F.trim(F.substring_index(unquote(raw), "?", 1)))
    return F.regexp_replace(F.regexp_extract(value, f"(?iU){K.EMAIL_PATTERN}", 1), r"^[.,;:]+|[.,;:]+$", "")


def host(email: Column) -> Column:
    return F.substring_index(email, "@", -1)


def local(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def verdict(email: Column) -> Column:
    """``valid``, or the first rule that an address breaks."""
    at = F.length(email) - F.length(F.replace(email, F.lit("@"), F.lit("")))
    return (
        F.when((F.length(email) > 254) | (at != 1), "shape")
        .when(~email.rlike("^[^@]{1,64}@") | email.contains(".."), "local_part")
        .when(email.rlike(any_of(K.BAD_EMAIL_PARTS)), "blocked_domain")
        .when(email.rlike(any_of(K.BAD_EMAIL_ENDINGS) + "$"), "asset")
        .when(~email.rlike(r"@(?!-)[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63})+(?<!-)$"), "host")
        .otherwise("valid")
    )


def category(email: Column, site_domain: Column) -> Column:
    # no word has a separator, so the first part of the local part begins with it if the whole does
    generic = local(email).rlike("^" + any_of(K.GENERIC_PREFIXES))
    return F.when(host(email).isin(*K.FREE_MAIL), "free_mail").when(generic, "generic").when(registered_domain(host(email)) == site_domain, "named").otherwise("external_domain")


def mentions(url: Column, words) -> Column:
    return url.rlike("(?i)" + any_of(words))


def confidence(email: Column, source: Column, site_domain: Column, page_url: Column) -> Column:
    own = F.when(registered_domain(F.regexp_replace(host(email), r"^www\.", "")) == site_domain, F.lit(0.02)).otherwise(F.lit(0.0))
    page = F.when(mentions(page_url, ("contact", "about", "support")), F.lit(0.01)).otherwise(F.lit(0.0))
    return F.least(lookup(K.EMAIL_SOURCES, source, 0.7) + own + page, F.lit(0.99))


def score(contact: Column, preference: str = "business", has_mail: Column | None = None) -> Column:
    """Rank of an e-mail contact (struct) in the clean export; ``has_mail`` is the outcome of an optional lookup table."""
    out = contact["confidence"] * 0.52 + lookup(K.EMAIL_CATEGORY_WEIGHTS[preference], contact["category"], 0.0) + lookup(K.EMAIL_SOURCE_WEIGHTS, contact["source_type"], 0.0)
    return out if has_mail is None else out + F.when(has_mail, 0.06).otherwise(-0.20)
