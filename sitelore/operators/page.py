"""Pages to evidence: one parse per page, then native passes in a fixed order.

Every evidence row carries (pass, match) ordinals, so that ties are decided by them and not by row order.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import email, html, phone, social, text, urls

KINDS = ("email", "phone", "social", "address", "description")
EVIDENCE = ("value", "kind", "source_url", "source_type", "confidence", "category", "raw_value", "meta")


def parse_pages(pages: DataFrame, *, url: str = "url", html_column: str = "html", max_bytes: int = 5_000_000) -> DataFrame:
    """``pages`` with ``parsed`` (see functions.html) and ``site_domain``; bodies above ``max_bytes`` count as empty."""
    body = F.when(F.octet_length(html_column) <= max_bytes, F.col(html_column)).otherwise("")
    return pages.withColumn("parsed", html.parsed(F.coalesce(body, F.lit("")), F.coalesce(url, F.lit("")))).withColumn("site_domain", urls.domain_key(F.col(url)))


def _numbered(raws: Column, kind: str, source: str, step: int, value=lambda x: F.lit(None).cast("string"), label=lambda x: F.lit("")) -> Column:
    """Candidates of one pass: (kind, pass_ordinal, match_ordinal, source_type, raw, shown, value, label).

    What is costly is computed here, before the explode: behind it, value is a plain column that later expressions share.
    """

    def one(x, i):
        return F.struct(F.lit(kind).alias("kind"), F.lit(step).alias("pass_ordinal"), i.alias("match_ordinal"), F.lit(source).alias("source_type"), x.alias("raw"), x.alias("shown"), value(x).alias("value"), label(x).alias("label"))

    return F.transform(raws, one)


def _prefixed(anchors: Column, prefix: str) -> Column:
    """What follows ``prefix`` in the links that have it."""
    hit = F.filter(anchors, lambda a: F.lower(a["href"]).startswith(prefix))
    return F.transform(hit, lambda a: F.right(a["href"], F.length(a["href"]) - len(prefix)))


def email_candidates(parsed: Column, raw_html: Column) -> Column:
    """The six passes: mailto, protected, structured, visible, raw page, written out."""
    p = lambda f: F.coalesce(parsed[f], F.array().cast("array<string>"))
    mailto = F.flatten(F.transform(_prefixed(parsed["anchors"], "mailto:"), lambda x: F.split(x, ",")))
    passes = (("mailto", mailto), ("cloudflare", p("cf")), ("json_ld", p("ld_emails")), ("visible_text", email.candidates(parsed["text"])), ("html", email.candidates(raw_html)), ("obfuscated", email.obfuscated(parsed["text"])))
    return F.concat(*[_numbered(x, "email", name, i, email.address) for i, (name, x) in enumerate(passes)])


def phone_candidates(parsed: Column) -> Column:
    passes = (("tel", _prefixed(parsed["anchors"], "tel:")), ("json_ld", F.coalesce(parsed["ld_phones"], F.array().cast("array<string>"))), ("visible_text", phone.candidates(parsed["text"])))
    return F.concat(*[_numbered(x, "phone", name, i, text.unquote) for i, (name, x) in enumerate(passes)])


def social_candidates(parsed: Column) -> Column:
    """Links, then structured profiles; ``raw`` is the URL, ``shown`` the link's text."""
    profile = lambda u: social.canonical(u, social.platform(u))
    found = F.filter(parsed["anchors"], lambda a: a["url"].isNotNull() & social.platform(a["url"]).isNotNull())
    links = F.transform(found, lambda a: F.struct(F.lit("social").alias("kind"), F.lit(0).alias("pass_ordinal"), a["pos"].alias("match_ordinal"), F.lit("anchor").alias("source_type"), a["url"].alias("raw"), a["text"].alias("shown"), profile(a["url"]).alias("value"), social.platform(a["url"]).alias("label")))
    return F.concat(links, _numbered(F.coalesce(parsed["ld_same_as"], F.array().cast("array<string>")), "social", "json_ld", 1, profile, social.platform))


def evidence(parsed_pages: DataFrame, keys: Collection[str], *, kinds: Collection[str] = KINDS, url: str = "url", html_column: str = "html", default_region: str = "US") -> DataFrame:
    """Long evidence of parsed pages: ``keys``, ordinals and the evidence columns, not merged yet.

    Kinds that aren't asked for aren't in the plan.
    """
    return _rows(parsed_pages, keys, kinds, url, html_column, default_region, None)


def facts_and_evidence(parsed_pages: DataFrame, keys: Collection[str], facts: Column, *, kinds: Collection[str] = KINDS, url: str = "url", html_column: str = "html", default_region: str = "US") -> DataFrame:
    """The rows of ``evidence`` and one row of kind ``page`` for each page with the struct ``facts``, null elsewhere: both from one parse, without the page's body."""
    return _rows(parsed_pages, keys, kinds, url, html_column, default_region, facts)


def _rows(parsed_pages: DataFrame, keys: Collection[str], kinds: Collection[str], url: str, html_column: str, default_region: str, facts: Column | None) -> DataFrame:
    wanted = set(kinds) or set(KINDS)
    parsed, c = F.col("parsed"), F.col
    found = {"email": lambda: email_candidates(parsed, F.coalesce(html_column, F.lit(""))), "phone": lambda: phone_candidates(parsed), "social": lambda: social_candidates(parsed)}
    base = [F.col(k) for k in keys]
    own = [] if facts is None else [_numbered(F.array(F.lit("")), "page", "", 0)]
    carried = [] if facts is None else [facts.alias("__facts")]
    # one explode over the candidates of all kinds: the page is parsed once
    rows = parsed_pages.select(*base, c(url).alias("source_url"), "site_domain", html.region(F.coalesce(parsed["lang"], F.lit("")), default_region).alias("page_region"), F.explode_outer(F.concat(*own, *[f() for k, f in found.items() if k in wanted])).alias("c"), *carried)
    rows = rows.select(*base, "source_url", "site_domain", "page_region", "c.*", *(["__facts"] if carried else [])).where("raw is not null")
    is_ = lambda k: c("kind") == k
    if "phone" in wanted:
        rows = rows.withColumn("n", phone.normalized(F.when(is_("phone"), c("value")), c("page_region")))
    else:
        rows = rows.withColumn("n", F.lit(None).cast("struct<value:string,region:string,type:string>"))
    rows = rows.withColumn("value", F.when(is_("phone"), c("n.value")).otherwise(c("value")))
    rows = rows.where(is_("page") | (c("value").isNotNull() & (~is_("email") | (email.verdict(c("value")) == "valid"))))
    confidence = F.when(is_("email"), email.confidence(c("value"), c("source_type"), c("site_domain"), c("source_url"))).when(is_("phone"), phone.confidence(c("source_type"), c("source_url"))).otherwise(social.confidence(c("source_type")))
    category = F.when(is_("email"), email.category(c("value"), c("site_domain"))).otherwise(c("label"))
    raw = F.when(is_("email"), F.substring(text.clean(c("raw")), 1, 200)).when(is_("phone"), F.substring(text.clean(c("raw")), 1, 100)).otherwise(c("shown"))
    meta = F.when(is_("phone"), F.create_map(F.lit("region"), c("n.region"), F.lit("type"), c("n.type")))
    last = [] if facts is None else [F.when(is_("page"), c("__facts")).alias("facts")]
    return rows.select(*base, "pass_ordinal", "match_ordinal", "value", "kind", "source_url", "source_type", confidence.alias("confidence"), category.alias("category"), raw.alias("raw_value"), meta.alias("meta"), *last)


def links(parsed_pages: DataFrame, keys: Collection[str], *, url: str = "url") -> DataFrame:
    """(keys, pos, link, text): first occurrence of each page of the same registered domain that a page links to."""
    rows = parsed_pages.select(*keys, F.col(url).alias("__page"), F.explode_outer("parsed.anchors").alias("a")).where("a.url is not null")
    rows = rows.where(urls.same_domain(F.col("__page"), F.col("a.url")))
    return rows.groupBy(*keys, F.col("a.url").alias("link")).agg(F.min(F.struct("a.pos", "a.text")).alias("f")).select(*keys, F.col("f.pos").alias("pos"), "link", F.col("f.text").alias("text"))


def resolver_evidence(parsed: Column) -> Column:
    """What the resolver reads of a page: title, description, names, urls, same_as, country, text."""
    sample = F.substring(text.clean(F.concat_ws(" ", F.array_join(parsed["names"], " "), parsed["text"])), 1, 5000)
    return F.struct(parsed["title"].alias("title"), parsed["meta_description"].alias("description"), sample.alias("text_sample"), parsed["names"].alias("structured_names"), parsed["urls"].alias("structured_urls"), F.slice(F.array_distinct(parsed["ld_same_as"]), 1, 8).alias("structured_same_as"), parsed["country"].alias("structured_country"))
