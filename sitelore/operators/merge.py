"""Evidence merging, contact order, pivots and primary picks."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import email, phone, tables, text
from .page import EVIDENCE

ORDINALS = ("page_ordinal", "pass_ordinal", "match_ordinal")


def _contact(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in EVIDENCE if c in df.columns])


def _best(rows: DataFrame, keys: Collection[str], rank: Column) -> DataFrame:
    kept = [c for c in rows.columns if c not in keys and c != "kind"]
    best = rows.groupBy(*keys, "kind", F.lower("value").alias("__key")).agg(F.max_by(F.struct(*kept), rank).alias("b"))
    return best.select(*keys, "kind", *[F.col(f"b.{c}").alias(c) for c in kept])


def _order(rows: DataFrame) -> list[Column]:
    return [F.col(c) for c in ORDINALS if c in rows.columns]


def merge(rows: DataFrame, keys: Collection[str]) -> DataFrame:
    """One row for each (keys, kind, value in any case): the most confident, the first of equals by the ordinals.

    Partial maxima are made before the shuffle.
    """
    return _best(rows, keys, F.struct(F.col("confidence"), *[-c for c in _order(rows)]))


def merge_page(rows: DataFrame, keys: Collection[str]) -> DataFrame:
    """Merging within a page: e-mail and phone by confidence, of a profile the last one, all in one aggregation."""
    social = F.col("kind") == "social"
    return _best(rows, keys, F.struct(F.when(social, 0.0).otherwise(F.col("confidence")).alias("c"), *[F.when(social, c).otherwise(-c).alias(f"o{i}") for i, c in enumerate(_order(rows))]))


def contacts(rows: DataFrame, keys: Collection[str]) -> DataFrame:
    """(keys, contacts): merged evidence as an array in contact order: kind, category, falling confidence, value."""
    # structs sort by their first fields; a map can't be compared, so its entries stand in and are made a map again
    names = [c for c in EVIDENCE if c in rows.columns]
    lead = [F.col("kind").alias("__1"), F.col("category").alias("__2"), (-F.col("confidence")).alias("__3"), F.col("value").alias("__4")]
    body = [F.sort_array(F.map_entries(c)).alias(c) if c == "meta" else F.col(c) for c in names]
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*lead, *body))).alias("l"))
    back = lambda x: F.struct(*[(F.map_from_entries(x[c]) if c == "meta" else x[c]).alias(c) for c in names])
    return lists.select(*keys, F.transform("l", back).alias("contacts"))


def values(contacts_: Column, kind: str, category: str | None = None) -> Column:
    hit = F.filter(contacts_, lambda c: (c["kind"] == kind) & (F.lit(True) if category is None else c["category"] == category))
    return F.transform(hit, lambda c: c["value"])


def has_kind(contacts_: Column, kind: str, least: float = 0.0) -> Column:
    return F.exists(contacts_, lambda c: (c["kind"] == kind) & (c["confidence"] >= least))


def fulfilled(contacts_: Column, address: Column, description: Column) -> Column:
    """Kinds that a site has something of."""
    tests = [(k, has_kind(contacts_, k)) for k in ("email", "phone", "social")] + [("address", address != ""), ("description", description != "")]
    return F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests]), lambda k: k.isNotNull())


def wide(contacts_: Column) -> dict[str, Column]:
    """Result columns of all contacts; no shuffle, only filters over the array."""
    emails, phones, socials = (values(contacts_, k) for k in ("email", "phone", "social"))
    out = {"primary_email": text.first(emails), "emails": text.joined(emails), "primary_phone": text.first(phones), "phones": text.joined(phones)}
    out |= {column: text.joined(values(contacts_, "social", platform)) for column, platform in tables.SOCIAL_COLUMNS.items()}
    return out | {"social_profiles": text.joined(socials)}


def primary(contacts_: Column, kind: str, rank) -> Column:
    """The contact of the smallest rank struct (a function of the contact), or null."""
    ranked = F.transform(F.filter(contacts_, lambda c: c["kind"] == kind), lambda c: F.struct(rank(c).alias("rank"), c.alias("c")))
    best = F.reduce(ranked, F.get(ranked, F.lit(0)), lambda a, b: F.when(b["rank"] < a["rank"], b).otherwise(a))
    return best["c"]


def primary_email(contacts_: Column, preference: str = "business") -> Column:
    return primary(contacts_, "email", lambda c: F.struct((-email.score(c, preference)).alias("s"), c["value"].alias("v")))


def primary_emails(rows: DataFrame, keys: Collection[str], *, preference: str = "business", hosts: DataFrame | None = None) -> DataFrame:
    """(keys, email): the best address of each key, a contact. ``rows`` is merged evidence.

    ``hosts`` (host, has_mail) is the outcome of a lookup of mail exchangers; addresses of hosts it doesn't have are neither raised nor lowered. Hosts repeat, so it is joined on
    distinct hosts.
    """
    mails = rows.where("kind = 'email'")
    contact = _contact(mails)
    score = email.score(contact, preference)
    if hosts is not None:
        known = hosts.groupBy(F.lower("host").alias("__host")).agg(F.bool_or("has_mail").alias("__mail"))
        mails = mails.withColumn("__host", F.lower(email.host(F.col("value")))).join(known, "__host", "left")
        score = F.when(F.col("__mail").isNull(), email.score(contact, preference)).otherwise(email.score(contact, preference, F.col("__mail")))
    best = F.struct((-F.round(score, 9)).alias("s"), F.col("value").alias("v"))
    return mails.groupBy(*keys).agg(F.min_by(contact, best).alias("email"))


def primary_social(contacts_: Column, platform: str) -> Column:
    own = F.filter(contacts_, lambda c: c["category"] == platform)
    return primary(own, "social", lambda c: F.struct((-c["confidence"]).alias("s"), F.length(c["value"]).alias("n"), c["value"].alias("v")))


def primary_phones(rows: DataFrame, keys: Collection[str], *, wanted: str = "AUTO", style: str = "national", policy: str = "strict") -> DataFrame:
    """(keys, phone struct<text, region, type, source, confidence>): the best phone of each key that fits the wanted region.

    ``rows`` is merged evidence. Numbers are written once each, before the pick.
    """
    phones = rows.where("kind = 'phone'").withColumn("shown", phone.formatted(wanted, style)("value")).where("shown.text <> ''")
    contact = _contact(rows)
    rank = F.struct(phone.score(contact, F.col("shown.region"), wanted, policy).alias("s"))
    best = F.struct((-rank["s"]).alias("s"), F.col("shown.text").alias("t"), F.struct(F.col("shown.text").alias("text"), F.col("shown.region").alias("region"), F.col("shown.type").alias("type"), F.col("source_type").alias("source"), F.col("confidence").alias("confidence")).alias("p"))
    return phones.groupBy(*keys).agg(F.min(best).alias("b")).select(*keys, F.col("b.p").alias("phone"))


def longest(value: Column, ordinal: Column) -> Column:
    """Longest text of a group, the first of equals."""
    return F.max_by(value, F.struct(F.length(value), -ordinal))


def earliest(value: Column, ordinal: Column) -> Column:
    """First text of a group that isn't empty."""
    return F.coalesce(F.min_by(value, F.when(value != "", ordinal)), F.lit(""))
