"""The four exports as projections of one joined table: input rows with their site's result.

Input columns stand in ``original`` (map of strings) with their order in ``header``. Results have
status, final_url, domain, contacts, address, description, errors, http_status, fetch_tier.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as K
from ..functions import text
from ..plans.options import CleanOptions
from . import merge

NO_CONTACTS = "array<struct<value:string,kind:string,source_url:string,source_type:string,confidence:double,category:string,raw_value:string,meta:map<string,string>>>"


def _o(key: str) -> Column:
    """A column of the input, trimmed; empty if it isn't there."""
    return text.note(F.col("original")[key])


def _missing() -> Column:
    return F.col("result_status").isNull()


def _or_empty(name: str) -> Column:
    return F.coalesce(name, F.lit(""))


def review_needed() -> Column:
    errors = F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0
    return (_or_empty("import_error") != "") | (_or_empty("last_error") != "") | ~_o("website_finder_status").isin("", "found") | _missing() | ~F.coalesce(F.col("result_status").isin("ok", "partial"), F.lit(False)) | errors


def notes() -> Column:
    status, reason, top = _o("website_finder_status"), _o("website_reason"), _o("website_top_candidates")
    unsure = ~status.isin("", "found")
    parts = F.array(F.when(unsure, F.when(reason != "", reason).otherwise(F.concat(F.lit("Website finder status: "), status))).otherwise(""), F.when(unsure & (top != ""), F.concat(F.lit("Top candidates: "), top)).otherwise(""), text.note(F.col("import_error")), text.note(F.col("last_error")))
    return text.joined(F.concat(parts, F.transform(F.coalesce("errors", F.array().cast("array<string>")), text.note)))


def scrape_status() -> Column:
    unsure = ~_o("website_finder_status").isin("", "found")
    return F.when(~_missing(), F.col("result_status")).when(unsure, "needs_review").when(_or_empty("import_error") != "", "invalid_input").otherwise(_or_empty("task_status"))


def result_columns(kinds: Collection[str], has_finder: bool) -> list[str]:
    """Columns of the wide export for the kinds asked for (none: all)."""
    wants = lambda k: not kinds or k in kinds
    groups = ((K.FINDER_COLUMNS, has_finder), (("scrape_status",), True), (("primary_email", "emails"), wants("email")), (("primary_phone", "phones"), wants("phone")), ((*K.SOCIAL_COLUMNS, "social_profiles"), wants("social")), (("address",), wants("address")), (("company_description",), wants("description")), (("final_url", "domain", "notes"), True))
    return [c for columns, on in groups if on for c in columns]


def visible(header: Sequence[str]) -> list[str]:
    return [c for c in header if c not in K.HIDDEN_COLUMNS]


def _named(values: dict[str, Column], header: Sequence[str], columns: Sequence[str]) -> list[Column]:
    """Input columns in their order, then the others; a result of the same name takes the input's place."""
    own = visible(header)
    out = [(c, values[c] if c in columns else F.coalesce(F.col("original")[c], F.lit(""))) for c in own]
    out += [(c, values[c]) for c in columns if c not in own]
    return [v.alias(c) for c, v in out]


def _result_values() -> dict[str, Column]:
    contacts = F.coalesce("contacts", F.array().cast(NO_CONTACTS))
    done = F.when(notes() == "", F.when(_missing(), "No result available").otherwise("")).otherwise(notes())
    return {
        **{c: _o(c) for c in K.FINDER_COLUMNS},
        "scrape_status": scrape_status(),
        **merge.wide(contacts),
        "address": _or_empty("address"),
        "company_description": _or_empty("description"),
        "final_url": _or_empty("final_url"),
        "domain": F.when(_missing(), _or_empty("domain_key")).otherwise(_or_empty("domain")),
        "http_status": F.coalesce(F.col("http_status").cast("string"), F.lit("")),
        "fetch_tier": _or_empty("fetch_tier"),
        "task_attempts": F.coalesce(F.col("task_attempts").cast("string"), F.lit("")),
        "notes": done,
    }


def wide(joined: DataFrame, header: Sequence[str], *, kinds: Collection[str] = ()) -> DataFrame:
    columns = result_columns(kinds, "website_finder_status" in header)
    return joined.select("row_number", *_named(_result_values(), header, columns))


def review(joined: DataFrame, header: Sequence[str]) -> DataFrame:
    return joined.where(review_needed()).select("row_number", *_named(_result_values(), header, K.REVIEW_COLUMNS))


def long(joined: DataFrame) -> DataFrame:
    """One row for each input row and contact."""
    rows = joined.where(~_missing()).select("row_number", "website", "domain", F.posexplode_outer("contacts").alias("pos", "c")).where("c is not null")
    c = F.col("c")
    picked = (F.col("row_number"), F.col("website"), F.col("domain"), c["kind"], c["category"], c["value"], text.two_decimals(c["confidence"]), c["source_type"], c["source_url"], c["raw_value"])
    return rows.select(*[v.alias(n) for n, v in zip(K.LONG_COLUMNS, picked)], "pos")


def clean_website() -> Column:
    return F.when(_or_empty("final_url") != "", F.col("final_url")).when(_o("final_url") != "", _o("final_url")).when(_o("Website") != "", _o("Website")).when(_or_empty("normalized_url") != "", F.trim("normalized_url")).otherwise(text.note(F.col("website")))


def clean(joined: DataFrame, options: CleanOptions, *, mail_hosts: DataFrame | None = None) -> DataFrame:
    """The leads export: the best value of each field, and evidence columns if asked for.

    Phones are picked once per site before they meet the input rows again, and so are addresses where ``mail_hosts`` (host, has_mail) says which hosts take mail.
    """
    contacts = F.coalesce("contacts", F.array().cast(NO_CONTACTS))
    sites = joined.where(~_missing()).select("domain_key", "contacts").dropDuplicates(["domain_key"]).select("domain_key", F.explode("contacts").alias("c")).select("domain_key", "c.*")
    if "phone" in options.fields:
        phones = merge.primary_phones(sites, ["domain_key"], wanted=options.phone_region, style=options.phone_format, policy=options.phone_country_confidence)
        joined = joined.join(phones, "domain_key", "left")
    else:
        joined = joined.withColumn("phone", F.lit(None).cast("struct<text:string,region:string,type:string,source:string,confidence:double>"))
    if mail_hosts is not None and "email" in options.fields:
        joined = joined.join(merge.primary_emails(sites, ["domain_key"], preference=options.email_preference, hosts=mail_hosts).withColumnRenamed("email", "__mail"), "domain_key", "left")
        mail = F.col("__mail")
    else:
        mail = merge.primary_email(contacts, options.email_preference)
    values: dict[str, Column] = {}
    missing: list[Column] = []
    for field in options.fields:
        label = K.CLEAN_LABELS[field]
        absent = F.lit(f"{label} missing")
        if field == "website":
            value = clean_website()
        elif field == "email":
            value = F.coalesce(mail["value"], F.lit(""))
        elif field == "phone":
            value = F.coalesce(F.col("phone.text"), F.lit(""))
            absent = F.when(_missing(), absent).otherwise("Phone missing or outside selected geography")
        elif field in K.SOCIAL_COLUMNS:
            value = F.coalesce(merge.primary_social(contacts, K.SOCIAL_COLUMNS[field])["value"], F.lit(""))
        else:
            value = _or_empty(field)
        values[label] = value
        missing.append(F.when(value == "", absent).otherwise(""))
    e = lambda c: F.coalesce(c, F.lit(""))
    values |= {"Email Source": e(mail["source_type"]), "Email Confidence": e(text.two_decimals(mail["confidence"])), "Phone Region": e(F.col("phone.region")), "Phone Type": e(F.col("phone.type")), "Phone Source": e(F.col("phone.source")), "Phone Confidence": e(text.two_decimals(F.col("phone.confidence"))), "Review Note": text.joined(F.array(*missing))}
    return joined.select("row_number", *[values[c].alias(c) for c in options.columns])


def website_report(imported: DataFrame) -> DataFrame:
    """Validation of each input row: normalized_website, domain, website_status, notes."""
    bad = _or_empty("import_error") != ""
    return imported.select("row_number", "website", F.coalesce("normalized_url", F.lit("")).alias("normalized_website"), F.coalesce("domain_key", F.lit("")).alias("domain"), F.when(bad, "invalid").otherwise("valid").alias("website_status"), _or_empty("import_error").alias("notes"))


def website_clean(report: DataFrame) -> DataFrame:
    ok = F.col("website_status") == "valid"
    return report.select("row_number", F.when(ok, F.col("normalized_website")).otherwise("").alias("Website"), F.when(ok, "").otherwise(F.col("notes")).alias("Review Note"))


def website_counts(report: DataFrame) -> DataFrame:
    ok = F.col("website_status") == "valid"
    return report.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("found"), F.count_if(~ok).alias("failed"))
