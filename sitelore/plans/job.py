"""The whole job: a list of websites or companies and a page store to the four exports.

Sites are distinct before anything costly happens. Every stored page of their domains is read once, for its facts, on which sites walk, and for its
evidence, of which the visited pages' rows count. Results meet the input rows again at the end.

Runs append to a state table, one folder for each. A later run with the same output skips the sites that are completed, tries failed ones
again while they have attempts left, and reads a fallback store, if there is one, for those that fail over the first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html, urls
from ..functions import tables as K
from ..operators import crawl, export, merge, resolve, tasks
from ..operators.tables import cut
from ..sources import csv
from .options import Job

#: Attempts of a site over all runs.
MOST_ATTEMPTS = 3
RESULT = f"domain_key string, result_status string, final_url string, domain string, contacts {export.NO_CONTACTS}, address string, description string, title string, pages_scraped array<string>, errors array<string>, http_status int, fetch_tier string, attempts int"


def usable_pages(pages: DataFrame) -> DataFrame:
    """Stored fetches that a crawl may read, with normal URLs: usable, not blocked, of a readable type, from a public host.

    ``pages`` has url, html, and may have status, content_type and tier.
    """
    has = pages.columns
    status = F.col("status") if "status" in has else F.lit(200)
    rows = pages.withColumn("url", urls.normalized("url")["url"]).where("url is not null")
    rows = rows.where(html.usable(status, F.col("html")) & ~html.blocked(status, F.col("html")))
    if "content_type" in has:
        rows = rows.where(html.readable_type(F.col("content_type")))
    return rows.withColumn("tier", F.col("tier") if "tier" in has else F.lit("store"))


def site_results(sites: DataFrame, pages: DataFrame, job: Job) -> DataFrame:
    """One result per site: status, contacts, address, description, title, pages, errors. ``sites`` has domain_key and normalized_url."""
    home = sites.select("domain_key", F.col("normalized_url").alias("url"))
    public = home.withColumn("h", urls.full_host(F.col("url"))).where(urls.allowed_host("h")).drop("h")
    rules = crawl.rules_of(job.kinds, job.max_pages, job.fast, options=job.options if job.by_fields else None, respect_robots=job.respect_robots)
    facts, evidence = crawl.read_pages(public, usable_pages(pages), kinds=rules["kinds"])
    visits = cut(crawl.walk(public, facts, rules)).withColumnRenamed("site_key", "domain_key")
    seen = visits.where("status = 'ok'").select("domain_key", F.col("ordinal").alias("page_ordinal"), crawl.page_key(F.col("url")).alias("key"), F.split("wanted", ",").alias("kinds"))
    # a later page of a fast crawl is read for what is still wanted
    page = seen.join(facts.select("key", "copy", "url", "tier_name", "status", "title", "address", "description"), "key")
    found = evidence.join(page.select("domain_key", "page_ordinal", "key", "copy", "kinds"), ["key", "copy"]).where(F.array_contains("kinds", F.col("kind")))
    lists = merge.contacts(merge.merge(merge.merge_page(found.drop("kinds", "key", "copy"), ["domain_key", "page_ordinal"]), ["domain_key"]), ["domain_key"])
    o = F.col("page_ordinal")

    def fact(name: str) -> Column:
        value = F.when(F.array_contains("kinds", F.lit(name)), F.coalesce(name, F.lit(""))).otherwise("")
        return (merge.earliest(value, o) if job.fast else F.coalesce(merge.longest(value, o), F.lit(""))).alias(name)

    told = page.groupBy("domain_key").agg(fact("address"), fact("description"), merge.earliest(F.col("title"), o).alias("title"), F.min_by("url", o).alias("final_url"), F.min_by("status", o).alias("http_status"), F.sort_array(F.collect_list(F.struct("page_ordinal", "tier_name"))).alias("tiers"))
    walked = visits.groupBy("domain_key").agg(F.min_by("status", "ordinal").alias("home"), F.sort_array(F.collect_list(F.when(F.col("status") == "ok", F.struct("ordinal", "url")))).alias("p"))
    out = home.select("domain_key").join(walked, "domain_key", "left").join(told, "domain_key", "left").join(lists, "domain_key", "left")
    contacts = F.coalesce("contacts", F.array().cast(export.NO_CONTACTS))
    e = lambda c: F.coalesce(c, F.lit(""))
    some = (F.size(contacts) > 0) | (e("address") != "") | (e("description") != "")
    bad = F.coalesce("home", F.lit("local")) != "ok"
    why = F.when(F.col("home").isNull(), "local names and private addresses aren't read").when(F.col("home") == "disallowed", "robots rules forbid the home page").otherwise("home page not available")
    values = {
        "result_status": F.when(bad, "failed").when(some, "ok").otherwise("partial"),
        "final_url": e("final_url"),
        "domain": F.col("domain_key"),
        "contacts": contacts,
        "address": e("address"),
        "description": e("description"),
        "title": e("title"),
        "pages_scraped": F.transform(F.coalesce("p", F.array().cast("array<struct<ordinal:int,url:string>>")), lambda x: x["url"]),
        "errors": F.when(bad, F.array(why)).otherwise(F.array().cast("array<string>")),
        "http_status": F.when(~bad, F.col("http_status")),
        # a site has few pages, so the list is short
        "fetch_tier": F.array_join(F.array_distinct(F.transform(F.coalesce("tiers", F.array().cast("array<struct<page_ordinal:int,tier_name:string>>")), lambda x: x["tier_name"])), "+"),
    }
    return out.select("domain_key", *[v.alias(k) for k, v in values.items()])


def fill_failed(results: DataFrame, sites: DataFrame, fallback: DataFrame, job: Job) -> DataFrame:
    """The results, with those of failed sites replaced by what a second store gives, whose tiers are marked."""
    results = cut(results)
    again = sites.join(results.where("result_status = 'failed'").select("domain_key"), "domain_key", "left_semi")
    more = cut(site_results(again, fallback, job).where("result_status <> 'failed'").withColumn("fetch_tier", F.concat(F.lit("fallback:"), F.col("fetch_tier"))))
    return results.join(more.select("domain_key"), "domain_key", "left_anti").unionByName(more)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The latest result of each site over all runs, with its number of attempts; empty before the first run."""
    try:
        runs = spark.read.parquet(path)
    except Exception as e:  # the folder appears with the first run
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], T.StructType.fromDDL(RESULT))
    names = [f.name for f in T.StructType.fromDDL(RESULT)]
    return runs.groupBy("domain_key").agg(F.max_by(F.struct(*names[1:]), "run").alias("r")).select("domain_key", *[f"r.{n}" for n in names[1:]])


def to_do(sites: DataFrame, state: DataFrame) -> DataFrame:
    """Sites without a result, and failed ones that have attempts left, with the attempts made."""
    known = state.select("domain_key", "result_status", F.col("attempts").alias("made"))
    rows = sites.join(known, "domain_key", "left").withColumn("made", F.coalesce("made", F.lit(0)))
    return rows.where(F.col("result_status").isNull() | ((F.col("result_status") == "failed") & (F.col("made") < MOST_ATTEMPTS))).drop("result_status")


def joined_rows(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Imported rows with their site's result and task state, ready for the exports."""
    state = F.when(F.col("result_status").isNull(), "pending").when(F.col("result_status") == "failed", "failed").otherwise("completed")
    last = F.when(F.col("result_status") == "failed", tasks.error_text(F.col("errors"))).otherwise("")
    return tasks.join_results(rows, results.withColumnRenamed("attempts", "task_attempts")).withColumns({"task_status": state, "last_error": F.coalesce(last, F.lit("")), "errors": F.when(F.col("result_status") == "failed", F.array().cast("array<string>")).otherwise(F.col("errors"))})


def resolved_rows(rows: DataFrame, header: Sequence[str], pages: DataFrame, *, candidates: DataFrame | None = None, company: str | None = None, location: str | None = None, threshold: float = resolve.FOUND) -> tuple[DataFrame, list[str]]:
    """A company list as a list with a Website column and the finder's columns, and its header.

    Companies of one name and place are resolved once. ``candidates`` has company, location and what providers say: url, title, snippet and source, source_order and
    source_score, or provider and position of raw hits.
    """
    own, place = csv.company_columns(header, company, location)
    said = lambda c: F.trim(F.coalesce(F.col("original")[c], F.lit(""))) if c else F.lit("")
    rows = rows.withColumns({"__company": said(own), "__location": said(place)})
    same = F.xxhash64(F.lower("__company"), F.lower("__location"))
    companies = cut(rows.groupBy(same.alias("company_id")).agg(F.min("__company").alias("company"), F.min("__location").alias("location")))
    told = None
    if candidates is not None:
        told = candidates.withColumn("company_id", F.xxhash64(F.lower(F.trim("company")), F.lower(F.trim(F.coalesce("location", F.lit(""))))))
    store = pages.withColumn("url", urls.normalized("url")["url"]).where("url is not null")
    found = resolve.resolve(companies, store, candidates=told, threshold=threshold)
    done = resolve.add_finder_columns(rows.withColumns({"company_id": same, "Website": F.col("original")["Website"] if "Website" in header else F.lit("")}), found)
    added = ["Website", *K.FINDER_COLUMNS, "website_reason", "website_candidates_json"]
    kept = F.map_filter("original", lambda k, v: ~k.isin(*added))
    new = F.map_from_arrays(F.array(*[F.lit(c) for c in added]), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in added]))
    header = [*(c for c in header if c not in added), *added]
    return done.withColumns({"original": F.map_concat(kept, new), "header": F.array(*[F.lit(c) for c in header])}).select(*(c for c in rows.columns if not c.startswith("__"))), header


def run(spark: SparkSession, list_path: str, pages: DataFrame, out: str, job: Job, *, column: str | None = None, find: bool = False, candidates: DataFrame | None = None, company: str | None = None, location: str | None = None, threshold: float = resolve.FOUND, fallback: DataFrame | None = None, mail_hosts: DataFrame | None = None, resume: bool = True, single: bool = False, encoding: str | None = None) -> dict[str, int]:
    """Reads the list, writes results, contacts, review and clean under ``out``; gives the numbers of rows, sites and invalid and failed rows.

    A list without a website column, or any with ``find``, is a company list and is resolved first. With ``single`` each export is one ordered
    file, which sorts it in one task; without, its parts are written as they come, with ``row_number``.
    """
    rows = csv.read_list(spark, list_path, encoding=encoding)
    header = rows.select("header").first()
    if header is None:
        raise ValueError("no rows in the list")
    names, stats = header.header, {}
    if find or (column is None and csv.input_kind(names) == "company"):
        own, place = csv.company_columns(names, company, location)
        said = rows.select(F.col("original")[own].alias("c"), (F.col("original")[place] if place else F.lit("")).alias("l"))
        stats["companies"] = tasks.company_stats(said, "c", "l").first().unique
        rows, names = resolved_rows(rows, names, pages, candidates=candidates, company=company, location=location, threshold=threshold)
        rows = cut(rows)
    rows = cut(tasks.import_rows(csv.with_website(rows, csv.website_column(names, column))))
    sites = tasks.unique_tasks(rows)
    state_path = f"{out}/state"
    state = read_state(spark, state_path) if resume else spark.createDataFrame([], T.StructType.fromDDL(RESULT))
    state = cut(state)
    left = cut(to_do(sites, state))
    if not left.isEmpty():
        new = site_results(left, pages, job)
        if fallback is not None:
            new = fill_failed(new, left, fallback, job)
        new = new.join(left.select("domain_key", (F.col("made") + 1).alias("attempts")), "domain_key")
        new = cut(new.select(*[f.name for f in T.StructType.fromDDL(RESULT)]))
        number = F.lit(spark.read.parquet(state_path).agg(F.max("run")).first()[0] + 1 if resume and not state.isEmpty() else 1)
        new.withColumn("run", number).write.mode("append" if resume else "overwrite").parquet(state_path)
        state = state.join(new.select("domain_key"), "domain_key", "left_anti").unionByName(new)
    joined = cut(joined_rows(rows, state))
    put = lambda df, name, order="row_number": csv.write_export(df, f"{out}/{name}", single=single, order=order)
    put(export.wide(joined, names, kinds=job.kinds), "results")
    put(export.long(joined), "contacts", "input_row")
    put(export.review(joined, names), "review")
    put(export.clean(joined, job.options, mail_hosts=mail_hosts), "clean")
    counted = tasks.import_stats(rows).first()
    failed = joined.where("result_status = 'failed'").select("domain_key").distinct().count()
    return stats | {"rows": counted.rows, "invalid": counted.invalid, "sites": counted.unique, "failed": failed, "read": left.count()}
