"""Company to website: candidates, merging, evidence score, best match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..functions import tables as K
from ..functions.email import lookup
from .page import parse_pages, resolver_evidence
from .tables import broadcast_if_small, cut

FOUND = 0.62


def suffixes(location: Column) -> Column:
    """Suffixes to guess with: those of the first place named in the location, then the usual ones."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(location, F.lit(""))), F.lit(" "))
    usual = F.array(*[F.lit(s) for s in K.GUESS_SUFFIXES])
    out = None
    for place, own in K.PLACE_SUFFIXES.items():
        test = padded.contains(f" {place} ")
        value = F.array_distinct(F.concat(F.array(*[F.lit(s) for s in own]), usual))
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.slice(out.otherwise(usual), 1, 7)


def domain_guesses(companies: DataFrame) -> DataFrame:
    """Candidate rows of guessed domains: the tokens of the name joined and dashed, with each suffix."""
    t = text.tokens(F.col("company"))
    bases = F.array_distinct(F.array(F.array_join(t, ""), F.array_join(t, "-")))
    rows = companies.where(F.size(t) > 0).select("company_id", "company", "location", F.posexplode(bases).alias("b", "base"), suffixes(F.col("location")).alias("s"))
    rows = rows.select("company_id", "company", "location", "b", "base", F.posexplode("s").alias("i", "suffix"))
    url = F.concat(F.lit("https://"), F.col("base"), F.lit("."), F.col("suffix"), F.lit("/"))
    out = rows.select("company_id", "company", "location", url.alias("url"), F.lit("domain_guess").alias("source"), (F.lit(1000) + F.col("b") * 10 + F.col("i")).cast("int").alias("source_order"), F.lit("").alias("title"), F.lit("").alias("snippet"), F.lit(0.02).alias("source_score"))
    return not_directory(out)


def directory(url: Column) -> Column:
    host = urls.hostname(url)
    return host.isin(*K.DIRECTORY_HOSTS) | urls.registered_domain(host).isin(*K.DIRECTORY_HOSTS)


def not_directory(candidates: DataFrame) -> DataFrame:
    return candidates.where(~directory(F.col("url")))


def provider_candidates(rows: DataFrame) -> DataFrame:
    """Candidates out of a provider table (company, url, source, title, snippet, source_score): normal URLs, no directories, clean texts."""
    done = rows.withColumn("url", urls.normalized(F.col("url"))["url"]).where("url is not null")
    return not_directory(done.withColumns({"title": text.clean(F.col("title")), "snippet": text.clean(F.col("snippet"))}))


def hits_of_json(answers: DataFrame, *, body: str = "body") -> DataFrame:
    """Raw hits (company_id, company, location, provider, position, url, title, snippet) out of the JSON answers of providers, natively.

    An answer that isn't JSON, has another form or comes from a provider that isn't known has none; other providers' answers don't suffer.
    """
    text_ = F.col(body)
    none = F.lit(None).cast("array<struct<url:string,title:string,snippet:string>>")
    hit = lambda url, title, snippet: F.struct(url.alias("url"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(snippet, F.lit("")).alias("snippet"))
    found = none

    def list_hits(listed: Column, url: str, title: str, snippet: str | None) -> Column:
        return F.transform(listed, lambda x: hit(x[url], x[title], x[snippet] if snippet else F.lit("")))

    for name, (at, url, title, snippet) in K.ANSWERS.items():
        listed = F.from_json(text_ if at == "$" else F.get_json_object(text_, at), f"array<struct<{url}:string,{title}:string{f',{snippet}:string' if snippet else ''}>>")
        hits = list_hits(listed, url, title, snippet)
        if name in K.ABSTRACT:
            first = F.array(hit(*[F.get_json_object(text_, p) for p in K.ABSTRACT[name]]))
            hits = F.concat(first, F.coalesce(hits, F.array().cast("array<struct<url:string,title:string,snippet:string>>")))
        found = F.when(F.col("provider") == name, hits).otherwise(found)
    entities = F.map_values(F.from_json(F.get_json_object(text_, "$.entities"), K.ENTITIES))
    claimed = F.flatten(F.transform(entities, lambda e: F.transform(F.coalesce(e["claims"]["P856"], F.array().cast("array<struct<mainsnak:struct<datavalue:struct<value:string>>>>")), lambda c: hit(c["mainsnak"]["datavalue"]["value"], e["labels"]["en"]["value"], e["descriptions"]["en"]["value"]))))
    found = F.when(F.col("provider") == "wikidata", claimed).otherwise(found)
    return answers.select("company_id", "company", "location", "provider", F.posexplode(found).alias("position", "h")).select("company_id", "company", "location", "provider", "position", "h.*").where("url <> ''")


def scored_hits(hits: DataFrame) -> DataFrame:
    """Candidate rows out of raw provider hits (company_id, company, location, provider, position from 0, url, title, snippet).

    A provider that isn't known or whose rule doesn't read that far gives none. ``duckduckgo`` has its abstract at position 0 and results behind it.
    """
    rules = F.create_map(*[x for i, (n, p) in enumerate(K.PROVIDERS.items()) for x in (F.lit(n), F.struct(F.lit(i).alias("place"), *[F.lit(v).alias(k) for k, v in p._asdict().items()]))])
    rows = hits.withColumn("__r", F.try_element_at(rules, F.col("provider"))).where(F.col("position") < F.col("__r.most"))
    # an Arrow function runs for every row; without a name there is nothing to compare
    alike = text.closest(F.when(F.col("__r.alike") > 0, text.signature(F.col("company"))), F.array(text.signature(F.col("title"))))
    score_ = F.greatest(F.col("__r.least"), F.col("__r.base") - F.col("__r.step") * F.col("position")) + F.col("__r.alike") * alike
    order = (F.col("__r.place") * 100 + F.col("position")).cast("int")
    return provider_candidates(rows.select("company_id", "company", "location", F.trim("url").alias("url"), F.col("provider").alias("source"), order.alias("source_order"), "title", "snippet", score_.alias("source_score")))


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """One candidate per company and registered domain: the best source, with a bonus for each further source up to .12."""
    domain = urls.domain_key(F.col("url"))
    body = F.struct("url", "source", "source_order", "title", "snippet", "source_score")
    best = candidates.groupBy("company_id", "company", "location", domain.alias("domain")).agg(F.max_by(body, F.struct(F.col("source_score"), -F.col("source_order"))).alias("b"), F.countDistinct("source").alias("source_count"))
    bonus = F.least(F.lit(0.12), (F.col("source_count") - 1) * 0.04)
    return best.select("company_id", "company", "location", "domain", "b.url", "b.source", "b.source_order", "b.title", "b.snippet", (F.col("b.source_score") + bonus).alias("source_score"), "source_count")


def domain_label(url: Column) -> Column:
    """First label of a URL's registered domain, lower-cased."""
    return F.lower(F.substring_index(urls.domain_key(url), ".", 1))


def label_similarity(own: Column, label: Column) -> Column:
    """1 if a domain label is the company's tokens written together, else the share of its tokens in the label."""
    other = text.tokens(F.regexp_replace(label, "[-_]", " "))
    same = F.array_join(own, "") == F.regexp_replace(label, "[^a-z0-9]", "")
    return F.when((F.size(own) == 0) | (F.size(other) == 0), F.lit(0.0)).when(same, F.lit(1.0)).otherwise(text.overlap(own, other))


def domain_similarity(company: Column, url: Column) -> Column:
    return label_similarity(text.tokens(company), domain_label(url))


def location_score(location: Column, evidence: Column) -> Column:
    return text.overlap(text.tokens(location), text.tokens(evidence))


def top_candidates(candidates: DataFrame, limit: int = 12) -> DataFrame:
    """The first ``limit`` candidates of each company by (source score, domain, name), as pre_rank."""
    # parts that several expressions read are columns of their own, which keeps the plan small
    parts = candidates.withColumns({"__own": text.tokens(F.col("company")), "__label": domain_label(F.col("url")), "__title": text.tokens(F.col("title"))})
    ranked = parts.withColumns({"__d": label_similarity(F.col("__own"), F.col("__label")), "__n": text.token_similarity(F.col("__own"), F.col("__title"))})
    order = Window.partitionBy("company_id").orderBy(F.desc("source_score"), F.desc("__d"), F.desc("__n"), "source_order", "url")
    return ranked.withColumn("pre_rank", F.row_number().over(order)).where(F.col("pre_rank") <= limit).drop("__d", "__n", "__own", "__label", "__title")


#: Characters of a page that the resolver reads.
READ = 1_000_000
EVIDENCE = "final_url string, page_title string, description string, text_sample string, structured_names array<string>, structured_urls array<string>, structured_same_as array<string>, structured_country string, ok boolean, parked boolean"


def verify(candidates: DataFrame, pages: DataFrame | None) -> DataFrame:
    """Candidates with the evidence of their pages, null where the store has none; ``score`` reads it.

    ``pages`` has normal URLs, html, and may have status and final_url. Only pages that some candidate names are parsed, each once, and what goes
    on is narrow. Local names and private addresses are never looked up.
    """
    if pages is None:
        return candidates.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (f.split(" ", 1) for f in EVIDENCE.split(", "))])
    key = urls.frontier_key
    asked = candidates.select(key(F.col("url")).alias("__key"), urls.full_host(F.col("url")).alias("h")).distinct()
    asked = cut(asked.where(urls.allowed_host("h")).select("__key"))
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    final = F.coalesce("final_url", F.col("url")) if "final_url" in pages.columns else F.col("url")
    rows = pages.select(key(F.col("url")).alias("__key"), "url", F.substring(F.coalesce("html", F.lit("")), 1, READ).alias("html"), status.alias("status"), final.alias("final_url"))
    rows = rows.join(broadcast_if_small(asked), "__key", "left_semi").where("html <> ''")
    read = parse_pages(rows).select("__key", "final_url", "status", "html", resolver_evidence(F.col("parsed")).alias("r"))
    ok = F.coalesce(F.col("status").between(200, 399), F.lit(False))
    columns = [F.col("final_url"), F.col("r.title").alias("page_title"), *[F.col(f"r.{n}").alias(n) for n in ("description", "text_sample", "structured_names", "structured_urls", "structured_same_as", "structured_country")], ok.alias("ok"), html.parked(F.col("r.title"), F.col("r.description"), F.col("r.text_sample")).alias("parked")]
    found = read.select("__key", F.struct(*columns).alias("e"), F.struct((~ok).alias("bad"), F.xxhash64("html").alias("h")).alias("o")).groupBy("__key").agg(F.min_by("e", "o").alias("e")).select("__key", "e.*")
    return candidates.withColumn("__key", key(F.col("url"))).join(found, "__key", "left").drop("__key")


def resolve(companies: DataFrame, pages: DataFrame | None, *, candidates: DataFrame | None = None, guess: bool = True, threshold: float = FOUND) -> DataFrame:
    """``matches`` of companies (company_id, company, location): candidates of providers and guessed domains, verified by their pages and scored.

    ``candidates`` has company_id and either source, source_order and source_score, or provider and position of raw hits.
    """
    named = companies.where(F.trim(F.coalesce("company", F.lit(""))) != "")
    parts = [domain_guesses(named)] if guess else []
    if candidates is not None:
        raw = "provider" in candidates.columns
        told = candidates.select("company_id", "url", "title", "snippet", *(("provider", "position") if raw else ("source", "source_order", "source_score")))
        told = named.select("company_id", "company", "location").join(told, "company_id")
        parts.append((scored_hits(told) if raw else provider_candidates(told)).select("company_id", "company", "location", "url", "source", "source_order", "title", "snippet", "source_score"))
    if not parts:
        raise ValueError("a company list needs candidates or guesses")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return matches(companies, score(verify(top_candidates(merge_candidates(every)), pages)), threshold=threshold)


def score(verified: DataFrame) -> DataFrame:
    """Candidates joined with their page evidence, with name_score, domain_score, location_score, score and reason.

    Evidence columns: final_url, page_title, description, text_sample, ok, parked, structured_names,
    structured_urls, structured_same_as, structured_country; null where the page is missing.
    """
    c = F.col
    e = lambda name: F.coalesce(c(name), F.lit(""))
    names = F.coalesce("structured_names", F.array().cast("array<string>"))
    final = F.when(e("final_url") != "", c("final_url")).otherwise(c("url"))
    # all texts of a candidate go to one Arrow call, so rows are neither multiplied nor joined back
    texts = F.concat(F.array(e("title"), e("snippet"), e("page_title"), e("description"), F.substring(e("text_sample"), 1, 2000)), names)
    v = verified.withColumn("name_score", text.closest(text.signature(c("company")), F.transform(texts, text.signature)))
    v = v.withColumn("__final", final).withColumns({"__domain": urls.domain_key(c("__final")), "__own": text.tokens(c("company")), "__place": text.tokens(c("location")), "__said": text.tokens(F.concat_ws(" ", e("title"), e("snippet"), e("page_title"), e("description"), e("text_sample"), e("structured_country")))})
    v = v.withColumn("__label", F.lower(F.substring_index("__domain", ".", 1)))
    same = lambda a: F.exists(F.coalesce(c(a), F.array().cast("array<string>")), lambda u: urls.domain_key(u) == c("__domain"))
    # a structured name counts only where it reads like a URL whose domain fits
    likely = F.exists(names, lambda n: label_similarity(c("__own"), domain_label(n)) >= 0.75)
    v = v.withColumns({"domain_score": label_similarity(c("__own"), c("__label")), "location_score": text.overlap(c("__place"), c("__said"))})
    structured = F.when(likely, 0.06).otherwise(0.0) + F.when(same("structured_urls"), 0.04).otherwise(0.0) + F.when(same("structured_same_as"), 0.02).otherwise(0.0)
    source = F.greatest(c("source_score"), lookup(K.SOURCE_FLOORS, c("source"), 0.0))
    agreement = F.least(F.lit(0.12), F.greatest(F.lit(0), c("source_count") - 1) * 0.04)
    ok = F.coalesce("ok", F.lit(False))
    total = c("name_score") * 0.42 + c("domain_score") * 0.27 + c("location_score") * 0.11 + source + F.when(ok, 0.06).otherwise(0.0) + agreement + F.least(structured, F.lit(0.10))
    for test, factor in ((directory(c("__final")), 0.25), (~ok, 0.75), (F.coalesce("parked", F.lit(False)), 0.2), ((c("domain_score") == 0) & (c("name_score") < 0.45), 0.55)):
        total = F.when(test, total * factor).otherwise(total)
    two = text.two_decimals
    reason = F.concat(F.lit("name="), two("name_score"), F.lit(", domain="), two("domain_score"), F.lit(", location="), two("location_score"), F.lit(", source="), c("source"), F.lit(", agreement="), c("source_count").cast("string"), F.when(c("structured") > 0, F.concat(F.lit(", structured="), two("structured"))).otherwise(""))
    return v.withColumn("structured", structured).withColumns({"score": F.least(total, F.lit(0.99)), "reason": reason}).drop("structured", "__final", "__domain", "__own", "__place", "__said", "__label")


def matches(companies: DataFrame, scored: DataFrame, *, threshold: float = FOUND, reported: int = 5) -> DataFrame:
    """One row per company: website, status, confidence, source, reason and the first ``reported`` candidates."""
    e = lambda name, other: F.when(F.coalesce(name, F.lit("")) != "", F.col(name)).otherwise(F.col(other))
    shown = F.struct(e("final_url", "url").alias("url"), "source", F.round("score", 3).alias("score"), "reason", e("page_title", "title").alias("title"))
    row = F.struct((-F.col("score")).alias("s"), F.col("pre_rank").alias("p"), shown.alias("c"), F.col("score").alias("exact"))
    # a company has twelve candidates at most
    lists = scored.groupBy("company_id").agg(F.sort_array(F.collect_list(row)).alias("l"))
    top, best = F.get("l", F.lit(0))["c"], F.get("l", F.lit(0))["exact"]
    status = F.when(F.trim(F.coalesce("company", F.lit(""))) == "", "invalid_input").when(F.col("l").isNull(), "not_found").when(best >= threshold, "found").otherwise("review")
    out = companies.join(lists, "company_id", "left").withColumn("status", status)
    has = F.col("status").isin("found", "review")
    pick = lambda f, default: F.when(has, top[f]).otherwise(F.lit(default))
    return out.select("company_id", "company", "location", F.when(F.col("status") == "found", top["url"]).otherwise("").alias("website"), "status", F.when(has, best).otherwise(0.0).alias("confidence"), pick("source", "").alias("source"), pick("reason", "").alias("reason"), F.coalesce(F.transform(F.slice("l", 1, reported), lambda x: x["c"]), F.array().cast("array<struct<url:string,source:string,score:double,reason:string,title:string>>")).alias("candidates"))


def summary(candidates: Column, limit: int = 3) -> Column:
    """``url (score, source) - title`` of the first candidates."""

    def one(c):
        return F.concat(c["url"], F.lit(" ("), c["score"].cast("string"), F.when(c["source"] != "", F.concat(F.lit(", "), c["source"])).otherwise(""), F.lit(")"), F.when(c["title"] != "", F.concat(F.lit(" - "), c["title"])).otherwise(""))

    return F.array_join(F.transform(F.slice(candidates, 1, limit), one), " | ")


def add_finder_columns(rows: DataFrame, found: DataFrame, *, key: str = "company_id") -> DataFrame:
    """Input rows with Website and the finder columns; an existing Website stays where none was found."""
    m = found.select(F.col("company_id").alias(key), F.col("website").alias("__w"), F.col("status").alias("website_finder_status"), F.when(F.col("confidence") > 0, text.two_decimals("confidence")).otherwise("").alias("website_confidence"), F.col("source").alias("website_source"), F.col("reason").alias("website_reason"), summary(F.col("candidates")).alias("website_top_candidates"), F.to_json("candidates").alias("website_candidates_json"))
    old = F.coalesce("Website", F.lit("")) if "Website" in rows.columns else F.lit("")
    return rows.join(m, key, "left").withColumn("Website", F.when(F.coalesce("__w", F.lit("")) != "", F.col("__w")).otherwise(old)).drop("__w")
