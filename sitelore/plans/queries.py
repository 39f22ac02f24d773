"""Registered queries of the contact engine and the SQL that gives the same rows.

The test tables hold few contacts, so several queries build pages, links or evidence out of table columns;
their SQL computes the expected rows from the same columns and never parses HTML.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import email, html, phone, social, tables, text, urls
from ..operators import crawl, export, merge, page, rank, resolve, tasks
from ..streaming import events as job_events
from .options import clean_options

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


#: Tables whose rows are costly to read: pages are parsed, texts searched.
COSTLY = ("pages", "documents")


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # a table of fewer splits than cores, as one small file, is dealt first; any larger one is read as it lies
    return _dealt(rows) if name in COSTLY and rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else rows


def _dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt over all cores before pages are made of them, as the files of a page table would be."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _pick(key: Column, values) -> Column:
    """The value at key modulo the number of values."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


def _sql_pick(key: str, values) -> str:
    return f"([{_in(values)}])[({key}) % {len(values)} + 1]"


# Parts of the address of every page, as SQL: the generator writes scheme://host/path?query#fragment with ASCII hosts.
PARTS = """
  select page_id, url, regexp_extract(u, '^([a-z]+)://', 1) as s, lower(regexp_extract(u, '^[a-z]+://([^/?]*)', 1)) as h,
         regexp_replace(regexp_extract(u, '^[a-z]+://[^/?]*([^?]*)', 1), '/+', '/', 'g') as p,
         regexp_extract(u, '\\?(.*)$', 1) as q
  from (select page_id, url, regexp_replace(url, '#.*$', '') as u from pages)
"""
KEPT = f"""array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' and lower(split_part(x, '=', 1)) not in ({_in(tables.TRACKING_KEYS)})
  and not starts_with(lower(split_part(x, '=', 1)), '{tables.TRACKING_PREFIX}')), '&')"""
NORMAL = f"""
  select page_id, s, h, case when p = '' then '/' else p end as p, k, s || '://' || h || case when p = '' then '/' else p end || case when k = '' then '' else '?' || k end as url
  from (select *, {KEPT} as k from ({PARTS}))
"""
SITE = "regexp_replace(h, '^www\\.', '')"
DOMAIN = "array_to_string(list_slice(string_split(" + SITE + ", '.'), -2, -1), '.')"


@query(f"select page_id, url, '' as error from ({NORMAL})")
def url_normalize(spark, sf_dir):
    """P01, P02 over every page."""
    pages = t(spark, sf_dir, "pages").select("page_id", urls.normalized("url").alias("n"))
    return pages.select("page_id", "n.url", "n.error")


@query(f"select page_id, k as kept from (select page_id, {KEPT} as k from ({PARTS}))")
def tracking_strip(spark, sf_dir):
    """P02, native."""
    return t(spark, sf_dir, "pages").select("page_id", urls.without_tracking(urls.query(F.col("url"))).alias("kept"))


@query(f"select page_id, s || '://' || h as origin, {SITE} as site_key, {DOMAIN} as domain_key from ({NORMAL})")
def site_keys(spark, sf_dir):
    """P03 to P07."""
    u = F.col("n.url")
    return t(spark, sf_dir, "pages").select("page_id", urls.normalized("url").alias("n")).select("page_id", urls.origin(u).alias("origin"), urls.site_key(u).alias("site_key"), urls.domain_key(u).alias("domain_key"))


@query(f"""
with n as (select page_id, s, h, p || case when k = '' then '' else '?' || k end as rest, case when starts_with(h, 'www.') then substr(h, 5) else 'www.' || h end as o from ({NORMAL})),
a as (select page_id, unnest([s, s, 'https', 'https', 'http', 'http']) as s, unnest([h, o, h, o, h, o]) as h, unnest([1, 2, 3, 4, 5, 6]) as i, rest from n),
f as (select page_id, s || '://' || h || rest as variant, min(i) as i from a group by all)
select page_id, (row_number() over (partition by page_id order by i) - 1)::int as pos, variant from f
""")
def url_variants(spark, sf_dir):
    """P10."""
    return t(spark, sf_dir, "pages").select("page_id", urls.normalized("url").alias("n")).select("page_id", F.posexplode(urls.variants(F.col("n.url"))).alias("pos", "variant"))


def _imported(spark, sf_dir) -> DataFrame:
    """Every page as an input row; each seventh without a website, each eleventh with a scheme that isn't accepted."""
    rows = t(spark, sf_dir, "pages").select(F.col("page_id").alias("row_number"), F.when(F.col("page_id") % 7 == 0, "").when(F.col("page_id") % 11 == 0, F.concat(F.lit("mailto:"), F.col("url"))).otherwise(F.col("url")).alias("website"))
    return tasks.import_rows(rows)


IMPORTED = f"""
  select page_id as row_number, case when page_id % 7 = 0 then '' when page_id % 11 = 0 then 'mailto:' || o.url else o.url end as website,
         case when page_id % 7 = 0 or page_id % 11 = 0 then '' else n.url end as normalized_url,
         case when page_id % 7 = 0 then 'empty website value' when page_id % 11 = 0 then 'unsupported URL scheme: mailto' else '' end as import_error,
         case when page_id % 7 = 0 or page_id % 11 = 0 then '' else {SITE} end as domain_key
  from ({NORMAL}) n join (select page_id, url from pages) o using (page_id)
"""


@query(f"""
select domain_key, min(row_number) as first_row, arg_min(website, row_number) as input_url, arg_min(normalized_url, row_number) as normalized_url, count(*) as input_rows
from ({IMPORTED}) where domain_key <> '' group by domain_key
""")
def task_dedupe(spark, sf_dir):
    """S01, A06, J08."""
    return tasks.unique_tasks(_imported(spark, sf_dir))


@query(f"""
select count(*) as rows, count(*) filter (where import_error <> '') as invalid, count(*) filter (where import_error = '') as valid,
       count(distinct case when domain_key <> '' then domain_key end) as "unique" from ({IMPORTED})
""")
def import_stats(spark, sf_dir):
    """A02, A03, F04."""
    return tasks.import_stats(_imported(spark, sf_dir))


@query(f"select row_number, website, normalized_url as normalized_website, domain_key as domain, case when import_error = '' then 'valid' else 'invalid' end as website_status, import_error as notes from ({IMPORTED})")
def website_report(spark, sf_dir):
    """S14, P61."""
    return export.website_report(_imported(spark, sf_dir))


@query(f"select row_number, case when import_error = '' then normalized_url else '' end as \"Website\", import_error as \"Review Note\" from ({IMPORTED})")
def website_clean(spark, sf_dir):
    """S15, P62."""
    return export.website_clean(export.website_report(_imported(spark, sf_dir)))


@query(f"select count(*) as total, count(*) filter (where import_error = '') as found, count(*) filter (where import_error <> '') as failed from ({IMPORTED})")
def website_counts(spark, sf_dir):
    """A05, F19."""
    return export.website_counts(export.website_report(_imported(spark, sf_dir)))


STATES = ("pending", "running", "completed", "failed")


@query(f"select case when grouping(s) = 1 then 'total' else s end as status, count(*) as n from (select {_sql_pick('o_orderkey', STATES)} as s from orders) group by rollup (s)")
def task_counts(spark, sf_dir):
    """A01, F02."""
    return tasks.counts(t(spark, sf_dir, "orders").select(_pick(F.col("o_orderkey"), STATES).alias("status")))


@query("select o_orderkey as domain_key, o_orderdate as updated_at, (o_orderkey % 5)::int as attempts from orders where o_orderkey % 4 = 0 and o_orderkey % 5 < 3 order by o_orderdate, domain_key limit 100")
def claim_order(spark, sf_dir):
    """The next hundred tasks to work on."""
    own = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("domain_key"), F.col("o_orderdate").alias("updated_at"), (F.col("o_orderkey") % 5).cast("int").alias("attempts"), _pick(F.col("o_orderkey"), STATES).alias("status"))
    return tasks.claimable(own, limit=100).drop("status")


@query("""
with a as (select user_id, event_id, case event_type when 'purchase' then 'ok' when 'signup' then 'partial' when 'logout' then 'failed' else 'error' end as outcome, row_number() over (partition by user_id order by event_id) as n from events),
l as (select user_id, max(n) as attempts, arg_max(outcome, n) as outcome from a group by user_id)
select c_custkey as domain_key, coalesce(attempts, 0)::bigint as attempts,
       case when outcome in ('ok', 'partial') then 'completed' when outcome = 'failed' then 'failed' when outcome = 'error' and attempts >= 3 then 'failed' else 'pending' end as status
from customer left join l on user_id = c_custkey
""")
def task_state(spark, sf_dir):
    """W03 to W06, A-log: the latest attempt of each site decides its state; the log is numbered here, because ``events`` has no attempt numbers."""
    from pyspark.sql import Window

    e = t(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "signup", "partial").when(F.col("event_type") == "logout", "failed").otherwise("error")
    log = e.select(F.col("user_id").alias("domain_key"), F.lit(0).alias("epoch"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("attempt_no"), outcome.alias("outcome"), F.lit("").alias("error"))
    own = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("domain_key"))
    return tasks.state(own, log).select("domain_key", "attempts", "status")


@query("select d.doc_id, d.source, l.quality, l.toxic from documents d left join labels l on d.doc_id % 500 = l.doc_id")
def result_left_join(spark, sf_dir):
    """One site's result fans out to all its input rows, others keep nulls."""
    rows = t(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") % 500).alias("domain_key"))
    results = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("domain_key"), "quality", "toxic")
    return tasks.join_results(rows, results).drop("domain_key")


UNESCAPE = "replace(replace(replace(replace(replace({}, '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query("""
select page_id, regexp_extract(html, '<html lang="([a-z]*)"', 1) as lang, 'AU' as region,
       len(regexp_extract_all(html, '<a href="')) as anchors, (html like '%captcha%' or html like '%access denied%') as blocked
from pages where html is not null
""")
def page_facts(spark, sf_dir):
    """H01, H07, H08."""
    rows = page.parse_pages(t(spark, sf_dir, "pages").where("html is not null"))
    return rows.select("page_id", F.col("parsed.lang").alias("lang"), html.region(F.col("parsed.lang"), "AU").alias("region"), F.size("parsed.anchors").cast("long").alias("anchors"), html.blocked(F.lit(200), F.col("html")).alias("blocked"))


@query(f"""
with a as (select page_id, h, s, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) as x, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 as pos
           from ({NORMAL}) n join (select page_id, html from pages) using (page_id)),
l as (select page_id, s || '://' || h || href as link, min(pos) as pos from a group by all)
select l.page_id, l.pos::int as pos, l.link, a.x as text from l join a on a.page_id = l.page_id and a.pos = l.pos
""")
def page_links(spark, sf_dir):
    """Links within the registered domain, first text wins."""
    rows = t(spark, sf_dir, "pages").select("page_id", urls.normalized("url")["url"].alias("url"), "html")
    found = page.links(page.parse_pages(rows), ["page_id"])
    return found


EMAIL_SQL = r"list_transform(regexp_extract_all(' ' || text || ' ', '(?i)[^\w.+-]([A-Z0-9._%+\-]{1,64}@[A-Z0-9.\-]{1,253}\.[A-Z]{2,24})', 1), lambda x: lower(x))"


@query(f"""
select doc_id, e as email, case when contains(e, 'example.com') then 'blocked_domain' else 'valid' end as verdict, count(*) as n
from (select doc_id, unnest({EMAIL_SQL}) as e from documents) group by all
""")
def email_verdicts(spark, sf_dir):
    """Every address-like string of every document with the rule it breaks."""
    found = t(spark, sf_dir, "documents").select("doc_id", F.explode_outer(email.candidates(F.col("text"))).alias("raw")).where("raw is not null")
    return found.withColumn("email", email.address(F.col("raw"))).groupBy("doc_id", "email").agg(F.count(F.lit(1)).alias("n")).select("doc_id", "email", email.verdict(F.col("email")).alias("verdict"), "n")


# The pattern of numbers with the characters around it in place of looks behind and ahead.
PHONE_SQL = r"(?i)(?:^|[^\p{L}\p{N}_])(" + tables.PHONE_PATTERN.removeprefix(r"(?<!\w)").removesuffix(r"(?!\w)") + r")(?:[^\p{L}\p{N}_]|$)"


@query(rf"""
with c as (select doc_id, unnest(regexp_extract_all(text, '{PHONE_SQL}', 1)) as raw from documents),
d as (select doc_id, trim(raw) as raw, regexp_replace(regexp_replace(raw, '(?i)\s*(?:x|ext\.?|extension)\s*\d{{1,6}}\s*$', ''), '[^0-9]', '', 'g') as d from c),
n as (select doc_id, case when starts_with(raw, '+') then case when starts_with(d, '1') then substr(d, 2) end when length(d) = 11 and starts_with(d, '1') then substr(d, 2) else d end as n from d),
v as (select doc_id, n, case when regexp_full_match(n, '8(?:00|33|44|55|66|77|88)[2-9]\d{{6}}') then 'TOLL_FREE' when regexp_full_match(n, '900[2-9]\d{{6}}') then 'PREMIUM_RATE'
      when regexp_full_match(n, '[2-9][0-8]\d[2-9]\d{{6}}') and substr(n, 2, 2) <> '11' and substr(n, 5, 2) <> '11' then 'FIXED_LINE_OR_MOBILE' end as type from n)
select doc_id, '+1' || n as value, 'US' as region, type, count(*) as n from v where type is not null group by all
""")
def phone_numbers(spark, sf_dir):
    """Every number that the operator's pattern finds in every document, valid ones."""
    found = t(spark, sf_dir, "documents").select("doc_id", F.explode_outer(phone.candidates(F.col("text"))).alias("raw")).where("raw is not null")
    done = found.select("doc_id", phone.normalized("raw", F.lit("US")).alias("p")).where("p.value is not null and p.region = 'US'")
    return done.groupBy("doc_id", "p.value", "p.region", "p.type").agg(F.count(F.lit(1)).alias("n"))


def _customer_pages(spark, sf_dir) -> DataFrame:
    """A page for each customer: a mailto link, a written-out address, structured data, a phone link, profile links, a script and a comment with addresses."""
    k = F.col("c_custkey").cast("string")
    site = F.concat(F.lit("shop"), k, F.lit(".com"))
    ld = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"Shop '), k, F.lit('","email":"desk'), k, F.lit("@"), site, F.lit('","sameAs":["https://www.facebook.com/shop'), k, F.lit('/"]}]}</script>'))
    body = F.concat(
        F.lit('<html lang="en-US"><head><title>Shop '), k, F.lit(" &amp; Sons</title>"), ld,
        F.lit('<script>var x = "js'), k, F.lit('@tracker.org";</script></head><body><p>Reach <a href="MAILTO:Info@'), site, F.lit('?subject=Hi">us</a> or office'), k, F.lit(" [at] "), F.lit("shop"), k, F.lit(" (dot) com"),
        F.lit('</p><p>Call <a href="tel:+1-415-555-'), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit('">now</a></p><!-- old'), k, F.lit('@archive.net --><a href="https://twitter.com/shop'), k, F.lit('/status/1">t</a><a href="https://x.com/shop'), k, F.lit('">x</a><a href="https://www.linkedin.com/company/shop'), k, F.lit('/about">in</a><a href="/contact">Contact</a></body></html>'),
    )
    return _dealt(t(spark, sf_dir, "customer")).select("c_custkey", F.concat(F.lit("https://"), site, F.lit("/")).alias("url"), body.alias("html"))


@query("""
with c as (select c_custkey, c_custkey::varchar as k, 'shop' || c_custkey || '.com' as d from customer),
e as (
  select c_custkey, 'email' as kind, 'info@' || d as value, 'mailto' as source_type, 0.99::double as confidence, 'generic' as category from c
  union all select c_custkey, 'email', 'desk' || k || '@' || d, 'json_ld', 0.98, 'named' from c
  union all select c_custkey, 'email', 'office' || k || '@' || d, 'obfuscated', 0.88, 'generic' from c
  union all select c_custkey, 'email', 'js' || k || '@tracker.org', 'html', 0.72, 'external_domain' from c
  union all select c_custkey, 'email', 'old' || k || '@archive.net', 'html', 0.72, 'external_domain' from c
  union all select c_custkey, 'phone', '+1415555' || lpad((c_custkey % 10000)::varchar, 4, '0'), 'tel', 0.99, '' from c
  union all select c_custkey, 'social', 'https://facebook.com/shop' || k, 'json_ld', 0.98, 'facebook' from c
  union all select c_custkey, 'social', 'https://x.com/shop' || k, 'anchor', 0.94, 'twitter' from c
  union all select c_custkey, 'social', 'https://linkedin.com/company/shop' || k, 'anchor', 0.94, 'linkedin' from c
) select c_custkey, kind, value, source_type, round(confidence, 4) as confidence, category from e
""")
def page_evidence(spark, sf_dir):
    """Evidence of a generated page of each customer."""
    rows = page.evidence(page.parse_pages(_customer_pages(spark, sf_dir)), ["c_custkey"], kinds=("email", "phone", "social"))
    return merge.merge_page(rows, ["c_custkey"]).select("c_custkey", "kind", "value", "source_type", F.round("confidence", 4).alias("confidence"), "category")


PROFILES = (
    ("https://www.linkedin.com/company/acme/about", "https://linkedin.com/company/acme"),
    ("https://linkedin.com/feed", None),
    ("https://x.com/acme/status/12345", None),
    ("https://mobile.twitter.com/acme", "https://x.com/acme"),
    ("https://www.youtube.com/@acme/videos", "https://youtube.com/@acme"),
    ("https://youtube.com/watch", None),
    ("https://youtube.com/channel/UC1/about", "https://youtube.com/channel/UC1"),
    ("https://facebook.com//acme//", "https://facebook.com/acme"),
    ("https://facebook.com/groups/12", None),
    ("https://facebook.com/pages/acme/77/x", "https://facebook.com/pages/acme/77"),
    ("https://facebook.com/sharer/sharer.php", None),
    ("https://instagram.com/p/abc", None),
    ("https://instagram.com/acme/", "https://instagram.com/acme"),
    ("https://tiktok.com/acme", None),
    ("https://www.tiktok.com/@acme", "https://tiktok.com/@acme"),
    ("https://threads.net/explore", None),
    ("https://pinterest.com/acme/board", "https://pinterest.com/acme"),
    ("https://example.org/acme", None),
)


@query(f"select s_suppkey, replace({_sql_pick('s_suppkey', [b or '' for _, b in PROFILES])}, 'acme', 'acme' || s_suppkey) as profile from supplier")
def social_profiles(spark, sf_dir):
    """Canonical profile of a generated link of each supplier."""
    own = F.replace(_pick(F.col("s_suppkey"), [a for a, _ in PROFILES]), F.lit("acme"), F.concat(F.lit("acme"), F.col("s_suppkey").cast("string")))
    rows = t(spark, sf_dir, "supplier").select("s_suppkey", own.alias("u"))
    return rows.select("s_suppkey", F.coalesce(social.canonical(F.col("u"), social.platform(F.col("u"))), F.lit("")).alias("profile"))


SOURCES = ("mailto", "json_ld", "visible_text", "html", "obfuscated")
CATEGORIES = ("generic", "named", "external_domain", "free_mail")


def _order_evidence(spark, sf_dir) -> DataFrame:
    """E-mail evidence of the orders' parts: a site per order, a page per line."""
    c = F.col
    value = F.concat(F.when(c("l_linenumber") % 2 == 0, F.lit("Part")).otherwise(F.lit("part")), (c("l_partkey") % 50).cast("string"), F.lit("@site.example"))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", c("l_linenumber").cast("int").alias("page_ordinal"), c("l_suppkey").cast("int").alias("pass_ordinal"), c("l_partkey").cast("int").alias("match_ordinal"), value.alias("value"), F.lit("email").alias("kind"), F.lit("https://site.example/").alias("source_url"), _pick(c("l_suppkey"), SOURCES).alias("source_type"), ((c("l_quantity").cast("int") % 4) * 0.05 + 0.8).alias("confidence"), _pick(c("l_partkey"), CATEGORIES).alias("category"), F.lit("").alias("raw_value"), F.lit(None).cast("map<string,string>").alias("meta"))


ORDER_EVIDENCE = f"""
  select l_orderkey, l_linenumber::int as page_ordinal, l_suppkey::int as pass_ordinal, l_partkey::int as match_ordinal, case when l_linenumber % 2 = 0 then 'Part' else 'part' end || (l_partkey % 50) || '@site.example' as value,
         {_sql_pick('l_suppkey', SOURCES)} as source_type, ((l_quantity::int % 4) * 0.05::double + 0.8::double) as confidence, {_sql_pick('l_partkey', CATEGORIES)} as category
  from lineitem
"""
MERGED = f"""
  select l_orderkey, value, source_type, confidence, category from (
    select *, row_number() over (partition by l_orderkey, lower(value) order by confidence desc, page_ordinal, pass_ordinal, match_ordinal) as r from ({ORDER_EVIDENCE})) where r = 1
"""


@query(f"select l_orderkey, value, source_type, round(confidence, 4) as confidence, category from ({MERGED})")
def merge_contacts(spark, sf_dir):
    """Most confident evidence of each value over all pages of a site, first of equals."""
    return merge.merge(_order_evidence(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", "value", "source_type", F.round("confidence", 4).alias("confidence"), "category")


@query(f"select l_orderkey, string_agg(value, '; ' order by category, confidence desc, value) as emails, arg_min(value, (category, -confidence, value)) as primary_email from ({MERGED}) group by l_orderkey")
def wide_pivot(spark, sf_dir):
    """Contact order and the wide e-mail columns."""
    lists = merge.contacts(merge.merge(_order_evidence(spark, sf_dir), ["l_orderkey"]), ["l_orderkey"])
    w = merge.wide(F.col("contacts"))
    return lists.select("l_orderkey", w["emails"].alias("emails"), w["primary_email"].alias("primary_email"))


def _case(key: str, values: dict) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then {v}::double" for k, v in values.items()) + " else 0.0::double end"


@query(f"""
select l_orderkey, arg_min(value, (-s, value)) as primary_email from (
  select *, confidence * 0.52::double + {_case('category', tables.EMAIL_CATEGORY_WEIGHTS['business'])} + {_case('source_type', tables.EMAIL_SOURCE_WEIGHTS)} as s from ({MERGED})) group by l_orderkey
""")
def primary_email(spark, sf_dir):
    """Best e-mail of the clean export."""
    lists = merge.contacts(merge.merge(_order_evidence(spark, sf_dir), ["l_orderkey"]), ["l_orderkey"])
    return lists.select("l_orderkey", merge.primary_email(F.col("contacts"))["value"].alias("primary_email"))


LINKS = ("/contact", "/about-us", "/blog/contact", "/a/b/contact", "/products", "/support", "/company/team", "/news", "/help/", "/privacy", "/our-story", "/x/y/z")


def _rank_input(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Real links of every page, each with a path out of LINKS behind its own, and the sites."""
    rows = t(spark, sf_dir, "pages").select("page_id", urls.normalized("url")["url"].alias("url"), "html")
    real = page.links(page.parse_pages(rows), ["page_id"]).join(rows.select("page_id", "url"), "page_id")
    path = _pick(F.col("page_id") + F.col("pos"), LINKS)
    found = real.select(urls.site_key(F.col("url")).alias("site_key"), F.concat(urls.origin(F.col("url")), path).alias("link"), F.lit("").alias("text"))
    sites = rows.groupBy(urls.site_key(F.col("url")).alias("site_key")).agg(F.min(urls.origin(F.col("url"))).alias("base_url"))
    return found, sites


def _rank_cases() -> str:
    words = rank.weights(())
    best = "greatest(" + ", ".join(f"case when contains(hay, '{w}') then {n} else 0 end" for w, n in words.items()) + ")"
    minus = " + ".join(f"case when contains(hay, '{w}') then 80 else 0 end" for w in tables.RANK_NEGATIVE)
    return f"{best} - ({minus}) - 3 * len(list_filter(string_split(path, '/'), lambda x: x <> ''))"


RANK_LINKS = f"""
  select h, s, {_sql_pick('page_id + pos', LINKS)} as path from (
    select page_id, h, s, min(pos) as pos from (
      select page_id, h, s, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 as pos
      from ({NORMAL}) n join (select page_id, html from pages) using (page_id)) group by page_id, h, s, href)
"""
RANKED = f"""
  with sites as (select {SITE} as site_key, min(s || '://' || h) as base from ({NORMAL}) group by 1),
  cand as (
    select {SITE} as site_key, s || '://' || h || path as url, score from (select *, {_rank_cases()} as score from (select *, path || ' ' as hay from ({RANK_LINKS}))) where score > 0
    union all select site_key, base || g.p, g.n from sites, (values {", ".join(f"('{p}', {n})" for p, n in rank.guesses(()).items())}) g(p, n)),
  best as (select site_key, url, max(score)::int as score from cand group by all)
  select site_key, (row_number() over (partition by site_key order by score desc, url))::int as rank, url, score from best
"""


@query(f"select * from ({RANKED}) where rank <= 10")
def rank_subpages(spark, sf_dir):
    """Ten best sub-pages of each site."""
    found, sites = _rank_input(spark, sf_dir)
    return rank.rank_subpages(found, sites, ["site_key"], limit=10)


@query(f"""
with r as (select site_key, string_agg(url, ' ' order by rank) as subpages from ({RANKED}) where rank <= 3 group by site_key),
i as (select page_id, {SITE} as site_key, n.url from ({NORMAL}) n), f as (select site_key, min(page_id) as first_page, count(*) as pages from i group by site_key)
select page_id, i.url, i.site_key, first_page, pages, subpages from i join f using (site_key) join r using (site_key)
""")
def site_overview(spark, sf_dir):
    """The flagship: normal URL, site, task, three best sub-pages of the site, for every page."""
    found, sites = _rank_input(spark, sf_dir)
    best = rank.rank_subpages(found, sites, ["site_key"], limit=3).groupBy("site_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]), " ").alias("subpages"))
    rows = tasks.import_rows(t(spark, sf_dir, "pages").select("page_id", F.col("url").alias("website"))).select("page_id", F.col("normalized_url").alias("url"), F.col("domain_key").alias("site_key"))
    own = rows.groupBy("site_key").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("pages"))
    return rows.join(own.join(best, "site_key"), "site_key").select("page_id", "url", "site_key", "first_page", "pages", "subpages")


def _store(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A site for each customer: a home page that leads to /info, which holds the address; every third has it on /contact."""
    k = F.col("c_custkey").cast("string")
    home = F.concat(F.lit("https://firm"), k, F.lit(".com/"))
    pages_ = F.array(
        F.struct(home.alias("url"), F.lit('<html><a href="/info-contact">Contact info</a><p>Welcome</p></html>').alias("html")),
        F.struct(F.concat(home, F.lit("info-contact")).alias("url"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("<p>office"), k, F.lit("@firm.org</p>"))).otherwise("<p>none</p>").alias("html")),
        F.struct(F.concat(home, F.lit("contact")).alias("url"), F.concat(F.lit("<p>desk"), k, F.lit("@firm.org</p>")).alias("html")),
    )
    c = _dealt(t(spark, sf_dir, "customer"))
    return c.select(home.alias("url")), c.select(F.explode(pages_).alias("p")).select("p.*")


@query("""
with c as (select c_custkey as k, 'firm' || c_custkey || '.com' as site_key, 'https://firm' || c_custkey || '.com/' as home from customer)
select site_key, 0 as ordinal, home as url, 'ok' as status, '' as found from c
union all select site_key, 1, home || 'info-contact', 'ok', case when k % 3 <> 0 then 'email' else '' end from c
union all select site_key, 2, home || 'contact', 'ok', 'email' from c where k % 3 = 0
""")
def crawl_fast(spark, sf_dir):
    """Pages that a fast crawl for e-mails visits."""
    sites, store = _store(spark, sf_dir)
    return crawl.crawl(sites, store, wanted=("email",), max_pages=6).select("site_key", "ordinal", "url", "status", "found")


@query("""
with c as (select c_custkey as k, 'firm' || c_custkey || '.com' as site_key, 'https://firm' || c_custkey || '.com/' as home from customer)
select site_key, 0 as ordinal, home as url, 'ok' as status, '' as found from c
union all select site_key, 1, home || 'info-contact', 'ok', case when k % 3 <> 0 then 'email' else '' end from c
union all select site_key, 2, home || 'contact', 'ok', 'email' from c
union all select site_key, 3, home || 'contact-us', 'failed', '' from c
""")
def crawl_full(spark, sf_dir):
    """W01 in full mode: batches until the budget of four pages is used, failed fetches included."""
    sites, store = _store(spark, sf_dir)
    return crawl.crawl(sites, store, wanted=("email",), max_pages=4, fast=False).select("site_key", "ordinal", "url", "status", "found")


def _companies(spark, sf_dir) -> DataFrame:
    n = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = _dealt(t(spark, sf_dir, "customer")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.replace(F.initcap("c_mktsegment"), F.lit(" "), F.lit("")), F.lit(" Works "), F.col("c_custkey").cast("string"), _pick(F.col("c_custkey"), (" Ltd", " GmbH", "", " Services Inc")))
    return c.select(F.col("c_custkey").alias("company_id"), name.alias("company"), F.concat_ws(" ", "n_name", "r_name").alias("location"))


SEGMENT = "upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))"
COMPANIES = f"""
  select c_custkey as company_id, replace({SEGMENT}, ' ', '') || ' Works ' || c_custkey || {_sql_pick('c_custkey', (' Ltd', ' GmbH', '', ' Services Inc'))} as company, n_name || ' ' || r_name as location
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
"""
TOKENS = f"list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda x: len(x) > 1 and x not in ({_in(tables.LEGAL_SUFFIXES)}))"


@query(f"select company_id, array_to_string({TOKENS.format('company')}, ' ') as signature, '\"' || company || '\" ' || location || ' \"official website\" {' '.join('-site:' + h for h in tables.SEARCH_EXCLUDED)}' as query from ({COMPANIES})")
def company_signatures(spark, sf_dir):
    """P34, P35, P39."""
    return _companies(spark, sf_dir).select("company_id", text.signature(F.col("company")).alias("signature"), text.search_query(F.col("company"), F.col("location")).alias("query"))


GUESS_SUFFIX = "case " + " ".join(f"when contains(' ' || lower(location) || ' ', ' {p} ') then {list(dict.fromkeys([*own, *tables.GUESS_SUFFIXES]))[:7]}" for p, own in tables.PLACE_SUFFIXES.items()) + f" else {list(tables.GUESS_SUFFIXES)} end"


@query(f"""
with b as (select company_id, array_to_string({TOKENS.format('company')}, '') as a, array_to_string({TOKENS.format('company')}, '-') as d, {GUESS_SUFFIX} as suffixes from ({COMPANIES})),
c as (select company_id, unnest(case when a = d then [a] else [a, d] end) as base, suffixes from b where a <> '')
select company_id, 'https://' || base || '.' || unnest(suffixes) || '/' as url from c
""")
def domain_guesses(spark, sf_dir):
    """R10."""
    return resolve.domain_guesses(_companies(spark, sf_dir)).select("company_id", "url")


def _share(a: str, b: str) -> str:
    return f"case when len({a}) = 0 or len({b}) = 0 then 0.0::double else len(list_intersect(list_distinct({a}), list_distinct({b})))::double / len(list_distinct({a})) end"


@query(f"""
select company_id, round({_share(TOKENS.format('location'), TOKENS.format("company || ' offices in ' || location"))}, 6) as location_score,
       round({_share(TOKENS.format('location'), TOKENS.format('company'))}, 6) as name_only from ({COMPANIES})
""")
def location_scores(spark, sf_dir):
    """P38."""
    c, place = F.col("company"), F.col("location")
    return _companies(spark, sf_dir).select("company_id", F.round(resolve.location_score(place, F.concat(c, F.lit(" offices in "), place)), 6).alias("location_score"), F.round(resolve.location_score(place, c), 6).alias("name_only"))


PROVIDERS = (("clearbit", 0.15, "https://www.{}.com/about"), ("wikidata", 0.30, "http://{}.com"), ("brave", 0.17, "https://shop.{}.com/"), ("serpapi", 0.19, "https://{}.org/"), ("duckduckgo", 0.08, "https://www.facebook.com/{}"))


def _candidates(spark, sf_dir) -> DataFrame:
    """What five providers say of each company: three of one domain, one of another, a directory."""
    slug = F.concat(F.lit("works"), F.col("company_id").cast("string"))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("source"), F.lit(i).alias("source_order"), F.lit(s).alias("source_score"), F.replace(F.lit(u), F.lit("{}"), slug).alias("url")) for i, (n, s, u) in enumerate(PROVIDERS)]))
    out = _companies(spark, sf_dir).select("*", rows.alias("p")).select("company_id", "company", "location", "p.*", F.col("company").alias("title"), F.lit("").alias("snippet"))
    return resolve.provider_candidates(out)


@query("""
select c_custkey as company_id, 'works' || c_custkey || '.com' as domain, 'http://works' || c_custkey || '.com/' as url, 'wikidata' as source, 0.38::double as source_score, 3::bigint as source_count from customer
union all select c_custkey, 'works' || c_custkey || '.org', 'https://works' || c_custkey || '.org/', 'serpapi', 0.19, 1 from customer
""")
def candidate_merge(spark, sf_dir):
    """One candidate per domain, agreement counted, directories dropped."""
    return resolve.merge_candidates(_candidates(spark, sf_dir)).select("company_id", "domain", "url", "source", F.round("source_score", 6).alias("source_score"), "source_count")


@query("""
select c_custkey as company_id, case when c_custkey % 2 = 0 then 'http://works' || c_custkey || '.com/' else '' end as website, case when c_custkey % 2 = 0 then 'found' else 'review' end as status, 'wikidata' as source, 2 as n_candidates from customer
""")
def best_match(spark, sf_dir):
    """Every second company's page could be read and carries its name."""
    companies = _companies(spark, sf_dir)
    top = resolve.top_candidates(resolve.merge_candidates(_candidates(spark, sf_dir)))
    even = F.col("company_id") % 2 == 0
    none = F.array().cast("array<string>")
    pages_ = top.withColumns({"final_url": F.when(even, F.col("url")).otherwise(""), "page_title": F.when(even, F.col("company")).otherwise(""), "description": F.lit(""), "text_sample": F.when(even, F.concat(F.col("company"), F.lit(" "), F.col("location"))).otherwise(""), "ok": even, "parked": F.lit(False), "structured_names": none, "structured_urls": none, "structured_same_as": none, "structured_country": F.lit(""), "title": F.when(even, F.col("title")).otherwise("")})
    found = resolve.matches(companies, resolve.score(pages_))
    return found.select("company_id", "website", "status", "source", F.size("candidates").alias("n_candidates"))


def _hits(spark, sf_dir) -> DataFrame:
    """Raw hits of every provider for each company: nine positions, the company's name or none as title."""
    names = F.explode(F.array(*[F.lit(n) for n in tables.PROVIDERS]))
    rows = _companies(spark, sf_dir).select("*", names.alias("provider")).select("*", F.posexplode(F.array(*[F.lit(i) for i in range(9)])).alias("position", "p"))
    url = F.concat(F.lit("hit"), F.col("company_id").cast("string"), F.lit("-"), F.col("position").cast("string"), F.lit(".com"))
    return rows.select("company_id", "company", "location", "provider", "position", url.alias("url"), F.when(F.col("position") % 2 == 0, F.col("company")).otherwise("").alias("title"), F.lit("").alias("snippet"))


@query(f"""
with p(provider, place, base, alike, step, least, most) as (values {", ".join(f"('{n}', {i}, {p.base}, {p.alike}, {p.step}, {p.least}, {p.most})" for i, (n, p) in enumerate(tables.PROVIDERS.items()))}),
h as (select c_custkey as company_id, provider, place, base, alike, step, least, most, unnest(range(9)) as position from customer cross join p)
select company_id, provider as source, (place * 100 + position)::int as source_order, 'https://hit' || company_id || '-' || position || '.com/' as url,
       round(greatest(least, base - step * position) + case when position % 2 = 0 then alike else 0 end, 6)::double as source_score from h where position < most
""")
def provider_scores(spark, sf_dir):
    """Scores of the hits that each provider's rule reads."""
    scored = resolve.scored_hits(_hits(spark, sf_dir))
    return scored.select("company_id", "source", "source_order", "url", F.round("source_score", 6).alias("source_score"))


ANSWER_BODIES = {
    "clearbit": '[{"name":"N","domain":"#0.com","logo":null},{"name":null,"domain":"#1.com"}]',
    "wikidata": '{"entities":{"Q1":{"labels":{"en":{"value":"N"}},"descriptions":{"en":{"value":"d"}},"claims":{"P856":[{"mainsnak":{"datavalue":{"value":"https://#0.com/"}}},{"mainsnak":{"datavalue":{"value":"https://#1.com/"}}}],"P31":[]}},"Q2":{"labels":{},"claims":{}}}}',
    "duckduckgo": '{"AbstractURL":"https://#0.com/","Heading":"N","AbstractText":"d","Results":[{"FirstURL":"https://#1.com/","Text":"x"}]}',
    "google_cse": '{"items":[{"link":"https://#0.com/","title":"N","snippet":"d"},{"link":""},{"link":"https://#2.com/"}]}',
    "brave": '{"web":{"results":[{"url":"https://#0.com/","title":"N","description":"d"}]}}',
    "serpapi": "no json",
    "searchapi": '{"organic_results":[{"link":"https://#0.com/","title":"N","snippet":"d"}]}',
    "searxng": '{"results":[{"url":"https://#0.com/","title":"N","content":"d"}]}',
}
# provider, position, title, snippet of each hit in these bodies
ANSWER_HITS = (("clearbit", 0, "N", ""), ("clearbit", 1, "", ""), ("wikidata", 0, "N", "d"), ("wikidata", 1, "N", "d"), ("duckduckgo", 0, "N", "d"), ("duckduckgo", 1, "x", ""), ("google_cse", 0, "N", "d"), ("google_cse", 2, "", ""), ("brave", 0, "N", "d"), ("searchapi", 0, "N", "d"), ("searxng", 0, "N", "d"))


@query(f"""
select c_custkey as company_id, provider, position, case when provider = 'clearbit' then '' else 'https://' end || 'h' || c_custkey || '-' || position || '.com' || case when provider = 'clearbit' then '' else '/' end as url, title, snippet
from customer cross join (values {", ".join(str(h) for h in ANSWER_HITS)}) h(provider, position, title, snippet)
""")
def provider_answers(spark, sf_dir):
    """Hits out of the JSON answers of eight providers, one of which is no JSON."""
    bodies = F.array(*[F.struct(F.lit(k).alias("provider"), F.lit(v).alias("b")) for k, v in ANSWER_BODIES.items()])
    rows = _companies(spark, sf_dir).select("*", F.explode(bodies).alias("x")).select("company_id", "company", "location", "x.provider", F.replace("x.b", F.lit("#"), F.concat(F.lit("h"), F.col("company_id").cast("string"), F.lit("-"))).alias("body"))
    return resolve.hits_of_json(rows).select("company_id", "provider", "position", "url", "title", "snippet")


def _makers(spark, sf_dir) -> DataFrame:
    """A company for each customer, under a name that no other has."""
    return _companies(spark, sf_dir).withColumn("company", F.concat(F.regexp_extract("company", r"^\S+", 0), F.lit(" Makers "), (F.col("company_id") + 1000).cast("string")))


def _guess_pages(spark, sf_dir) -> DataFrame:
    """A page under the first guess of every second company that says its name; every third of these is parked."""
    c = _dealt(_makers(spark, sf_dir))
    url = F.concat(F.lit("https://"), F.array_join(text.tokens(F.col("company")), ""), F.lit(".com/"))
    body = F.when(F.col("company_id") % 3 == 0, F.lit("<p>Buy this domain today</p>")).otherwise(F.concat(F.lit("<p>We make things in "), F.col("location"), F.lit("</p>")))
    return c.where("company_id % 2 = 0").select(url.alias("url"), F.concat(F.lit("<html><title>"), F.col("company"), F.lit("</title>"), body).alias("html"), F.lit(200).alias("status"))


@query(f"""
with c as (select c_custkey as company_id, lower(replace({SEGMENT}, ' ', '')) || 'makers' || (c_custkey + 1000) as base, c_custkey % 2 = 0 as page, c_custkey % 6 = 0 as parked from customer)
select company_id, 'https://' || base || case when parked then '.net/' else '.com/' end as top_url, case when page and not parked then 'found' else 'review' end as status,
       case when page and not parked then 'https://' || base || '.com/' else '' end as website, 5 as n_candidates from c
""")
def company_resolve(spark, sf_dir):
    """Guessed domains, their stored pages, one match for each company; a parked page ranks behind a guess without a page."""
    found = resolve.resolve(_makers(spark, sf_dir), _guess_pages(spark, sf_dir))
    return found.select("company_id", F.col("candidates")[0]["url"].alias("top_url"), "status", "website", F.size("candidates").alias("n_candidates"))


@query(f"""
with c as (select *, {_sql_pick('company_id', ('found', 'review', 'not_found'))} as st from ({COMPANIES}))
select company_id, case when st = 'found' then 'https://w' || company_id || '.com/' else 'https://old.com/' end as "Website", st as website_finder_status,
       case st when 'found' then '0.75' when 'review' then '0.50' else '' end as website_confidence,
       case when st = 'not_found' then '' else 'https://w' || company_id || '.com/ (0.75, brave) - W | https://x.com/ (0.5, serpapi)' end as website_top_candidates from c
""")
def finder_columns(spark, sf_dir):
    """The finder's columns beside an input row."""
    c = _companies(spark, sf_dir).withColumn("status", _pick(F.col("company_id"), ("found", "review", "not_found")))
    own = F.concat(F.lit("https://w"), F.col("company_id").cast("string"), F.lit(".com/"))
    one = lambda url, source, score, title: F.struct(url.alias("url"), F.lit(source).alias("source"), F.lit(score).alias("score"), F.lit("").alias("reason"), F.lit(title).alias("title"))
    two = F.array(one(own, "brave", 0.75, "W"), one(F.lit("https://x.com/"), "serpapi", 0.5, ""))
    m = c.select("company_id", F.when(F.col("status") == "found", own).otherwise("").alias("website"), "status", F.when(F.col("status") == "found", 0.75).when(F.col("status") == "review", 0.5).otherwise(0.0).alias("confidence"), F.lit("brave").alias("source"), F.lit("").alias("reason"), F.when(F.col("status") == "not_found", F.slice(two, 1, 0)).otherwise(two).alias("candidates"))
    done = resolve.add_finder_columns(c.select("company_id", F.lit("https://old.com/").alias("Website")), m)
    return done.select("company_id", "Website", "website_finder_status", "website_confidence", "website_top_candidates")


@query("""
with e as (select c_custkey as k, unnest([1, 2, 3]) as i from customer),
v as (select k, case i when 1 then 'info@a' || k || '.com' when 2 then 'sales@b' || k || '.com' else 'x' || k || '@gmail.com' end as value,
             case i when 1 then 0.98 when 2 then 0.88 else 0.99 end * 0.52 + case i when 3 then 0.02 else 0.34 end + case i when 1 then 0.16 when 2 then 0.08 else 0.16 end + case when i = 1 and k % 2 = 0 then -0.20 else 0.06 end as s from e)
select k as c_custkey, arg_min(value, (-round(s, 9), value)) as email from v group by k
""")
def mail_hosts(spark, sf_dir):
    """The best address of each site when every second site's own mail host has no exchanger."""
    k = F.col("c_custkey").cast("string")
    one = lambda value, category, source, confidence: F.struct(value.alias("value"), F.lit("email").alias("kind"), F.lit("").alias("source_url"), F.lit(source).alias("source_type"), F.lit(confidence).alias("confidence"), F.lit(category).alias("category"), F.lit("").alias("raw_value"), F.lit(None).cast("map<string,string>").alias("meta"))
    every = F.array(one(F.concat(F.lit("info@a"), k, F.lit(".com")), "generic", "mailto", 0.98), one(F.concat(F.lit("sales@b"), k, F.lit(".com")), "generic", "visible_text", 0.88), one(F.concat(F.lit("x"), k, F.lit("@gmail.com")), "free_mail", "mailto", 0.99))
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.explode(every).alias("c")).select("c_custkey", "c.*")
    hosts = t(spark, sf_dir, "customer").select(F.explode(F.array(F.struct(F.concat(F.lit("a"), k, F.lit(".com")).alias("host"), (F.col("c_custkey") % 2 == 1).alias("has_mail")), F.struct(F.concat(F.lit("b"), k, F.lit(".com")).alias("host"), F.lit(True).alias("has_mail")))).alias("h")).select("h.*")
    hosts = hosts.unionByName(spark.createDataFrame([("gmail.com", True)], "host string, has_mail boolean"))
    return merge.primary_emails(rows, ["c_custkey"], hosts=hosts).select("c_custkey", F.col("email.value").alias("email"))


def _joined(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Input rows, one for each order, with the result of the customer's site; some invalid, some without a result, some failed."""
    c = F.col
    header = ["Company", "Website", "website_finder_status"]
    orders = t(spark, sf_dir, "orders")
    site = F.concat(F.lit("cust"), c("o_custkey").cast("string"), F.lit(".com"))
    bad = c("o_orderkey") % 13 == 0
    original = F.map_from_arrays(F.array(*[F.lit(h) for h in header]), F.array(F.concat(F.lit("Cust "), c("o_custkey").cast("string")), F.when(bad, "").otherwise(site), F.when(c("o_orderkey") % 17 == 0, "review").otherwise("found")))
    rows = orders.select(c("o_orderkey").alias("row_number"), original.alias("original"), F.when(bad, "").otherwise(site).alias("website"), F.when(bad, "").otherwise(F.concat(F.lit("https://"), site, F.lit("/"))).alias("normalized_url"), F.when(bad, "").otherwise(site).alias("domain_key"), F.when(bad, "empty website value").otherwise("").alias("import_error"))
    k = c("c_custkey").cast("string")
    struct = lambda kind, category, value, source, conf: F.struct(value.alias("value"), F.lit(kind).alias("kind"), F.concat(F.lit("https://cust"), k, F.lit(".com/")).alias("source_url"), F.lit(source).alias("source_type"), F.lit(conf).alias("confidence"), F.lit(category).alias("category"), F.lit("").alias("raw_value"), F.lit(None).cast("map<string,string>").alias("meta"))
    contacts = F.array(struct("email", "generic", F.concat(F.lit("info@cust"), k, F.lit(".com")), "mailto", 0.98), struct("email", "named", F.concat(F.lit("ann@cust"), k, F.lit(".com")), "visible_text", 0.9), struct("phone", "", F.concat(F.lit("+1415555"), F.lpad((c("c_custkey") % 10000).cast("string"), 4, "0")), "tel", 0.99), struct("social", "facebook", F.concat(F.lit("https://facebook.com/cust"), k), "anchor", 0.94))
    results = t(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.concat(F.lit("cust"), k, F.lit(".com")).alias("domain_key"), F.when(c("c_custkey") % 4 == 0, "failed").otherwise("ok").alias("result_status"), F.concat(F.lit("https://cust"), k, F.lit(".com/")).alias("final_url"), F.concat(F.lit("cust"), k, F.lit(".com")).alias("domain"), F.when(c("c_custkey") % 4 == 0, F.array().cast(export.NO_CONTACTS)).otherwise(contacts).alias("contacts"), F.lit("").alias("address"), c("c_mktsegment").alias("description"), F.when(c("c_custkey") % 4 == 0, F.array(F.lit("blocked"))).otherwise(F.array().cast("array<string>")).alias("errors"), F.lit(200).alias("http_status"), F.lit("direct").alias("fetch_tier"))
    state = {"task_status": F.when(F.col("result_status").isNull(), "pending").when(F.col("result_status") == "failed", "failed").otherwise("completed"), "last_error": F.lit(""), "task_attempts": F.lit(1)}
    return tasks.join_results(rows, results).withColumns(state), header


JOINED = """
  select o_orderkey as row_number, o_custkey as k, o_orderkey % 13 = 0 as bad, o_orderkey % 17 = 0 as unsure, not (o_orderkey % 13 = 0) and c_custkey is not null as has, coalesce(o_custkey % 4 = 0, false) as failed, 'cust' || o_custkey || '.com' as site, c_mktsegment as segment,
         '+1415555' || lpad((o_custkey % 10000)::varchar, 4, '0') as tel, lpad((o_custkey % 10000)::varchar, 4, '0') as last4
  from orders left join (select * from customer where c_custkey % 5 <> 0) on c_custkey = o_custkey
"""


@query(f"""
select row_number as input_row, site as input_website, site as domain, data_type, label, case when data_type = 'email' and label = 'generic' then 'info@' || site when data_type = 'email' then 'ann@' || site when data_type = 'phone' then tel else 'https://facebook.com/cust' || k end as value, confidence, found_via, 'https://' || site || '/' as page_url, '' as original_text, pos
from ({JOINED}), (values ('email', 'generic', '0.98', 'mailto', 0), ('email', 'named', '0.90', 'visible_text', 1), ('phone', '', '0.99', 'tel', 2), ('social', 'facebook', '0.94', 'anchor', 3)) v(data_type, label, confidence, found_via, pos)
where has and not failed
""")
def export_long(spark, sf_dir):
    """S11, J01, P46."""
    return export.long(_joined(spark, sf_dir)[0])


NOTES = """array_to_string(list_filter([case when unsure then 'Website finder status: review' else '' end, case when bad then 'empty website value' else '' end, case when has and failed then 'blocked' else '' end], lambda x: x <> ''), '; ')"""
STATUS = "case when has and failed then 'failed' when has then 'ok' when unsure then 'needs_review' when bad then 'invalid_input' else 'pending' end"


@query(f"""
select row_number, 'Cust ' || k as "Company", case when bad then '' else site end as "Website", case when unsure then 'review' else 'found' end as website_finder_status, '' as website_confidence, '' as website_source, '' as website_top_candidates,
       {STATUS} as scrape_status, case when has and not failed then 'info@' || site else '' end as primary_email, case when has and not failed then 'info@' || site || '; ann@' || site else '' end as emails,
       case when has and not failed then tel else '' end as primary_phone, case when has and not failed then tel else '' end as phones,
       case when has and not failed then 'https://facebook.com/cust' || k else '' end as facebook, '' as instagram, '' as linkedin, '' as twitter_x, '' as youtube, '' as tiktok, '' as pinterest, '' as threads, case when has and not failed then 'https://facebook.com/cust' || k else '' end as social_profiles,
       '' as address, case when has then segment else '' end as company_description, case when has then 'https://' || site || '/' else '' end as final_url, case when bad then '' else site end as domain,
       case when {NOTES} = '' and not has then 'No result available' else {NOTES} end as notes
from ({JOINED})
""")
def export_wide(spark, sf_dir):
    """S10, P50, P52 to P56."""
    joined, header = _joined(spark, sf_dir)
    return export.wide(joined, header)


@query(f"""
select row_number, 'Cust ' || k as "Company", case when bad then '' else site end as "Website", case when unsure then 'review' else 'found' end as website_finder_status, '' as website_confidence, '' as website_source, '' as website_top_candidates,
       {STATUS} as scrape_status, case when has then 'https://' || site || '/' else '' end as final_url, case when bad then '' else site end as domain, case when has then '200' else '' end as http_status, case when has then 'direct' else '' end as fetch_tier, '1' as task_attempts,
       case when {NOTES} = '' and not has then 'No result available' else {NOTES} end as notes
from ({JOINED}) where bad or unsure or not has or failed
""")
def export_review(spark, sf_dir):
    """S12, F20, P51."""
    joined, header = _joined(spark, sf_dir)
    return export.review(joined, header)


@query(f"""
with v as (select *, has and not failed as yes from ({JOINED}))
select row_number, case when bad then '' when has then 'https://' || site || '/' else site end as "Website", case when yes then 'info@' || site else '' end as "Email", case when yes then '(415) 555-' || last4 else '' end as "Phone", case when yes then 'https://facebook.com/cust' || k else '' end as "Facebook", case when has then segment else '' end as "Description",
       case when yes then 'mailto' else '' end as "Email Source", case when yes then '0.98' else '' end as "Email Confidence", case when yes then 'US' else '' end as "Phone Region", case when yes then 'Fixed Line Or Mobile' else '' end as "Phone Type", case when yes then 'tel' else '' end as "Phone Source", case when yes then '0.99' else '' end as "Phone Confidence",
       array_to_string(list_filter([case when bad then 'Website missing' else '' end, case when yes then '' else 'Email missing' end, case when yes then '' when has then 'Phone missing or outside selected geography' else 'Phone missing' end, case when yes then '' else 'Facebook missing' end, case when has then '' else 'Description missing' end], lambda x: x <> ''), '; ') as "Review Note"
from v
""")
def export_clean(spark, sf_dir):
    """S13, P31, P32, P54, P57, P60, T06 to T08."""
    joined, _ = _joined(spark, sf_dir)
    return export.clean(joined, clean_options(fields=("website", "email", "phone", "facebook", "description"), phone_region="US", include_evidence=True))


def _job_events(spark, sf_dir) -> DataFrame:
    c = F.col
    kind = _pick(c("event_id"), ("started", "completed", "failed", "running", "completed", "paused", "resumed"))
    n = lambda k: (c("event_id") % k).cast("int")
    return t(spark, sf_dir, "events").select((c("user_id") % 100).cast("string").alias("job_id"), c("event_id").alias("seq"), kind.alias("event"), c("user_id").cast("string").alias("domain"), n(3).alias("n_email"), n(2).alias("n_phone"), n(4).alias("n_social"), F.when(c("event_id") % 10 == 0, "fallback").otherwise("direct").alias("stage"), F.lit("").alias("error"), c("ts").cast("timestamp").alias("at"))


JOB_EVENTS = f"select (user_id % 100)::varchar as job_id, event_id as seq, {_sql_pick('event_id', ('started', 'completed', 'failed', 'running', 'completed', 'paused', 'resumed'))} as event, event_id % 3 as e, event_id % 2 as p, event_id % 4 as s, event_id % 10 = 0 as fb, ts from events"


@query(f"""
select job_id, count(*) filter (where event = 'started') as started, count(*) filter (where event = 'completed') as completed, count(*) filter (where event = 'failed') as failed,
       coalesce(sum(e) filter (where event = 'completed'), 0)::bigint as emails, coalesce(sum(p) filter (where event = 'completed'), 0)::bigint as phones, coalesce(sum(s) filter (where event = 'completed'), 0)::bigint as socials,
       count(*) filter (where event = 'completed' and e + p + s > 0) as extracted, count(*) filter (where event = 'completed' and fb) as recovered,
       arg_max(event, seq) filter (where event in ('running', 'paused', 'resumed')) as state
from ({JOB_EVENTS}) group by job_id
""")
def job_progress(spark, sf_dir):
    """Counters of each job; the streaming query folds the same way."""
    return job_events.fold(_job_events(spark, sf_dir))


@query(f"""
with j as (select job_id, count(*) filter (where event = 'completed') as c, count(*) filter (where event = 'failed') as f, count(*) as n from ({JOB_EVENTS}) group by job_id)
select job_id, round((c + f) * 100.0::double / n, 1) as percent, n - c - f as remaining, case when c + f > 0 then round(90.0::double / (c + f) * (n - c - f), 6) end as eta,
       case when n < 60 then n || 's' when n < 3600 then (n // 60) || 'm ' || lpad((n % 60)::varchar, 2, '0') || 's' else (n // 3600) || 'h ' || lpad(((n // 60) % 60)::varchar, 2, '0') || 'm' end as shown
from j
""")
def job_eta(spark, sf_dir):
    """A18, P44."""
    e = _job_events(spark, sf_dir).groupBy("job_id").agg(F.count_if(F.col("event") == "completed").alias("c"), F.count_if(F.col("event") == "failed").alias("f"), F.count(F.lit(1)).alias("n"))
    p = job_events.progress(F.col("c"), F.col("f"), F.col("n"), F.lit(90.0))
    return e.select("job_id", p["percent"].alias("percent"), p["remaining"].alias("remaining"), F.round(p["eta"], 6).alias("eta"), text.duration(F.col("n")).alias("shown"))


@query(f"""
with f as (select o_custkey as k, (o_orderkey % 4)::int as tier_order, o_orderkey, {_sql_pick('o_orderkey', ('200', '404', '503', '200'))}::int as status, case when o_orderkey % 6 = 0 then '' else 'page ' || o_orderkey end as html, o_orderkey::int as elapsed_ms from orders),
g as (select *, status = 200 and html <> '' as ok from f)
select k, o_orderkey, status from (select *, row_number() over (partition by k order by ok desc, case when ok then tier_order end, html <> '' desc, status desc, elapsed_ms, tier_order, o_orderkey) as r from g) where r = 1
""")
def fetch_pick(spark, sf_dir):
    """The fetch to use of each site."""
    c = F.col
    f = t(spark, sf_dir, "orders").select(c("o_custkey").alias("k"), (c("o_orderkey") % 4).cast("int").alias("tier_order"), "o_orderkey", _pick(c("o_orderkey"), (200, 404, 503, 200)).alias("status"), F.when(c("o_orderkey") % 6 == 0, "").otherwise(F.concat(F.lit("page "), c("o_orderkey").cast("string"))).alias("html"), c("o_orderkey").cast("int").alias("elapsed_ms"))
    return crawl.pick_fetch(f, ["k"]).select("k", "o_orderkey", "status")


@query(f"""
select {SITE} as site_key, (i)::int as pos, s || '://' || h || '/page' || page_id || '-' || i as link from ({NORMAL}), (values (0), (2)) v(i)
""")
def sitemap_links(spark, sf_dir):
    """Addresses of generated sitemaps, foreign ones dropped."""
    u = F.col("n.url")
    o = urls.origin(u)
    rows = t(spark, sf_dir, "pages").select("page_id", urls.normalized("url").alias("n")).select(urls.site_key(u).alias("site_key"), o.alias("origin"), F.concat(F.lit("<urlset><url><loc>"), o, F.lit("/page"), F.col("page_id").cast("string"), F.lit("-0</loc></url><url><loc>https://elsewhere.org/x</loc></url><url><LOC> "), o, F.lit("/page"), F.col("page_id").cast("string"), F.lit("-2 </LOC></url></urlset>")).alias("html"))
    return rank.sitemap_links(rows, ["site_key"]).select("site_key", "pos", "link")


@query(f"select page_id from ({NORMAL}) where not (regexp_matches(h, '^www\\.') and starts_with(p, '/en'))")
def robots_allowed(spark, sf_dir):
    """Pages that generated robots files allow; hosts with www keep agents out of /en."""
    pages_ = t(spark, sf_dir, "pages").select("page_id", urls.normalized("url")["url"].alias("url"))
    files = pages_.select(urls.origin(F.col("url")).alias("origin")).distinct().where(F.col("origin").contains("://www.")).withColumn("body", F.lit("User-agent: *\nDisallow: /en\n"))
    return crawl.allowed(pages_, files).select("page_id")
