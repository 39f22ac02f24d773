import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sitelore.functions import email, html, phone, social, text, urls
from sitelore.operators import crawl, export, merge, page, rank, resolve, tasks
from sitelore.plans import options
from sitelore.plans import queries as contact
from sitelore.sources import csv
from sitelore.streaming import events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", list(contact.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine = entry.queries()[name](spark, SF)
    other = db.sql(contact.ORACLE_SQL[name])
    order = sorted(mine.columns)
    assert order == sorted(other.columns)
    put = lambda rows, names: sorted(repr([plain(r[names.index(c)]) for c in order]) for r in rows)
    assert put(mine.collect(), mine.columns) == put(other.fetchall(), list(other.columns))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 50


@pytest.mark.parametrize(
    "raw, want",
    [
        (" Example.COM/path/?utm_source=x&a=1#top", "https://example.com/path/?a=1"),
        ("//www.Shop.example.co.uk//a//b", "https://www.shop.example.co.uk/a/b"),
        ("http://user:pw@münchen.de:8080?b=&ref=1&c=a b", "http://xn--mnchen-3ya.de:8080/?b=&c=a+b"),
        ("&quot;a.org&quot;", "https://a.org/"),
    ],
)
def test_normal_urls(raw, want):
    assert urls.normalize(raw) == want


@pytest.mark.parametrize("raw, error", [("", "empty website value"), (None, "empty website value"), ("mailto:a@b.c", "unsupported URL scheme: mailto"), ("file:///x", "unsupported URL scheme: file"), ("https://", "URL has no hostname"), ("-bad.com", "invalid hostname"), ("a..b.com", "invalid international hostname"), ("example.com:80", "unsupported URL scheme: example.com")])
def test_bad_urls(raw, error):
    assert urls.try_normalize(raw) == (None, error)
    if raw == "example.com:80":
        assert urls.normalize(raw, lenient_port=True) == "https://example.com:80/"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcZ0.-/?&=#%+ é:@", max_size=40))
def test_normal_form_is_stable(raw):
    url, _ = urls.try_normalize("https://a.com/" + raw)
    # white space at the end of a path is no part of a value that is read again
    if url and url == url.strip():
        assert urls.try_normalize(url) == (url, "")


def test_domains_and_links(spark):
    assert urls.domain_of("https://www.shop.example.co.uk/a") == "example.co.uk"
    rows = spark.createDataFrame([("www.shop.example.co.uk",), ("a.b.com",), ("co.uk",), ("10.0.0.1",), ("x.unknown",), ("com",), ("a.shop.com.br",), ("shop.at",), ("a.b.or.th",), ("www.b.pizza",), ("x.xn--p1ai",)], "h string")
    got = [r[0] for r in rows.select(urls.registered_domain(F.col("h"))).collect()]
    assert got == [urls.domain_of_host(h) for (h,) in rows.collect()] == ["example.co.uk", "b.com", "co.uk", "10.0.0.1", "x.unknown", "com", "shop.com.br", "shop.at", "b.or.th", "b.pizza", "x.xn--p1ai"]
    base = "https://a.com/x/y"
    assert urls.link(base, "../z?utm_a=1#f") == "https://a.com/z"
    assert [urls.link(base, h) for h in ("#top", "mailto:a@b.c", " ", "{x}", None, "http://[bad", "javascript:0")] == [None] * 7
    ips = spark.createDataFrame([("8.8.8.8",), ("10.0.0.1",), ("localhost",), ("a.local",), ("a.com",), ("::1",)], "h string")
    assert [r[0] for r in ips.select(urls.allowed_host("h")).collect()] == [True, False, False, False, True, False]


BAKERY = """<!doctype html><html lang="en-AU"><title>Lantern &amp; Loaf</title>
<meta property="og:description" content="%s">
<script type="application/ld+json">[{"@type":"Bakery","legalName":"Lantern and Loaf Pty","email":"orders@lanternloaf.org","faxNumber":"02 5550 1234","sameAs":"https://www.pinterest.com/lanternloaf/","address":"7 Quay Lane, Hobart"}]</script>
<p>Write to baker (at) lanternloaf (dot) org or <a href="MAILTO:Till%%40lanternloaf.org?subject=Bread,shop@lanternloaf.org">the till</a>, ring <a href="tel:+61255509876">us</a>.
<a href="https://m.facebook.com/lanternloaf?ref=1">like</a> <a href="https://facebook.com/sharer/sharer.php?u=x">share</a> <a href="https://tiktok.com/@lanternloaf">clips</a> <a href="https://twitter.com/intent/tweet">tweet</a>
<a href="opening-hours/#today">Opening hours</a><a href="//stall.lanternloaf.org/">Stall</a><svg><text>no@lanternloaf.org</text></svg>""" % ("bread " * 12)


def test_one_page(spark):
    rows = spark.createDataFrame([(1, "https://lanternloaf.org/about", BAKERY), (2, "https://b.com/", None), (3, "https://c.com/", "")], "k int, url string, html string")
    parsed = page.parse_pages(rows)
    ev = merge.merge_page(page.evidence(parsed, ["k"], default_region="US"), ["k"])
    got = {(r.kind, r.value): r for r in ev.collect()}
    assert {v.partition("@")[0] for k, v in got if k == "email"} >= {"orders", "shop", "baker", "till"}
    assert {v: got["phone", v].meta["region"] for k, v in got if k == "phone"} == {"+61255501234": "AU", "+61255509876": "AU"}
    assert {v for k, v in got if k == "social"} == {"https://pinterest.com/lanternloaf", "https://facebook.com/lanternloaf", "https://tiktok.com/@lanternloaf"}
    assert got["email", "orders@lanternloaf.org"].confidence == pytest.approx(0.99) and got["email", "orders@lanternloaf.org"].source_type == "json_ld" and {r.k for r in got.values()} == {1}
    facts = parsed.where("k = 1").select("parsed.*").first()
    assert (facts.title, facts.address, facts.description) == ("Lantern & Loaf", "7 Quay Lane, Hobart", ("bread " * 12).strip()) and facts.names == ["Lantern and Loaf Pty"]
    assert [(r.link, r.text) for r in page.links(parsed, ["k"]).orderBy("pos").collect()] == [("https://lanternloaf.org/opening-hours/", "Opening hours"), ("https://stall.lanternloaf.org/", "Stall")]
    plan = page.evidence(parsed, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("_parsed(") <= 2


def test_facts_and_evidence_are_those_of_two_readings(spark):
    rows = spark.createDataFrame([(1, "https://lanternloaf.org/about", BAKERY), (2, "https://b.com/", "<p>x"), (3, "https://c.com/", "")], "k int, url string, html string")
    parsed = page.parse_pages(rows)
    both = page.facts_and_evidence(parsed, ["k"], F.struct(F.col("parsed.title").alias("title")))
    put = lambda df: sorted(map(repr, df.collect()))
    assert put(both.where("kind <> 'page'").drop("facts")) == put(page.evidence(parsed, ["k"]))
    assert {r.k: r.facts.title for r in both.where("kind = 'page'").collect()} == {1: "Lantern & Loaf", 2: "", 3: ""}


def test_long_links_are_kept_whole(spark):
    far = "a" * 1_200_000
    rows = spark.createDataFrame([("https://a.com/", f'<a href="tel:{far}">t</a>')], "url string, html string")
    assert len(page.parse_pages(rows).select(page._prefixed(F.col("parsed.anchors"), "tel:")[0]).first()[0]) == len(far)
    host = spark.createDataFrame([("https://www." + "a." * 6000 + "com/x",)], "u string").select(urls.variants(F.col("u"))).first()[0]
    assert host[1] == "https://" + "a." * 6000 + "com/x"


def test_html_states(spark):
    shell = '<div id="root"></div>' + "<script></script>" * 3
    rows = spark.createDataFrame([(200, shell, ""), (403, "x", "x" * 200), (200, "Please solve the CAPTCHA", "y"), (500, "z", "z")], "status int, html string, text string")
    c = F.col
    got = rows.select(html.js_shell(c("html"), c("text")), html.blocked(c("status"), c("html")), html.usable(c("status"), c("html")), html.transient(c("status"))).collect()
    assert [tuple(r) for r in got] == [(True, False, True, False), (False, True, False, False), (False, True, True, False), (False, False, False, True)]
    assert html.cloudflare("42232d2d6c21") and html.cloudflare("zz") == "" and html.cloudflare("") == ""


def test_email_rules(spark):
    cases = {"a@b.com": "valid", "a@test.com": "blocked_domain", "a..b@c.com": "local_part", "x@y.png": "asset", "a@-b.com": "host", "ab": "shape", "x" * 65 + "@b.com": "local_part"}
    rows = spark.createDataFrame([(k,) for k in cases], "e string")
    assert {r.e: r.v for r in rows.select("e", email.verdict(F.col("e")).alias("v")).collect()} == cases
    kinds = spark.createDataFrame([("info@acme.com",), ("hrishi@acme.com",), ("ann@acme.com",), ("ann@gmail.com",), ("ann@other.org",)], "e string")
    assert [r[0] for r in kinds.select(email.category(F.col("e"), F.lit("acme.com"))).collect()] == ["generic", "generic", "named", "free_mail", "external_domain"]
    odd = spark.createDataFrame([("é.a@b.com",), ("x a+b%40c.org y",), ("mail (at) acme (dot) org now",)], "t string")
    assert [r[0] for r in odd.select(email.candidates(F.col("t"))).collect()] == [[], [], []]
    assert [r[0] for r in odd.select(email.address(F.col("t"))).collect()][1] == "a+b@c.org"
    assert odd.select(email.obfuscated(F.col("t"))).collect()[2][0][0].startswith("mail@acme.org")


def test_phones():
    assert phone.normal("+61 477 533 988", "US") == ("+61477533988", "AU", "MOBILE")
    assert phone.shown("+61477533988", "AU", "national") == ("0477 533 988", "AU", "Mobile")
    assert phone.shown("+61477533988", "US", "national") == ("", "", "")
    assert phone.normal("(415) 555-2671", "US") == ("+14155552671", "US", "FIXED_LINE_OR_MOBILE")
    assert phone.shown("+14155552671", "AUTO", "international")[0] == "+1 415-555-2671"
    assert [phone.normal(x, "US") for x in ("", None, "+49 30 123456", "12", "777-777-7777 x", "111 222 3333")] == [None] * 6


def test_primary_picks(spark):
    e = lambda v, kind, src, conf, cat, t=None: (1, v, kind, "https://a.com/", src, conf, cat, "", {"region": "AU", "type": t} if t else None)
    rows = spark.createDataFrame([e("ann@a.com", "email", "visible_text", 0.88, "named"), e("info@a.com", "email", "mailto", 0.98, "generic"), e("+61477533988", "phone", "json_ld", 0.96, "", "MOBILE"), e("+61291234567", "phone", "tel", 0.99, "", "FIXED_LINE"), e("https://facebook.com/long", "social", "anchor", 0.94, "facebook"), e("https://facebook.com/a", "social", "anchor", 0.94, "facebook")], "k int, value string, kind string, source_url string, source_type string, confidence double, category string, raw_value string, meta map<string,string>")
    lists = merge.contacts(rows, ["k"])
    c = F.col("contacts")
    r = lists.select(merge.primary_email(c)["value"], merge.primary_social(c, "facebook")["value"], merge.primary_social(c, "tiktok")["value"], merge.has_kind(c, "phone", 0.95), merge.fulfilled(c, F.lit(""), F.lit("x"))).first()
    assert tuple(r) == ("info@a.com", "https://facebook.com/a", None, True, ["email", "phone", "social", "description"])
    best = merge.primary_phones(rows, ["k"], wanted="AU").first().phone
    assert (best.text, best.type, best.source) == ("(02) 9123 4567", "Fixed Line", "tel")
    texts = spark.createDataFrame([(1, "ab", 1), (2, "abc", 1), (3, "xyz", 1), (0, "", 1)], "o int, t string, k int")
    assert tuple(texts.groupBy("k").agg(merge.longest(F.col("t"), F.col("o")), merge.earliest(F.col("t"), F.col("o"))).first())[1:] == ("abc", "ab")


def test_rankings_agree(spark):
    links = [("https://a.com/blog/contact", "x"), ("https://a.com/contact", ""), ("https://a.com/about-us", "About"), ("https://a.com/z", "our mission"), ("https://a.com/privacy", "")]
    rows = spark.createDataFrame([("a.com", u, t) for u, t in links], "site_key string, link string, text string")
    sites = spark.createDataFrame([("a.com", "https://a.com/")], "site_key string, base_url string")
    for wanted in ((), ("email",), ("social",), ("description",)):
        got = [r.url for r in rank.rank_subpages(rows, sites, ["site_key"], limit=6, wanted=wanted).orderBy("rank").collect()]
        assert got == rank.rank_list(links, "https://a.com/", 6, wanted)
    assert rank.rank_list(links, "https://a.com/", 1) == ["https://a.com/contact"]


def crawled(spark, pages, starts=("https://a.com/",), **how):
    """Visits (url, status, wanted, found) of each start, over a store of bodies by URL."""
    sites = spark.createDataFrame([(u,) for u in starts], "url string")
    store = spark.createDataFrame([x if isinstance(x, tuple) else (x, pages[x]) for x in pages], "url string, html string")
    out: dict = {}
    for r in crawl.crawl(sites, store, **how).orderBy("site_key", "ordinal").collect():
        out.setdefault(r.site_key, []).append((r.url, r.status, r.wanted, r.found))
    return out if len(starts) > 1 else out[urls.host_of(starts[0]).removeprefix("www.")]


def test_crawl_uses_sitemaps_last(spark):
    store = {"https://a.com/": "<p>hi</p>", "https://a.com/robots.txt": "User-agent: *\nAllow: /\nSitemap: https://a.com/map.php\n", "https://a.com/map.php": "<urlset><url><loc> https://a.com/contact/x </loc></url><loc>https://b.com/contact</loc></urlset>", "https://a.com/contact/x": "<p>q@a.org</p>"}
    seen = crawled(spark, store, wanted=("email",), max_pages=20)
    assert seen[0][:2] == ("https://a.com/", "ok") and seen[-1] == ("https://a.com/contact/x", "ok", "email", "email")
    assert crawled(spark, store, wanted=("email",), max_pages=2, sitemap_first=True)[-1][0] == "https://a.com/contact/x"
    index = {"https://a.com/": "<p>hi</p>", "https://a.com/sitemap_index.xml": "<loc>https://a.com/team/contact</loc>", "https://a.com/team/contact": "q@a.org"}
    assert crawled(spark, index, wanted=("email",), max_pages=20)[-1][0] == "https://a.com/team/contact"
    assert crawled(spark, store, ("https://gone.com/",), wanted=("email",), max_pages=5) == [("https://gone.com/", "failed", "email", "")]


def test_home_pages_are_found_under_their_variants(spark):
    shell = '<div id="root"></div>' + "<script></script>" * 3
    store = {"http://www.a.com/": "<p>x@a.com</p>", "https://b.com/": shell, "https://www.b.com/": "<p>y@b.com</p>", "http://c.com/": "c", "https://d.com/": shell}
    got = crawled(spark, store, ("https://a.com/", "https://b.com/", "https://c.com/", "https://d.com/"), wanted=("email",), max_pages=1)
    assert {k: (v[0][0], v[0][3]) for k, v in got.items()} == {"a.com": ("http://www.a.com/", "email"), "b.com": ("https://www.b.com/", "email"), "c.com": ("http://c.com/", ""), "d.com": ("https://d.com/", "")}


def test_robots_rules_hold_in_the_walk(spark):
    store = {"https://a.com/": '<a href="/contact">Contact</a>', "https://a.com/contact": "x@a.com", "https://a.com/robots.txt": "User-agent: *\nDisallow: /contact\n", "https://b.com/": "<p>", "https://b.com/robots.txt": "User-agent: *\nDisallow: /\n"}
    got = crawled(spark, store, ("https://a.com/", "https://b.com/"), wanted=("email",), max_pages=2)
    assert [v[1] for v in got["a.com"]] == ["ok", "disallowed"] and got["b.com"] == [("https://b.com/", "disallowed", "email", "")]
    other = {"https://www.c.com/": '<a href="/contact">Contact</a>', "https://www.c.com/contact": "x@c.com", "https://www.c.com/robots.txt": "User-agent: *\nDisallow: /contact\n"}
    assert [v[1] for v in crawled(spark, other, ("https://c.com/",), wanted=("email",), max_pages=2)] == ["ok", "disallowed"]
    assert crawled(spark, store, ("https://a.com/", "https://b.com/"), wanted=("email",), max_pages=2, respect_robots=False)["a.com"][-1] == ("https://a.com/contact", "ok", "email", "email")


@pytest.mark.parametrize("body", ['<a href="https://facebook.com/sharer/x">s</a>', "x@-bad.com", "a..b@shop.com", "mail@example.com", "ring 555 1234", '<a href="tel:12">t</a>', "icon@2x.png"])
def test_a_fast_crawl_goes_on_after_what_is_no_contact(spark, body):
    store = {"https://a.com/": f'{body}<a href="/contact">Contact</a>', "https://a.com/contact": '<a href="mailto:me@a.com">m</a><a href="tel:+12125550147">t</a><a href="https://facebook.com/a">f</a>'}
    got = crawled(spark, store, wanted=("email", "phone", "social"))
    assert [(v[0], v[3]) for v in got] == [("https://a.com/", ""), ("https://a.com/contact", "email,phone,social")]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from(['<a href="mailto:a@b.com">', "c@-d.com ", "e@f.png ", "g [at] h [dot] org ", '<a href="tel:+1 212 555 0147">', "(212) 555-0147 ", "111 222 3333 ", '<a href="https://x.com/acme">', '<a href="https://x.com/intent/x">', '<a href="https://linkedin.com/company/">', "<p>" + "we are a firm that makes things " * 5, "<address>12 Long Street, Town</address>"]), max_size=5))
def test_found_is_the_evidence_of_the_page(spark, parts):
    body = "<html>" + " ".join(parts)
    parsed = page.parse_pages(spark.createDataFrame([("https://a.com/", body)], "url string, html string"))
    kinds = {r.kind for r in page.evidence(parsed, ["url"]).select("kind").distinct().collect()}
    facts = parsed.select("parsed.address", "parsed.description").first()
    kinds |= {k for k in ("address", "description") if facts[k]}
    assert crawled(spark, {"https://a.com/": body}, max_pages=1)[0][3] == ",".join(sorted(kinds))


def test_a_fast_crawl_ends_by_fields_quality_and_region(spark):
    store = {
        "https://a.com/": '<p>seen@a.com (212) 555-0147</p><a href="https://x.com/a">x</a><a href="/contact">Contact</a><a href="/about">About us</a>',
        "https://a.com/contact": '<a href="mailto:best@a.com">m</a><a href="tel:+61255509876">t</a>',
        "https://a.com/about": '<a href="https://facebook.com/a">f</a>',
    }
    pages = lambda *fields, **more: [(v[0].rpartition("/")[2], v[2]) for v in crawled(spark, store, options=options.clean_options(fields, **more))]
    assert pages("email") == [("", "email")]
    assert pages("email", fast_quality="strict") == [("", "email"), ("contact", "email")]
    assert pages("website", "phone", fast_quality="loose") == [("", "phone")]
    assert pages("phone", phone_region="australia") == [("", "phone"), ("contact", "phone")]
    assert pages("twitter") == [("", "social")]
    assert [x for x, _ in pages("facebook")][:1] == [""] and pages("facebook")[-1] == ("about", "social")
    assert [x for x, _ in pages("website")] == [""]


def test_a_walk_by_hand():
    """The budget, batches and the order of the queue, without a store."""
    made = lambda url, *to, **more: {"url": url, "shell": False, "links": [{"url": u, "text": t} for u, t in to], "entries": [], "sitemaps": [], "rules": None, "address": False, "description": False, "found": [], **more}
    store = {u: made(u + "/", *to) for u, to in {"https://a.com": [("https://a.com/team", "Team"), ("https://a.com/support", ""), ("https://b.com/contact", "")], "https://a.com/team": [("https://a.com/staff", "")], "https://a.com/support": []}.items()}
    full = crawl.walk_one("https://a.com/", store.get, crawl.rules_of(("email",), 5, False))
    assert len(full) == 5 and [v[1] for v in full].count("ok") == 3 and not any("b.com" in v[0] for v in full)
    fast = crawl.walk_one("https://a.com/", store.get, crawl.rules_of(("email",), 4, True))
    assert len(fast) == 4 and fast[0][:2] == ["https://a.com/", "ok"]
    found = {"kind": "email", "category": "generic", "region": "", "confidence": 0.9}
    store["https://a.com"]["found"] = [found]
    assert len(crawl.walk_one("https://a.com/", store.get, crawl.rules_of(("email",), 4, True))) == 1
    assert crawl.walk_one("https://a.com/", store.get, crawl.rules_of(("email",), 4, False))[0][3] == "email"


def test_the_pages_of_one_domain_are_dealt_over_tasks(spark):
    """A domain with most pages of the store: its facts are spread by URL, and no join shuffles them again."""
    n = 400
    store = spark.range(n).select(F.concat(F.lit("https://u"), F.col("id").cast("string"), F.lit(".big.com/")).alias("url"), F.lit("<p>a@big.com</p>").alias("html"))
    sites = store.select("url")
    facts, _ = crawl.read_pages(sites, store)
    sizes = facts.groupBy(F.spark_partition_id()).count().select("count").collect()
    assert max(r[0] for r in sizes) < n / 2
    plan = sites.select(crawl.page_key(F.col("url")).alias("key")).join(facts.hint("shuffle_hash"), "key", "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    visits = crawl.crawl(sites, store, wanted=("email",), max_pages=2)
    assert visits.count() == n and visits.where("found = 'email'").count() == n


def crawl_plans(spark, monkeypatch, tmp_path, **how):
    """Plans of (facts, rounds) of a crawl over a store whose files are far smaller than its rows, and its visits."""
    n, facts, rounds = 300, [], []
    url = F.concat(F.lit("https://u"), F.col("id").cast("string"), F.lit(".com/"))
    spark.range(n).select(F.explode(F.array(F.struct(url.alias("url"), F.lit("<a href='/contact'>c</a>").alias("html")), F.struct(F.concat(url, F.lit("contact")).alias("url"), F.lit("<p>a@b.com</p>").alias("html")))).alias("p")).select("p.*").write.parquet(f"{tmp_path}/store")
    cut, deal = crawl.cut, crawl.cut_by
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(crawl, "cut", lambda df: (rounds.append(plan(df)) if "state" in df.columns else None, cut(df))[1])
    monkeypatch.setattr(crawl, "cut_by", lambda df, key: (facts.append(plan(df)), deal(df, key))[1])
    store = spark.read.parquet(f"{tmp_path}/store")
    visits = crawl.crawl(store.where(F.col("url").endswith("m/")).select("url"), store, wanted=("email",), **how)
    return facts, rounds, n, visits


def test_a_full_crawl_sends_no_page_through_the_driver(spark, monkeypatch, tmp_path):
    facts, rounds, n, visits = crawl_plans(spark, monkeypatch, tmp_path, max_pages=3, fast=False)
    assert len(facts) == 1 and len(rounds) > 2
    assert not any("Broadcast" in p for p in [*facts, *rounds])
    assert visits.count() == 3 * n and visits.where("found = 'email'").count() == n


def test_a_fast_crawl_moves_narrow_rows_and_each_state_once(spark, monkeypatch, tmp_path):
    """A round sends addresses to the facts, without the state of the walk, and the facts stay where they are."""
    _, rounds, n, visits = crawl_plans(spark, monkeypatch, tmp_path, max_pages=3)
    for p in rounds[1:]:
        assert "Broadcast" not in p and "hashpartitioning(key" in p
        asked = next(line for line in p.splitlines() if "Generate explode" in line)
        assert "state" not in asked and p.count("Exchange hashpartitioning(key") == p.count("Sort [key") == 1
    assert visits.count() == 2 * n and visits.where("found = 'email'").count() == n


def test_a_fast_crawl_as_executed_broadcasts_the_domains_alone(spark, monkeypatch, tmp_path):
    """Plans as adaptive execution left them, with a limit under which Spark would broadcast every table."""
    plans, cut = [], crawl.cut

    def kept(df):
        out = cut(df)
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]))
        return out

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        monkeypatch.setattr(crawl, "cut", kept)
        _, _, n, visits = crawl_plans(spark, monkeypatch, tmp_path, max_pages=3)
        assert visits.count() == 2 * n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("isFinalPlan=true" in p for _, p in plans) > 3
    assert all("Broadcast" not in p for names, p in plans if "facts" not in names)
    assert "Broadcast" not in visits._jdf.queryExecution().executedPlan().toString()


def test_equal_starts_are_one_walk_and_others_walks_of_their_own(spark):
    starts = ["https://a.com/", "https://a.com/", "https://www.a.com/"]
    store = [("https://a.com/", "<p>x@a.com</p>")]
    sites = spark.createDataFrame([(u,) for u in starts], "url string")
    visits = crawl.crawl(sites, spark.createDataFrame(store, "url string, html string"), wanted=("email",), max_pages=2)
    assert sorted((r.site_key, r.ordinal, r.found) for r in visits.collect()) == [("a.com", 0, "email")] * 2


def test_task_state_and_reset(spark):
    own = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "domain_key string")
    log = spark.createDataFrame([("a", 0, 1, "error", "x"), ("a", 0, 2, "ok", ""), ("b", 0, 1, "failed", "blocked"), ("c", 0, 1, "error", "e"), ("c", 0, 2, "error", "e"), ("c", 0, 3, "error", "e3")], "domain_key string, epoch int, attempt_no int, outcome string, error string")
    state = {r.domain_key: (r.status, r.attempts) for r in tasks.state(own, log).collect()}
    assert state == {"a": ("completed", 2), "b": ("failed", 1), "c": ("failed", 3), "d": ("pending", 0)}
    fresh = tasks.reset(log, tasks.state(own, log).where("status = 'failed'"))
    assert {r.domain_key: (r.status, r.attempts) for r in tasks.state(own, fresh).collect()} == {"a": ("completed", 2), "b": ("pending", 0), "c": ("pending", 0), "d": ("pending", 0)}


COMPANIES = [(1, "Copper Kettle Brewing Ltd", "Leeds"), (2, "", "x"), (3, "Nowhere At All", "")]


def test_resolver_scores(spark):
    assert spark.range(1).select(text.similarity(F.lit("Copper Kettle Brewing Ltd"), F.lit("Copper  kettle brewing"))).first()[0] == 1.0
    c = spark.createDataFrame(COMPANIES, "company_id long, company string, location string")
    told = spark.createDataFrame([(1, "copperkettlebrewing.co.uk", "serpapi", 0, "Copper  Kettle Brewing", "", 0.19), (1, "https://www.facebook.com/copperkettle", "serpapi", 1, "Copper Kettle", "", 0.19)], "company_id long, url string, source string, source_order int, title string, snippet string, source_score double")
    pages = {"parked": "<title>Copper Kettle Brewing</title><p>This domain for sale, Leeds", "own": "<title>Copper Kettle Brewing</title><p>Beer from Leeds since spring", "gone": ""}
    got = {}
    for name, body in pages.items():
        store = spark.createDataFrame([("https://copperkettlebrewing.co.uk/", body, 200)], "url string, html string, status int")
        got[name] = {r.company_id: r for r in resolve.resolve(c, store, candidates=told, guess=False).collect()}
    own = got["own"]
    assert (own[1].status, own[1].website) == ("found", "https://copperkettlebrewing.co.uk/") and own[1].confidence > 0.85 and len(own[1].candidates) == 1
    assert [own[k].status for k in (2, 3)] == ["invalid_input", "not_found"]
    assert got["parked"][1].status == "review" and got["parked"][1].confidence < 0.62 and got["parked"][1].website == ""
    assert got["gone"][1].confidence < own[1].confidence
    rows = c.withColumn("Website", F.lit("old.com"))
    done = {r.company_id: r for r in resolve.add_finder_columns(rows, resolve.resolve(c, store.limit(0), candidates=told, guess=False)).collect()}
    assert done[3].Website == "old.com" and done[1].website_top_candidates.startswith("https://copperkettle")


def test_structured_evidence_of_a_page_counts(spark):
    c = spark.createDataFrame(COMPANIES[:1], "company_id long, company string, location string")
    ld = '<script type="application/ld+json">{"name":"Copper Kettle Brewing","url":"https://copperkettlebrewing.com/","sameAs":["https://copperkettlebrewing.com/x"]}</script>'
    scores = []
    for body in ("<p>x", ld + "<p>x"):
        store = spark.createDataFrame([("https://copperkettlebrewing.com/", body)], "url string, html string")
        scores.append(resolve.resolve(c, store).first())
    assert scores[1].confidence > scores[0].confidence and "structured=" in scores[1].reason and scores[0].source == "domain_guess"
    # a local name is never looked up
    inner = spark.createDataFrame([("https://copperkettlebrewing.com/", "x"), ("http://10.0.0.1/", "Copper Kettle Brewing")], "url string, html string")
    told = spark.createDataFrame([(1, "http://10.0.0.1/", "brave", 0, "", "", 0.17)], "company_id long, url string, source string, source_order int, title string, snippet string, source_score double")
    lone = resolve.resolve(c, inner, candidates=told, guess=False).first()
    assert lone.status == "review" and "name=0.00" in lone.reason


def test_similarity_of_the_closest_text(spark):
    own, texts = "copper kettle brewing", ["kettle copper", "", "brewing supplies of copper", "kopper kettel brewing", "zzz"]
    rows = spark.createDataFrame([(own, texts), ("", texts), (own, []), (own, None)], "own string, others array<string>")
    one = spark.createDataFrame([(t,) for t in texts], "t string").select(text.token_similarity(F.split(F.lit(own), " "), F.filter(F.split("t", " "), lambda x: x != ""))).collect()
    assert [r[0] for r in rows.select(text.closest("own", "others")).collect()] == [pytest.approx(max(r[0] for r in one)), 0.0, 0.0, 0.0]


def test_sources(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('﻿Company,Website,Note\nOne,example.com,"a\nb"\nDup,https://www.example.com,\nBad,,x\n', encoding="utf-8")
    rows = csv.read_list(spark, str(path))
    got = rows.orderBy("row_number").collect()
    assert [r.row_number for r in got] == [2, 3, 4] and got[0].header == ["Company", "Website", "Note"] and got[0].original["Note"] == "a\nb"
    imported = tasks.import_rows(csv.with_website(rows, csv.website_column(got[0].header)))
    assert tuple(tasks.import_stats(imported).first()) == (3, 1, 2, 1) and tasks.unique_tasks(imported).first().first_row == 2
    pasted = csv.paste_websites('Website\nexample.com\n"a.org", b.org\tb.org\nnot a url\n')
    assert pasted == ["example.com", "a.org", "b.org", "b.org", "not a url"]
    assert csv.paste_companies("Company,City\nAcme,Dallas\nRed,\n") == [("Acme", "Dallas"), ("Red", "")]
    assert csv.paste_companies("Acme\tDallas\nRed") == [("Acme", "Dallas"), ("Red", "")]
    assert csv.pasted_rows(spark, "a.com", "website").first().original == {"Website": "a.com"}
    for bad in (lambda: csv.paste_websites(" "), lambda: csv.website_column(["x"]), lambda: csv.input_kind(["x"]), lambda: csv.company_columns(["name"], "nope")):
        with pytest.raises(ValueError):
            bad()
    assert csv.input_kind(["Company Name"]) == "company" and csv.decode("é".encode("cp1252"))[1] == "cp1252"
    out = tmp_path / "out"
    csv.write_export(imported.select("row_number", "website"), str(out), single=True)
    assert next(out.glob("*.csv")).read_text().splitlines()[:2] == ["website", "example.com"]


def test_options():
    o = options.clean_options(("Company Description", "E-Mail", "X", "twitter"), phone_region="south_korea", phone_format="E.164", include_evidence=True, fast_quality="LOOSE")
    assert o.fields == ("description", "email", "twitter_x") and o.kinds == {"description", "email", "social"}
    assert (o.phone_region, o.phone_format, o.email_preference, o.least_confidence) == ("KR", "e164", "business", 0.75)
    assert o.columns == ["Description", "Email", "X/Twitter", "Email Source", "Email Confidence", "Review Note"]
    plain = options.clean_options(phone_region=None, phone_format=" ")
    assert plain.columns == ["Website", "Email", "Phone", "Facebook"] and (plain.phone_region, plain.phone_format, plain.least_confidence) == ("AUTO", "national", 0.86)
    for fields, settings_ in ((("fax",), {}), (("", " "), {}), (("email",), {"phone_region": "Atlantis"}), (("email",), {"phone_format": "morse"}), (("email",), {"fast_quality": "?!x"}), (("email",), {"colour": "red"})):
        with pytest.raises(ValueError):
            options.clean_options(fields, **settings_)
    for name, setting in options.SETTINGS.items():
        for value, others in setting.values.items():
            for spelling in (value, *others):
                assert options.clean_options(**{name: spelling.upper().replace(" ", "-")})._asdict()[name] == value
    job = options.plan_job(("address",), workers=0, max_pages=77)
    assert (job.kinds, job.workers, job.max_pages, job.by_fields) == (frozenset({"address", "email", "phone", "social"}), 1, 20, False) and options.plan_job((), o).by_fields
    with pytest.raises(ValueError):
        options.plan_job(("fax",))
    assert options.mode_label(("social", "email")) == "Emails, Social profiles" and options.mode_label(()).count(",") == 4
    assert options.needed_kinds(("email", "social"), ("facebook", "phone")) == {"social"} and options.needed_kinds(("email",), None) == {"email"}
    assert options.needed_kinds(("email",), ()) == set() and options.needed_kinds(("email",), ("website",)) == {"email"}
    assert export.result_columns(("email",), False) == ["scrape_status", "primary_email", "emails", "final_url", "domain", "notes"]


def test_stream_folds_like_a_batch(spark, tmp_path):
    batch = contact._job_events(spark, SF)
    batch.coalesce(3).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    put = lambda df: sorted(map(tuple, df.collect()))
    run = lambda: events.start_fold(stream, str(tmp_path / "p"), str(tmp_path / "c")).awaitTermination(120)
    run()
    assert put(events.read_fold(spark, str(tmp_path / "p"))) == put(events.fold(batch))
    # a restarted query goes on with what has come since
    batch.limit(40).withColumn("seq", F.col("seq") + 10**6).write.mode("append").parquet(str(tmp_path / "e"))
    run()
    assert put(events.read_fold(spark, str(tmp_path / "p"))) == put(events.fold(spark.read.parquet(str(tmp_path / "e"))))
    ticks = spark.createDataFrame([("j", i, e, f"2024-01-01 00:00:{10 * i:02d}") for i, e in enumerate(("running", "paused", "resumed", "finished"))], "job_id string, seq long, event string, at string").withColumn("at", F.to_timestamp("at"))
    assert events.active_seconds(ticks).first().seconds == 20.0


def test_durations_and_decimals(spark):
    rows = spark.createDataFrame([(None,), (12.9,), (184.0,), (3720.0,)], "s double")
    assert [r[0] for r in rows.select(text.duration(F.col("s"))).collect()] == ["--", "12s", "3m 04s", "1h 02m"]
    assert [r[0] for r in spark.createDataFrame([(0.985,), (0.125,)], "x double").select(text.two_decimals("x")).collect()] == ["0.98", "0.12"]


def test_profiles_of_odd_urls(spark):
    rows = spark.createDataFrame([("https://x.com/acme/status/",), ("https://m.facebook.com/acme?x=1",), ("https://notx.com/a",), ("https://linkedin.com/company/",)], "u string")
    got = [r[0] for r in rows.select(social.canonical(F.col("u"), social.platform(F.col("u")))).collect()]
    assert got == ["https://x.com/acme", "https://facebook.com/acme", None, None]
