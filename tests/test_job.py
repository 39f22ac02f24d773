import csv
import json
import os
import subprocess
import sys

import sitelore.__main__ as command
from sitelore import logs
from sitelore.operators import export, tasks
from sitelore.plans import job as jobs
from sitelore.plans.options import clean_options, plan_job
from sitelore.sources import csv as lists


def test_a_whole_job(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Company,Website\nOne,example.org\nAgain,https://www.example.org/\nBad,\nGone,gone.org\n")
    store = spark.createDataFrame(
        [("https://example.org/", '<title>One</title><a href="/contact">Contact</a><p>We sell.</p>', 200), ("https://example.org/contact", '<a href="mailto:info@example.org">m</a> <a href="tel:+14155552671">t</a><a href="https://facebook.com/one">f</a>', 200), ("https://gone.org/", "nothing", 404)],
        "url string, html string, status int",
    )
    plan = plan_job(("email", "phone", "social"), clean_options(include_evidence=True))
    done = jobs.run(spark, str(tmp_path / "in.csv"), store, str(tmp_path / "out"), plan, single=True)
    assert done == {"rows": 4, "invalid": 1, "sites": 2, "failed": 1, "read": 2}

    def table(name):
        part = next(p for p in os.listdir(tmp_path / "out" / name) if p.endswith(".csv"))
        with open(tmp_path / "out" / name / part, newline="") as f:
            return list(csv.DictReader(f))

    wide = table("results")
    assert [r["Company"] for r in wide] == ["One", "Again", "Bad", "Gone"] and [r["scrape_status"] for r in wide] == ["ok", "ok", "invalid_input", "failed"]
    assert wide[0]["primary_email"] == wide[1]["primary_email"] == "info@example.org" and wide[0]["facebook"] == "https://facebook.com/one"
    assert len(table("contacts")) == 6 and [r["Company"] for r in table("review")] == ["Bad", "Gone"]
    clean = table("clean")
    assert clean[0]["Phone"] == "(415) 555-2671" and clean[0]["Email Source"] == "mailto" and "Email missing" in clean[3]["Review Note"]


def read_csv(folder):
    rows = []
    for p in sorted(os.listdir(folder)):
        if p.endswith(".csv"):
            with open(folder / p, newline="") as f:
                rows += list(csv.DictReader(f))
    return sorted(rows, key=lambda r: int(r.get("row_number") or 0))


HOME = '<title>{0}</title><a href="/contact">Contact</a><p>{0} of {1} makes pots.</p>'


def test_a_company_list_end_to_end(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Business Name,City\nTin Whistle Pots Ltd,Leeds\ntin whistle pots ltd,Leeds\nNobody Knows This Firm,Rome\n,x\n")
    store = spark.createDataFrame([("https://tinwhistlepots.com/", HOME.format("Tin Whistle Pots", "Leeds"), 200), ("https://tinwhistlepots.com/contact", "<p>info@tinwhistlepots.com</p>", 200)], "url string, html string, status int")
    told = spark.createDataFrame([("Nobody Knows This Firm", "Rome", "https://elsewhere.org/", "brave", 0, "Elsewhere", "")], "company string, location string, url string, provider string, position int, title string, snippet string")
    done = jobs.run(spark, str(tmp_path / "in.csv"), store, str(tmp_path / "out"), plan_job(("email",), clean_options(("website", "email"))), candidates=told)
    assert (done["companies"], done["rows"], done["sites"], done["failed"], done["read"]) == (3, 4, 1, 0, 1)
    wide = read_csv(tmp_path / "out" / "results")
    assert [r["Website"] for r in wide] == ["https://tinwhistlepots.com/"] * 2 + [""] * 2
    assert [r["website_finder_status"] for r in wide] == ["found", "found", "review", "invalid_input"] and wide[0]["primary_email"] == "info@tinwhistlepots.com"
    assert "website_reason" not in wide[0] and wide[2]["scrape_status"] == "needs_review"
    assert [r["Email"] for r in read_csv(tmp_path / "out" / "clean")] == ["info@tinwhistlepots.com"] * 2 + [""] * 2


def test_runs_go_on_where_the_last_one_ended(spark, tmp_path):
    path, out = tmp_path / "in.csv", tmp_path / "out"
    page = lambda *urls: spark.createDataFrame([(u, f"<p>me@{u.split('/')[2]}</p>") for u in urls], "url string, html string")
    plan = plan_job(("email",), clean_options(("email",)))
    path.write_text("Website\na.org\nb.org\n")
    run = lambda store, **more: jobs.run(spark, str(path), store, str(out), plan, **more)
    assert run(page("https://a.org/")) | {"rows": 0} == {"rows": 0, "invalid": 0, "sites": 2, "failed": 1, "read": 2}
    # a new site, and a failed one that is there now; what is completed isn't read again
    path.write_text("Website\na.org\nb.org\nc.org\nd.org\n")
    assert run(page("https://b.org/", "https://c.org/"))["read"] == 3
    state = {r.domain_key: (r.result_status, r.attempts) for r in jobs.read_state(spark, f"{out}/state").collect()}
    assert state == {"a.org": ("ok", 1), "b.org": ("ok", 2), "c.org": ("ok", 1), "d.org": ("failed", 1)}
    assert [r["emails"] for r in read_csv(out / "results")] == ["me@a.org", "me@b.org", "me@c.org", ""]
    # a second store for what fails over the first
    assert run(page("https://x.org/"), fallback=page("https://d.org/"))["failed"] == 0
    last = {r.domain_key: r for r in jobs.read_state(spark, f"{out}/state").collect()}["d.org"]
    assert (last.result_status, last.attempts, last.fetch_tier) == ("ok", 2, "fallback:store")
    path.write_text("Website\ne.org\n")
    assert [run(page("https://x.org/"))["read"] for _ in range(4)] == [1, 1, 1, 0]
    assert run(page("https://e.org/"), resume=False) | {"rows": 0} == {"rows": 0, "invalid": 0, "sites": 1, "failed": 0, "read": 1}


def test_pages_that_a_job_may_not_read(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Website\na.org\n10.0.0.1\nb.org\nc.org\nd.org\n")
    store = spark.createDataFrame(
        [("https://a.org/", "<p>x@a.org", 200, "text/html"), ("https://10.0.0.1/", "<p>x@ten.org", 200, None), ("https://b.org/", "<p>x@b.org", 200, "image/png"), ("https://c.org/", "captcha", 403, ""), ("https://d.org/", "<p>x@d.org", 200, None), ("https://d.org/robots.txt", "User-agent: *\nDisallow: /", 200, "text/plain")],
        "url string, html string, status int, content_type string",
    )
    plan = plan_job(("email",))
    done = jobs.run(spark, str(tmp_path / "in.csv"), store, str(tmp_path / "out"), plan, single=True)
    assert done["failed"] == 4
    rows = read_csv(tmp_path / "out" / "results")
    assert [r["emails"] for r in rows] == ["x@a.org", "", "", "", ""] and "private" in rows[1]["notes"] and "robots" in rows[4]["notes"]
    free = jobs.run(spark, str(tmp_path / "in.csv"), store, str(tmp_path / "out2"), plan_job(("email",), respect_robots=False))
    assert free["failed"] == 3


def test_a_fast_crawl_reads_later_pages_for_what_is_wanted(spark):
    sites = spark.createDataFrame([("a.org", "https://a.org/")], "domain_key string, normalized_url string")
    store = spark.createDataFrame([("https://a.org/", '<p>one@a.org</p><a href="/contact">Contact</a>', 200), ("https://a.org/contact", '<p>two@a.org (212) 555-0147</p><a href="https://facebook.com/a">f</a>', 200)], "url string, html string, status int")
    values = lambda job: sorted(c.value for c in jobs.site_results(sites, store, job).first().contacts)
    assert values(plan_job(("email", "phone", "social"))) == ["+12125550147", "https://facebook.com/a", "one@a.org"]
    assert values(plan_job(("email", "phone", "social"), fast=False)) == ["+12125550147", "https://facebook.com/a", "one@a.org", "two@a.org"]


def test_tiers_and_status_of_a_site(spark):
    sites = spark.createDataFrame([("a.org", "https://a.org/")], "domain_key string, normalized_url string")
    store = spark.createDataFrame([("https://a.org/", "<p>old", 200, 2, "browser"), ("https://a.org/", '<a href="/contact">Contact</a>', 203, 1, "direct"), ("https://a.org/contact", "<p>x@a.org", 200, 2, "browser")], "url string, html string, status int, tier_order int, tier string")
    got = jobs.site_results(sites, store, plan_job(("email",), clean_options(("email",)), max_pages=2)).first()
    assert (got.fetch_tier, got.http_status, got.pages_scraped) == ("direct+browser", 203, ["https://a.org/", "https://a.org/contact"])


def test_mail_hosts_in_the_clean_export(spark):
    own = [("info@a.org", "mailto", 0.98, "generic"), ("sales@b.org", "visible_text", 0.88, "generic")]
    contacts = [(v, "email", "", s, c, k, "", None) for v, s, c, k in own]
    rows = spark.createDataFrame([(1, "a.org", {}, "a.org", "https://a.org/", "", "completed", "", "ok", "https://a.org/", "a.org", contacts, "", "", [])], f"row_number int, website string, original map<string,string>, domain_key string, normalized_url string, import_error string, task_status string, last_error string, result_status string, final_url string, domain string, contacts {export.NO_CONTACTS}, address string, description string, errors array<string>")
    hosts = spark.createDataFrame([("A.org", False), ("b.org", True), ("b.org", False)], "host string, has_mail boolean")
    options = clean_options(("email",))
    assert export.clean(rows, options).first().Email == "info@a.org" and export.clean(rows, options, mail_hosts=hosts).first().Email == "sales@b.org"
    assert export.clean(rows, options, mail_hosts=hosts.limit(0)).first().Email == "info@a.org"


def test_lists_in_other_encodings_and_changed_files(spark, tmp_path):
    folder, store = tmp_path / "lists", str(tmp_path / "store")
    folder.mkdir()
    (folder / "one.csv").write_bytes("Website,Ört\na.org,Köln – 5 €\n".encode("cp1252"))
    assert lists.read_list(spark, str(folder / "one.csv")).first().original["Ört"] == "Köln – 5 €"
    (folder / "one.csv").write_text("Website\na.org\n")
    (folder / "two.csv").write_text("Website\nb.org\nc.org\n")
    assert lists.import_changed(spark, str(folder), store) == ["one.csv", "two.csv"]
    assert lists.import_changed(spark, str(folder), store) == []
    (folder / "two.csv").write_text("Website\nd.org\n")
    os.utime(folder / "two.csv", (2_000_000_000, 2_000_000_000))
    assert lists.import_changed(spark, str(folder), store) == ["two.csv"]
    spark.catalog.clearCache()
    assert sorted(r.original["Website"] for r in spark.read.parquet(f"{store}/rows").collect()) == ["a.org", "d.org"]


def test_log_lines(tmp_path):
    log = logs.to_file(str(tmp_path / "log"), size=400, kept=2)
    for k in range(30):
        log.info("site %s", k, extra={"fields": {"domain": "é.org"}})
    assert sorted(os.listdir(tmp_path)) == ["log", "log.1", "log.2"]
    last = (tmp_path / "log").read_text(encoding="utf-8").splitlines()[-1]
    assert json.loads(last) | {"time": ""} == {"time": "", "level": "INFO", "logger": "sitelore", "message": "site 29", "domain": "é.org"}


def test_tasks_known_already(spark):
    some = spark.createDataFrame([("a",), ("b",)], "domain_key string")
    assert [r.domain_key for r in tasks.new_tasks(some, some.where("domain_key = 'a'")).collect()] == ["b"]
    rows = spark.createDataFrame([("Acorn", "x"), ("ACORN", "X"), ("Acorn", None)], "c string, l string")
    assert tuple(tasks.company_stats(rows, "c", "l").first()) == (3, 2)


def test_command_line(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Website\na.org\n")
    spark.createDataFrame([("https://a.org/", "<p>x@a.org")], "url string, html string").write.parquet(str(tmp_path / "pages"))
    argv = [str(tmp_path / "in.csv"), "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "out"), "--fields", "Email", "--fast-quality", "loose", "--log", str(tmp_path / "log")]
    assert command.main(argv) == 0 and '"read": 1' in (tmp_path / "log").read_text()
    assert read_csv(tmp_path / "out" / "clean")[0]["Email"] == "x@a.org"


def test_the_rest_works_without_the_optional_part(tmp_path):
    """The entry module gives the other queries where the training-data parts are gone."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("sitelore.llm") or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.llm is None and e.corpus_pipeline is None
assert "site_overview" in e.queries() and not any(k.startswith("op") or k == "pipeline" for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env=os.environ | {"PYTHONPATH": root})
