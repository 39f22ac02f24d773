"""The crawl over a page store: every stored page is read once, then sites walk over narrow facts by joins.

1. ``read_pages`` parses each stored page of the sites' domains once and gives its evidence and its facts: links,
   sitemap entries, robots rules, title, address, description. Bodies are neither grouped nor joined nor shuffled.
2. ``walk`` moves all sites at once, round by round. A site's state is one narrow row: the pages visited, the queue, what is still
   wanted. It asks for pages by URL, and a join with the facts, which are dealt by URL once, answers. So no task holds the pages of a
   domain, however many it has. A fast crawl takes as many rounds as pages are visited, a full one as many as batches.

What counts as found on a page is its evidence, row for row, because the facts of ``found`` are aggregated from it.

Cases: a site whose home page is in the store under no variant has one visit with status failed. A page that robots rules forbid is visited as
``disallowed``; it uses budget. Of several copies of a URL the one by tier, then by a hash of its body, is read. Null URLs and bodies and bodies over 5 MB are no pages. An empty
list or store gives no rows or failed sites.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Collection
from urllib.robotparser import RobotFileParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls
from ..functions import tables as K
from ..plans.options import CleanOptions, kinds_of, needed_kinds
from .page import KINDS, facts_and_evidence, parse_pages
from .rank import rank_list
from .tables import by_key, cut, cut_by

VISITS = "site_key string, ordinal int, url string, status string, wanted string, found string"
MAX_BYTES = 5_000_000
SITEMAPS, SITEMAP_LINKS = 4, 500
#: Evidence kinds of the long evidence; the other kinds are facts of a page.
EVIDENCE_KINDS = ("email", "phone", "social")


def page_key(url: Column) -> Column:
    return urls.frontier_key(url)


def _facts(body: Column) -> Column:
    """What a walk asks of a page."""
    parsed = F.col("parsed")
    links = F.transform(F.filter(parsed["anchors"], lambda a: a["url"].isNotNull()), lambda a: F.struct(a["url"].alias("url"), a["text"].alias("text")))
    none = F.array().cast("array<string>")
    entries = F.transform(F.regexp_extract_all(body, F.lit(r"(?i)<loc>\s*([^<]+?)\s*</loc>"), F.lit(1)), lambda x: F.regexp_replace(x, r"\s+", ""))
    robots = urls.path(F.col("url")) == "/robots.txt"
    return F.struct(
        F.col("url").alias("url"),
        F.col("tier_name").alias("tier_name"),
        F.col("status").alias("status"),
        html.js_shell(body, parsed["text"]).alias("shell"),
        links.alias("links"),
        F.when(F.lower(body).contains("<loc>"), F.slice(entries, 1, SITEMAP_LINKS)).otherwise(none).alias("entries"),
        F.when(robots, F.regexp_extract_all(body, F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))).otherwise(none).alias("sitemaps"),
        F.when(robots, body).alias("rules"),
        parsed["title"].alias("title"),
        parsed["address"].alias("address"),
        parsed["description"].alias("description"),
    )


def read_pages(sites: DataFrame, pages: DataFrame, *, kinds: Collection[str] = KINDS, site: str = "url", url: str = "url", body: str = "html", default_region: str = "US", max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(facts, evidence) of the stored pages of the sites' registered domains, by ``key``, the URL without slashes at its end.

    Both come from one scan of ``pages``, which may have a ``tier_order`` to choose among copies of a URL, a ``tier`` that names it, and a ``status``.
    """
    or_ = lambda name, value: F.col(name) if name in pages.columns else F.lit(value)
    rows = pages.select(F.col(url).alias("url"), F.col(body).alias("html"), or_("tier_order", 0).cast("int").alias("tier"), or_("tier", "store").alias("tier_name"), or_("status", 200).cast("int").alias("status"))
    rows = rows.where(F.col("url").isNotNull() & (F.col("html") != "") & (F.octet_length("html") <= max_bytes))
    domains = cut(sites.select(urls.domain_key(F.col(site)).alias("domain")).distinct())
    if domains.count() <= 500_000:
        rows = rows.join(F.broadcast(domains), urls.domain_key(F.col("url")) == F.col("domain"), "left_semi")
    keys = ["key", "copy"]
    rows = rows.withColumns({"key": page_key(F.col("url")), "copy": F.struct("tier", F.xxhash64("html").alias("hash"))})
    wanted = [k for k in EVIDENCE_KINDS if k in (set(kinds) or set(KINDS))] or ["email"]
    read = cut(facts_and_evidence(parse_pages(rows), keys, _facts(F.col("html")), kinds=wanted, default_region=default_region))
    evidence = read.where("kind <> 'page'").drop("facts")
    found = by_key(evidence.groupBy(*keys).agg(F.collect_set(F.struct("kind", "category", F.coalesce(F.col("meta")["region"], F.lit("")).alias("region"), "confidence")).alias("found")), "key")
    best = read.where("kind = 'page'").groupBy("key").agg(F.min_by(F.struct("copy", "facts"), F.struct(F.col("facts.shell"), F.col("copy"))).alias("b")).select("key", "b.copy", "b.facts.*")
    # Spark takes the sizes of these tables for those of the compressed files they come from, and would broadcast them
    # through the driver; merged, they stay on the executors, however many pages there are
    facts = best.join(found.hint("merge"), keys, "left")
    # dealt and sorted by key once; the joins of all rounds keep this. A key has one row
    return cut_by(facts, "key").hint("merge"), evidence.hint("merge")


class Walk:
    """The state of one site's crawl; all of it can be written as JSON."""

    def __init__(self, start: str, variants: list[str], rules: dict, state: dict | None = None):
        self.rules = rules
        self.s = state or {"start": start, "homes": (homes := list(dict.fromkeys([*variants, start]))), "want": list(dict.fromkeys([*homes, *(f"{_origin(u)}/robots.txt" for u in [start, *homes])])), "step": "home", "root": "", "robots": None, "sitemaps": None, "queue": [], "seen": [], "visits": [], "found": [], "unmet": None}

    @property
    def want(self) -> list[str]:
        return self.s["want"]

    def wanted(self) -> list[str]:
        """Kinds still looked for."""
        kinds, fields = self.rules["kinds"], self.rules["fields"]
        if not self.rules["fast"]:
            return kinds
        if fields is not None:
            return sorted(needed_kinds(kinds, [f for f in fields if f not in self.s["found"]]))
        return [k for k in kinds if k not in self.s["found"]]

    def _meets(self, page: dict, wanted: list[str]) -> tuple[set[str], set[str]]:
        """(kinds found on the page, what of fields or kinds the page fulfils); only wanted kinds are looked for."""
        items = [x for x in page["found"] or [] if x["kind"] in wanted]
        kinds = {x["kind"] for x in items} | {k for k in ("address", "description") if k in wanted and page[k]}
        if self.rules["fields"] is None:
            return kinds, kinds
        good = [x for x in items if x["confidence"] >= self.rules["least"]]
        region = self.rules["region"]
        met = {"website"} | (kinds & {"address", "description"})
        for x in good:
            if x["kind"] == "email" or (x["kind"] == "phone" and region in ("AUTO", x["region"])):
                met.add(x["kind"])
            elif x["kind"] == "social":
                met |= {f for f, platform in K.SOCIAL_COLUMNS.items() if platform == x["category"]}
        return kinds, met

    def _visit(self, url: str, page: dict | None) -> None:
        wanted = self.wanted()
        state = ",".join(sorted(wanted))
        if not self._allowed(url):
            self.s["visits"].append([url, "disallowed", state, ""])
        elif page is None:
            self.s["visits"].append([url, "failed", state, ""])
        else:
            kinds, met = self._meets(page, wanted)
            self.s["visits"].append([page["url"], "ok", state, ",".join(sorted(kinds & set(self.rules["kinds"])))])
            self.s["found"] = sorted(set(self.s["found"]) | met)

    def _allowed(self, url: str) -> bool:
        if not self.rules["robots"] or not self.s["robots"]:
            return True
        parser = RobotFileParser()
        parser.parse(self.s["robots"].splitlines())
        return parser.can_fetch("*", url)

    def _push(self, links: list[tuple[str, str]]) -> None:
        wanted = self.wanted()
        seen = set(self.s["seen"])
        for u in rank_list(links, self.s["root"], max(4 * self.rules["max_pages"], 20), wanted) if wanted else []:
            key = u.rstrip("/")
            if key not in seen:
                seen.add(key)
                self.s["seen"].append(key)
                self.s["queue"].append(u)

    def _links(self, page: dict) -> list[tuple[str, str]]:
        """Links within the registered domain, the first text of each."""
        own = urls.domain_of(page["url"])
        first: dict[str, str] = {}
        for a in page["links"]:
            if urls.domain_of(a["url"]) == own:
                first.setdefault(a["url"], a["text"])
        return list(first.items())

    def _sitemap_entries(self, got: dict) -> list[tuple[str, str]]:
        found = [u for name in self.s["sitemaps"] for u in (got.get(name.rstrip("/")) or {}).get("entries") or []]
        return [(u, u.rsplit("/", 1)[-1]) for u in found if u.startswith(self.s["root"])]

    def _ask_sitemaps(self) -> None:
        usual = [self.s["root"] + p for p in ("/sitemap.xml", "/sitemap_index.xml")]
        self.s["sitemaps"] = sorted({*usual, *self.s.get("named", [])})[:SITEMAPS]
        self.s["want"], self.s["step"] = self.s["sitemaps"], "sitemaps"

    def _next(self) -> None:
        """Chooses what to ask for, or ends."""
        left = self.rules["max_pages"] - len(self.s["visits"])
        self.s["want"] = []
        if left < 1 or not self.wanted():
            self.s["step"] = "done"
        elif not self.s["queue"]:
            if self.rules["fast"] and self.s["sitemaps"] is None:
                self._ask_sitemaps()
            else:
                self.s["step"] = "done"
        else:
            n = 1 if self.rules["fast"] else min(self.rules["per_site"], left)
            self.s["want"], self.s["queue"] = self.s["queue"][:n], self.s["queue"][n:]
            self.s["step"] = "pages"

    def take(self, got: dict[str, dict]) -> None:
        """Goes on with the pages asked for, by key; pages that aren't there are missing."""
        page = lambda u: got.get(u.rstrip("/"))
        step, asked = self.s["step"], self.s["want"]
        if step == "home":
            robots = lambda u: page(f"{_origin(u)}/robots.txt") or {}
            there = [u for u in self.s.pop("homes") if page(u)]
            home = next((u for u in there if not page(u)["shell"]), there[0] if there else self.s["start"])
            # the rules of the origin that answers, else those of the address given
            rules = robots(home) or robots(self.s["start"])
            self.s["robots"], self.s["named"] = rules.get("rules"), rules.get("sitemaps") or []
            self._visit(home, page(home))
            if self.s["visits"][0][1] != "ok":
                self.s["want"], self.s["step"] = [], "done"
                return
            self.s["root"] = _origin(page(home)["url"])
            self.s["seen"].append(home.rstrip("/"))
            if not self.wanted():
                self.s["want"], self.s["step"] = [], "done"
                return
            if self.rules["sitemap_first"]:
                self.s["later"] = self._links(page(home))
                self._ask_sitemaps()
                return
            self._push(self._links(page(home)))
        elif step == "sitemaps":
            self._push(self._sitemap_entries(got))
            if self.rules["sitemap_first"]:
                self._push(self.s.pop("later"))
        else:
            for u in asked:
                self._visit(u, page(u))
            if self.wanted():
                for u in asked:
                    if page(u) and self._allowed(u):
                        self._push(self._links(page(u)))
        self._next()


def _origin(url: str) -> str:
    return "/".join(url.split("/", 3)[:3])


def rules_of(wanted: Collection[str], max_pages: int, fast: bool, *, options: CleanOptions | None = None, per_site: int = 3, sitemap_first: bool = False, respect_robots: bool = True) -> dict:
    """What a walk goes by. With options a fast crawl ends when their fields are met in their quality and region."""
    kinds = sorted(set(wanted) or (options.kinds if options else set()) or set(KINDS))
    fields = list(options.fields) if options else None
    if fields is not None:
        kinds = sorted({*kinds, *(kinds_of(fields) if not wanted else ())})
    return {"kinds": kinds, "fields": fields, "least": options.least_confidence if options else 0.0, "region": options.phone_region if options else "AUTO", "max_pages": max_pages, "fast": fast, "per_site": per_site, "sitemap_first": sitemap_first, "robots": respect_robots}


def walk_one(start: str, fetch: Callable[[str], dict | None], rules: dict, variants: list[str] | None = None) -> list[list[str]]:
    """The visits of one site, with a function in place of the store."""
    site = Walk(start, variants or [start], rules)
    while site.want:
        site.take({u.rstrip("/"): page for u in site.want if (page := fetch(u.rstrip("/"))) is not None})
    return site.s["visits"]


STATE = "site_key string, start string, state string, want array<string>"


def _states(batch: pa.RecordBatch, walks: list[Walk]) -> pa.RecordBatch:
    """Rows of STATE. Of a walk that has ended only the visits are kept."""
    states = [json.dumps(w.s if w.want else {"visits": w.s["visits"]}) for w in walks]
    return pa.RecordBatch.from_arrays([batch.column("site_key"), batch.column("start"), pa.array(states, pa.string()), pa.array([w.want for w in walks], pa.list_(pa.string()))], names=["site_key", "start", "state", "want"])


def _begin(rules: dict):
    def run(batches):
        for batch in batches:
            yield _states(batch, [Walk(s, v, rules) for s, v in zip(batch.column("start").to_pylist(), batch.column("variants").to_pylist())])

    return run


def _step(rules: dict):
    def run(batches):
        for batch in batches:
            walks = []
            for state, pages in zip(batch.column("state").to_pylist(), batch.column("pages").to_pylist()):
                site = Walk("", [], rules, json.loads(state))
                site.take({p["key"]: p for p in pages or []})
                walks.append(site)
            yield _states(batch, walks)

    return run


def walk(sites: DataFrame, facts: DataFrame, rules: dict, *, site: str = "url") -> DataFrame:
    """VISITS rows of every site. ``sites`` has normal home page URLs, ``facts`` is from ``read_pages``."""
    home = sites.select(urls.site_key(F.col(site)).alias("site_key"), F.col(site).alias("start"), urls.variants(F.col(site)).alias("variants"))
    # a walk is known by its start; equal ones are one walk
    state = cut(home.dropDuplicates(["start"]).mapInArrow(_begin(rules), STATE))
    done = []
    page = F.struct("key", "url", "shell", "links", "entries", "sitemaps", "rules", (F.coalesce("address", F.lit("")) != "").alias("address"), (F.coalesce("description", F.lit("")) != "").alias("description"), "found")
    # every round visits a page or ends a walk, but for the home page's and the sitemaps' rounds
    for _ in range(rules["max_pages"] + 3):
        done.append(state.where(F.size("want") == 0))
        active = state.where(F.size("want") > 0)
        if active.isEmpty():
            break
        # only addresses go to the facts, and only pages that are there come back; a state is moved once a round
        asked = active.select("start", F.explode("want").alias("ask")).select("start", page_key(F.col("ask")).alias("key"))
        answered = asked.join(facts, "key").groupBy("start").agg(F.collect_list(page).alias("pages"))
        state = cut(active.join(answered.hint("merge"), "start", "left").select("site_key", "start", "state", "pages").mapInArrow(_step(rules), STATE))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    seen = F.from_json(F.get_json_object("state", "$.visits"), "array<array<string>>")
    rows = out.select("site_key", F.posexplode(seen).alias("ordinal", "v"))
    return rows.select("site_key", "ordinal", *[F.col("v")[i].alias(n) for i, n in enumerate(("url", "status", "wanted", "found"))])


def crawl(sites: DataFrame, pages: DataFrame, *, wanted: Collection[str] = KINDS, max_pages: int = 6, fast: bool = True, sitemap_first: bool = False, options: CleanOptions | None = None, respect_robots: bool = True, default_region: str = "US", site: str = "url", url: str = "url", body: str = "html") -> DataFrame:
    """VISITS rows of every site. ``sites`` has a normal home page URL, ``pages`` normal URLs and bodies of usable pages."""
    rules = rules_of(wanted, max_pages, fast, options=options, sitemap_first=sitemap_first, respect_robots=respect_robots)
    facts, _ = read_pages(sites, pages, kinds=rules["kinds"], site=site, url=url, body=body, default_region=default_region)
    return walk(sites, facts, rules, site=site)


def allowed(pages: DataFrame, robots: DataFrame, *, url: str = "url", origin: str = "origin", body: str = "body") -> DataFrame:
    """The pages that their origin's robots file lets any agent fetch; an origin without a file allows all."""
    @F.pandas_udf("boolean")
    def ok(rules: pd.Series, target: pd.Series) -> pd.Series:
        known: dict[str, RobotFileParser] = {}

        def one(r, u):
            if r is None:
                return True
            if r not in known:
                known[r] = RobotFileParser()
                known[r].parse(r.splitlines())
            return known[r].can_fetch("*", u)

        return pd.Series([one(r, u) for r, u in zip(rules, target)], dtype=bool)

    files = robots.groupBy(F.col(origin).alias("__origin")).agg(F.min(body).alias("__rules"))
    joined = pages.withColumn("__origin", urls.origin(F.col(url))).join(files, "__origin", "left")
    return joined.where(ok("__rules", F.col(url))).drop("__origin", "__rules")


def pick_fetch(fetches: DataFrame, keys: Collection[str]) -> DataFrame:
    """The fetch to use of each key: the first usable by tier order, else the best by (usable, has a body, status, speed).

    ``fetches`` has tier_order, status, html, elapsed_ms.
    """
    status, body = F.coalesce("status", F.lit(0)), F.coalesce("html", F.lit(""))
    ok = html.usable(F.col("status"), body) & ~html.blocked(F.col("status"), body)
    order = F.struct(ok.alias("ok"), F.when(ok, -F.col("tier_order")).alias("t"), (body != "").alias("b"), status.alias("s"), (-F.coalesce("elapsed_ms", F.lit(0))).alias("e"), (-F.col("tier_order")).alias("o"))
    rest = [c for c in fetches.columns if c not in keys]
    return fetches.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("f")).select(*keys, *[F.col(f"f.{c}").alias(c) for c in rest])
