"""Ranking of sub-pages: keyword weights by what is wanted, guessed paths, top k per site."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as K
from ..functions import urls
from .page import KINDS


def weights(wanted: Collection[str]) -> dict[str, int]:
    """Weight of each word for the kinds wanted; later tables replace earlier ones, the social floor only raises."""
    wanted = set(wanted) or set(KINDS)
    out = dict(K.RANK_BASE)
    if wanted & {"email", "phone", "address"}:
        out |= K.RANK_CONTACT
    if "description" in wanted:
        out |= K.RANK_DESCRIPTION
    if "social" in wanted:
        out |= {w: max(out.get(w, 0), n) for w, n in K.RANK_SOCIAL_LEAST.items()} | K.RANK_SOCIAL
    return out


def guesses(wanted: Collection[str]) -> dict[str, int]:
    wanted = set(wanted) or set(KINDS)
    out: dict[str, int] = {}
    if wanted & {"email", "phone", "social", "address"}:
        out |= K.GUESSED_CONTACT
    if wanted & {"description", "social"}:
        out |= K.GUESSED_ABOUT
    return out or dict(K.GUESSED_OTHER)


def score(path: Column, text: Column, wanted: Collection[str] = ()) -> Column:
    """Weight of the best word, less 80 for each negative word and 3 for each level."""
    hay = F.lower(F.concat_ws(" ", path, text))
    best = F.greatest(*[F.when(hay.contains(w), F.lit(n)).otherwise(0) for w, n in weights(wanted).items()])
    minus = sum((F.when(hay.contains(w), F.lit(80)).otherwise(0) for w in K.RANK_NEGATIVE), F.lit(0))
    depth = F.size(F.filter(F.split(path, "/"), lambda x: x != ""))
    return best - minus - 3 * depth


def rank_subpages(links: DataFrame, sites: DataFrame, keys: Collection[str], *, limit: int, wanted: Collection[str] = (), link: str = "link", text: str = "text", base: str = "base_url") -> DataFrame:
    """(keys, rank, url, score): the best ``limit`` pages to fetch of each site.

    ``sites`` has keys and base URL: every site gets its guessed paths. The limit is a rank filter, which Spark
    applies before the shuffle, too.
    """
    keys = list(keys)
    scored = links.select(*keys, F.col(link).alias("url"), score(urls.path(F.col(link)), F.coalesce(text, F.lit("")), wanted).alias("score")).where("score > 0")
    paths = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("n")) for p, n in guesses(wanted).items()]))
    guessed = sites.select(*keys, F.col(base).alias("b"), paths.alias("g")).select(*keys, F.concat(F.rtrim(F.col("b"), F.lit("/")), F.col("g.p")).alias("url"), F.col("g.n").alias("score"))
    best = scored.unionByName(guessed).groupBy(*keys, "url").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "url")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(*keys, "rank", "url", "score")


def rank_list(found: list[tuple[str, str]], base: str, limit: int, wanted: Collection[str] = ()) -> list[str]:
    """The same ranking of one site's links, for the crawl loop."""
    words = weights(wanted)
    best: dict[str, int] = {base.rstrip("/") + p: n for p, n in guesses(wanted).items()}
    for url, text in found:
        path = "/" + url.split("://", 1)[-1].partition("/")[2].partition("?")[0]
        hay = f"{path} {text}".lower()
        n = max((v for w, v in words.items() if w in hay), default=0) - 80 * sum(w in hay for w in K.RANK_NEGATIVE) - 3 * sum(bool(x) for x in path.split("/"))
        if n > 0:
            best[url] = max(best.get(url, 0), n)
    return sorted(best, key=lambda u: (-best[u], u))[:limit]


def sitemap_links(texts: DataFrame, keys: Collection[str], *, body: str = "html", origin: str = "origin", limit: int = 500) -> DataFrame:
    """(keys, pos, link): page addresses out of sitemap bodies that begin with the site's origin, the first ``limit`` of each body."""
    found = F.slice(F.regexp_extract_all(body, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)), 1, limit)
    rows = texts.select(*keys, F.col(origin).alias("__o"), F.posexplode(found).alias("pos", "link"))
    return rows.where(F.col("link").startswith(F.col("__o"))).drop("__o")


def sitemaps_of_robots(texts: DataFrame, keys: Collection[str], *, body: str = "html", limit: int = 4) -> DataFrame:
    """(keys, sitemap): sitemap addresses in robots files with the two usual ones, sorted, the first ``limit``."""
    named = F.regexp_extract_all(body, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    usual = F.array(*[F.concat(F.col("origin"), F.lit(p)) for p in ("/sitemap.xml", "/sitemap_index.xml")])
    return texts.select(*keys, F.explode(F.slice(F.sort_array(F.array_distinct(F.concat(usual, named))), 1, limit)).alias("sitemap"))
