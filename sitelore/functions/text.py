"""Text functions on columns: white space, joins, names and their tokens, durations."""

from __future__ import annotations

import html
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as K
from .udf import TEXT, REAL, arrow


def clean(text: Column) -> Column:
    """One space for each stretch of white space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def compact(text: str | None, limit: int = 500) -> str:
    return " ".join(html.unescape(text or "").split())[:limit]


@arrow(TEXT)
def compacted(text: pd.Series) -> pd.Series:
    return pd.Series([compact(x) for x in text], dtype=object)


def unquote(text: Column) -> Column:
    """Percent decoding that keeps +; what isn't valid stays as it is."""
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)).otherwise(text)


def joined(values: Column, mark: str = "; ") -> Column:
    """Distinct values that aren't empty, in order."""
    return F.array_join(F.array_distinct(F.filter(values, lambda x: x != "")), mark)


def first(values: Column) -> Column:
    return F.coalesce(F.get(F.filter(values, lambda x: x != ""), F.lit(0)), F.lit(""))


def note(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def duration(seconds: Column) -> Column:
    """--, 12s, 3m 04s or 1h 02m."""
    s = F.floor(seconds)
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return (
        F.when(seconds.isNull(), "--")
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m "), two(s % 60), F.lit("s")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h "), two(minutes % 60), F.lit("m")))
    )


@arrow(TEXT)
def two_decimals(value: pd.Series) -> pd.Series:
    """Exactly rounded, half to even on the binary value; the built-in format rounds halves up."""
    return pd.Series([None if pd.isna(x) else f"{x:.2f}" for x in value], dtype=object)


def tokens(text: Column) -> Column:
    """Words of a name without legal forms and single letters."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*K.LEGAL_SUFFIXES))


def signature(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def overlap(left: Column, right: Column) -> Column:
    """Share of the distinct tokens on the left that are on the right, too."""
    a, b = F.array_distinct(left), F.array_distinct(right)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


@arrow(REAL)
def matched(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two signatures, in this order and with the usual treatment of popular letters."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for a, b in zip(left, right):
        if (a, b) not in known:
            known[a, b] = SequenceMatcher(None, a or "", b or "").ratio()
        out.append(known[a, b])
    return pd.Series(out, dtype=float)


def _closest(own: str, others) -> float:
    """Highest token similarity of a signature to any of others; a ratio is only worked out where its bound could be the highest."""
    best, words = 0.0, set(own.split())
    if words:
        for other in sorted({x for x in others if x}, key=lambda x: (-len(words.intersection(x.split())), x)):
            shared = 0.65 * len(words.intersection(other.split())) / len(words)
            if shared + 0.35 * 2 * min(len(own), len(other)) / (len(own) + len(other)) > best:
                pair = SequenceMatcher(None, own, other)
                if shared + 0.35 * pair.quick_ratio() > best:
                    best = max(best, shared + 0.35 * pair.ratio())
    return best


@arrow(REAL)
def closest(own: pd.Series, others: pd.Series) -> pd.Series:
    """For each signature its similarity to the most similar of a list of signatures; 0 for an empty one or an empty list."""
    return pd.Series([_closest(a or "", b if b is not None else ()) for a, b in zip(own, others)], dtype=float)


def token_similarity(left: Column, right: Column) -> Column:
    """Weighted token overlap and letter ratio of two token lists; 0 if either is empty. Not symmetric."""
    a, b = F.array_join(left, " "), F.array_join(right, " ")
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(0.65 * overlap(left, right) + 0.35 * matched(a, b))


def similarity(left: Column, right: Column) -> Column:
    return token_similarity(tokens(left), tokens(right))


def search_query(company: Column, location: Column) -> Column:
    name = F.trim(F.replace(F.coalesce(company, F.lit("")), F.lit('"'), F.lit(" ")))
    parts = F.array(F.when(name != "", F.concat(F.lit('"'), name, F.lit('"'))).otherwise(""), F.coalesce(location, F.lit("")), F.lit('"official website"'), *[F.lit(f"-site:{h}") for h in K.SEARCH_EXCLUDED])
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")
