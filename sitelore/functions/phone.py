"""Phone numbers by a reduced numbering plan.

Regions: US (with the other countries of +1), AU, IN, KR. A number of any other country is not accepted. The plan has
lengths, leading digits, types and national formats, no list of assigned ranges, so it accepts a few numbers that full
metadata would reject.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as K
from .email import lookup, mentions
from .udf import TEXT, arrow, struct


@dataclass(frozen=True)
class Range:
    pattern: str
    kind: str
    #: Sizes of the digit groups and how they are written nationally and internationally; {0} is the first group.
    groups: tuple[int, ...]
    national: str
    international: str


@dataclass(frozen=True)
class Plan:
    region: str
    code: str
    trunk: str
    ranges: tuple[Range, ...]


# Numbering plans.
PLANS = (
    Plan("US", "1", "1", (Range(r"8(?:00|33|44|55|66|77|88)[2-9]\d{6}", "TOLL_FREE", (3, 3, 4), "({0}) {1}-{2}", "{0}-{1}-{2}"), Range(r"900[2-9]\d{6}", "PREMIUM_RATE", (3, 3, 4), "({0}) {1}-{2}", "{0}-{1}-{2}"), Range(r"[2-9](?!11)[0-8]\d[2-9](?!11)\d{6}", "FIXED_LINE_OR_MOBILE", (3, 3, 4), "({0}) {1}-{2}", "{0}-{1}-{2}"))),
    Plan("AU", "61", "0", (Range(r"4\d{8}", "MOBILE", (3, 3, 3), "0{0} {1} {2}", "{0} {1} {2}"), Range(r"[2378]\d{8}", "FIXED_LINE", (1, 4, 4), "(0{0}) {1} {2}", "{0} {1} {2}"), Range(r"1800\d{6}", "TOLL_FREE", (4, 3, 3), "{0} {1} {2}", "{0} {1} {2}"), Range(r"1300\d{6}", "SHARED_COST", (4, 3, 3), "{0} {1} {2}", "{0} {1} {2}"))),
    Plan("IN", "91", "0", (Range(r"[6-9]\d{9}", "MOBILE", (5, 5), "0{0} {1}", "{0} {1}"), Range(r"(?:11|2[02]|33|4[04]|79|80)[2-7]\d{7}", "FIXED_LINE", (2, 4, 4), "0{0} {1} {2}", "{0} {1} {2}"), Range(r"1800\d{6,7}", "TOLL_FREE", (4, 3, 4), "{0} {1} {2}", "{0} {1} {2}"))),
    Plan("KR", "82", "0", (Range(r"10[2-9]\d{7}", "MOBILE", (2, 4, 4), "0{0}-{1}-{2}", "{0}-{1}-{2}"), Range(r"2[2-9]\d{7}", "FIXED_LINE", (1, 4, 4), "0{0}-{1}-{2}", "{0}-{1}-{2}"), Range(r"2[2-9]\d{6}", "FIXED_LINE", (1, 3, 4), "0{0}-{1}-{2}", "{0}-{1}-{2}"), Range(r"(?:3[1-3]|4[1-4]|5[1-5]|6[1-4])[2-9]\d{6,7}", "FIXED_LINE", (2, 3, 5), "0{0}-{1}-{2}", "{0}-{1}-{2}"))),
)
BY_REGION = {p.region: p for p in PLANS}
_EXTENSION = re.compile(r"\s*(?:x|ext\.?|extension)\s*\d{1,6}\s*$", re.I)


def _written(digits: str, r: Range, style: str) -> str:
    parts, at = [], 0
    for n in r.groups[:-1]:
        parts.append(digits[at : at + n])
        at += n
    return getattr(r, style).format(*parts, digits[at:])


def read(raw: str | None, region: str) -> tuple[Plan, Range, str] | None:
    """(plan, range, national digits) of a number that is valid, or None."""
    text = _EXTENSION.sub("", " ".join((raw or "").split()).strip(" .,;"))
    if not re.fullmatch(r"\+?[\d\s().\-/]+", text):
        return None
    digits = re.sub(r"\D", "", text)
    tries = []
    if text.startswith("+"):
        tries = [(p, digits[len(p.code) :]) for p in PLANS if digits.startswith(p.code)]
    elif region in BY_REGION:
        p = BY_REGION[region]
        tries = [(p, digits)]
        if digits.startswith(p.trunk):
            tries.append((p, digits[len(p.trunk) :]))
        if digits.startswith(p.code):
            tries.append((p, digits[len(p.code) :]))
    for p, national in tries:
        if text.startswith("+") and national.startswith("0") and p.trunk == "0":
            national = national[1:]
        for r in p.ranges:
            if re.fullmatch(r.pattern, national) and not re.fullmatch(r"(\d)\1{6,}", national):
                return p, r, national
    return None


def normal(raw: str | None, region: str) -> tuple[str, str, str] | None:
    """(E.164 form, region, type)."""
    got = read(raw, region)
    return (f"+{got[0].code}{got[2]}", got[0].region, got[1].kind) if got else None


def shown(raw: str | None, region: str, style: str) -> tuple[str, str, str]:
    """(text, region, type) in a style of the clean export; empty if it isn't valid or of another region than asked for ("AUTO": any)."""
    got = read(raw, "US" if region == "AUTO" else region)
    if not got or (region != "AUTO" and got[0].region != region):
        return "", "", ""
    p, r, digits = got
    text = {"e164": f"+{p.code}{digits}", "international": f"+{p.code} {_written(digits, r, 'international')}", "national": _written(digits, r, "national")}[style]
    return text, p.region, r.kind.replace("_", " ").title()


@arrow(struct(value=TEXT, region=TEXT, type=TEXT))
def _normalized(raw: pd.Series, region: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([normal(x, r) or (None, None, None) for x, r in zip(raw, region)], columns=["value", "region", "type"], dtype=object)


#: Non-deterministic only for the planner: a filter on the result must not run it a second time.
normalized = _normalized.asNondeterministic()


def formatted(region: str = "AUTO", style: str = "national"):
    @arrow(struct(text=TEXT, region=TEXT, type=TEXT))
    def run(value: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shown(x, region, style) for x in value], columns=["text", "region", "type"], dtype=object)

    return run


def candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?iU){K.PHONE_PATTERN}"), F.lit(0))


def confidence(source: Column, page_url: Column) -> Column:
    page = F.when(mentions(page_url, ("contact", "support")), F.lit(0.01)).otherwise(F.lit(0.0))
    return F.least(lookup(K.PHONE_SOURCES, source, 0.72) + page, F.lit(0.99))


def score(contact: Column, region: Column, wanted: str = "AUTO", policy: str = "strict") -> Column:
    out = contact["confidence"] * 0.70 + lookup(K.PHONE_SOURCE_WEIGHTS, contact["source_type"], 0.0)
    if wanted != "AUTO":
        out = out + F.when(region == wanted, 0.14).otherwise(-0.30 if policy == "strict" else 0.0)
    return out + lookup(K.PHONE_TYPE_WEIGHTS, F.coalesce(contact["meta"]["type"], F.lit("")), 0.0)
