"""What a user may ask of a job, as one table of settings, and the values a plan is built from.

Every setting has its values, other spellings of them and a default. Spellings are compared by their letters and
digits only, so ``South Korea``, ``south-korea`` and ``SOUTH_KOREA`` are one. ``clean_options`` and
``plan_job`` read what was asked for once, on the driver, and give immutable records.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Mapping
from typing import NamedTuple

from ..functions import tables as K


def folded(spelling: object) -> str:
    return re.sub(r"[\W_]+", "", "" if spelling is None else str(spelling)).casefold()


class Setting(NamedTuple):
    #: What the setting is called in messages.
    label: str
    #: Each value with its other spellings; the first one is the default.
    values: Mapping[str, tuple[str, ...]]

    def read(self, spelling: object) -> str:
        """The value that a spelling stands for; nothing at all stands for the default."""
        wanted = folded(spelling)
        if not wanted:
            return next(iter(self.values))
        for value, others in self.values.items():
            if wanted in map(folded, (value, *others)):
                return value
        raise ValueError(f"{self.label} can't be {spelling!r}; possible are {', '.join(self.values)}")


def _plain(label: str, default: str, values: Iterable[str]) -> Setting:
    return Setting(label, {v: () for v in sorted(values, key=lambda v: v != default)})


# Settings of the clean export, their values and spellings.
SETTINGS = {
    "phone_region": Setting("the phone region", {"AUTO": ("auto detect",), "AU": ("aus", "australia"), "US": ("usa", "united states"), "IN": ("india",), "KR": ("korea", "south korea")}),
    "phone_format": Setting("the phone format", {"national": ("local", "domestic"), "international": ("intl", "global"), "e164": ()}),
    "phone_country_confidence": _plain("the phone country policy", "strict", ("strict", "balanced", "loose")),
    "email_preference": _plain("the e-mail preference", "business", K.EMAIL_CATEGORY_WEIGHTS),
    "fast_quality": _plain("the quality of a fast crawl", "balanced", K.QUALITY),
}
FIELD = Setting("a field of the clean export", {name: {"twitter_x": ("x", "twitter"), "description": ("company description",)}.get(name, ()) for name in K.CLEAN_LABELS})
# Evidence columns that follow a field.
EVIDENCE_COLUMNS = {"email": ("Email Source", "Email Confidence"), "phone": ("Phone Region", "Phone Type", "Phone Source", "Phone Confidence")}
# Kinds of evidence with their labels, in the order they are shown.
KIND_LABELS = {"email": "Emails", "phone": "Phones", "social": "Social profiles", "address": "Addresses", "description": "Descriptions"}


class CleanOptions(NamedTuple):
    """The clean export: fields in order, and one value of each setting. Made by ``clean_options``."""

    fields: tuple[str, ...]
    include_evidence: bool
    phone_region: str
    phone_format: str
    phone_country_confidence: str
    email_preference: str
    fast_quality: str

    @property
    def columns(self) -> list[str]:
        evidence = [c for f in EVIDENCE_COLUMNS if f in self.fields for c in EVIDENCE_COLUMNS[f]]
        return [*(K.CLEAN_LABELS[f] for f in self.fields), *([*evidence, "Review Note"] if self.include_evidence else [])]

    @property
    def least_confidence(self) -> float:
        """Confidence from which a fast crawl takes a field as found."""
        return K.QUALITY[self.fast_quality]

    @property
    def kinds(self) -> frozenset[str]:
        return kinds_of(self.fields)


def clean_options(fields: Iterable[str] = ("website", "email", "phone", "facebook"), *, include_evidence: bool = False, **settings: str) -> CleanOptions:
    """Reads field names and settings in any spelling; a ``ValueError`` names what can't be read."""
    if unknown := settings.keys() - SETTINGS.keys():
        raise ValueError(f"no such setting: {', '.join(sorted(unknown))}")
    asked = [f for f in fields if folded(f)]
    if not asked:
        raise ValueError("the clean export needs a field")
    return CleanOptions(tuple(dict.fromkeys(map(FIELD.read, asked))), include_evidence, **{name: s.read(settings.get(name)) for name, s in SETTINGS.items()})


def kinds_of(fields: Collection[str]) -> frozenset[str]:
    """Kinds of evidence behind fields; the website itself is none."""
    return frozenset("social" if f in K.SOCIAL_COLUMNS else f for f in fields if f != "website")


class Job(NamedTuple):
    """What a job does. Made by ``plan_job``."""

    kinds: frozenset[str]
    options: CleanOptions
    workers: int
    max_pages: int
    fast: bool
    respect_robots: bool
    #: Whether a fast crawl ends by the fields and quality of the options, or by kinds.
    by_fields: bool


def plan_job(kinds: Collection[str] = (), options: CleanOptions | None = None, *, workers: int = 40, max_pages: int = 6, fast: bool = True, respect_robots: bool = True, by_fields: bool | None = None) -> Job:
    """Kinds asked for and those behind the export's fields; 1 to 100 workers, 1 to 20 pages. With options given a fast crawl ends by their fields, unless said otherwise."""
    if unknown := set(kinds) - KIND_LABELS.keys():
        raise ValueError(f"no such kind: {', '.join(sorted(unknown))}")
    export = options or clean_options()
    return Job(export.kinds | frozenset(kinds), export, max(1, min(workers, 100)), max(1, min(max_pages, 20)), fast, respect_robots, options is not None if by_fields is None else by_fields)


def mode_label(kinds: Collection[str]) -> str:
    """Labels of the kinds in their order; all of them for none."""
    return ", ".join(label for kind, label in KIND_LABELS.items() if kind in kinds or not kinds)


def needed_kinds(selected: Collection[str], unmet_fields: Collection[str] | None) -> frozenset[str]:
    """Kinds that a fast crawl still looks for: all selected without fields, none if all fields are met, else those of the unmet fields, as far as selected."""
    if unmet_fields is None:
        return frozenset(selected)
    if not unmet_fields:
        return frozenset()
    return (kinds_of(unmet_fields) or frozenset(selected)) & frozenset(selected)
