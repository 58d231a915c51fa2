"""Boolean expressions for listing filters and data-quality tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentscope.operators.scale import all_of, any_of

# Labels of page controls that are not plan names.
CONTROL_LABELS = (
    "favorite", "available", "available now", "view details", "view detail", "tour", "tour now",
    "schedule tour", "select", "see details", "apply now", "contact", "share", "save", "compare",
    "hide", "show more", "schedule", "inquire", "unit",
)
# Names counted as unclean by the quality report (exact case).
UNCLEAN_NAMES = ("Unit", "Favorite", "Tour", "Tour Now", "Available Now", "View Details", "Select", "Share", "Save", "")
# Names listed as suspicious (case-folded).
SUSPICIOUS_NAMES = (
    "favorite", "tour", "tour now", "view details", "available", "available now", "select", "share",
    "save", "unit", "schedule tour", "apply now", "contact", "compare", "hide", "show more", "schedule",
    "inquire", "see details",
)
# Names counted as unclean by the per-apartment coverage (case-folded).
COVERAGE_BAD_NAMES = (
    "unit", "favorite", "tour", "tour now", "view details", "available", "available now", "select",
    "share", "save", "",
)
# Words that mark a neighbouring property's name.
SIBLING_WORDS = (
    "village", "creek", "terrace", "plaza", "heights", "park", "ridge", "court", "place", "gardens",
    "estates", "hills", "commons", "manor", "lake", "pointe", "apartments", "playa", "marina",
)
# Fixed patterns.
PLAN_CODE = r"^[A-Z]\d|^\d[xX]\d|^[Ss]tudio\b|^[Pp]lan\s"
PLAN_NAME = r"^[A-Za-z][A-Za-z0-9\s\-\/\.]{1,40}$"
NOT_PLAN_PREFIX = (
    r"(?i)^(?:available|request|schedule|view|see|apply|contact|tour|select|inquire|share|save|compare|hide|show)\b"
)
UNIT_NUMBER = r"^[A-Z]\d{3,}$"
GENERIC_NAME = r"(?i)^\s*(?:studio|\d+)\s*(?:bed)?(?:room)?s?\s*[/\-]\s*\d+\s*bath"
GENERIC_NAME_CLIENT = r"(?i)^(Studio|\d+\s*Bed(room)?s?)\s*[/\-]\s*\d+(\.\d+)?\s*Bath"
INCOME_TITLE = (
    r"(?i)housing authority|affordable housing|community development corp|habitat for humanity|public housing"
)
INCOME_PLAN = r"(?i)\bami\b|\d+%\s*ami|area median income|income.restricted|income.qualified|lihtc|section 8"
# Bounds of plausible monthly rent.
RENT_FLOOR, RENT_CEILING = 1500, 25_000
# Extractors that read single-listing pages only.
DETAIL_PAGE_ADAPTERS = ("jonah_digital",)
# Outcome classes.
SUCCESS_OUTCOMES = ("success", "content_unchanged", "cache_hit", "platform_direct")
FAILURE_OUTCOMES = ("validated_fail", "hard_fail")
DIRECT_OUTCOMES = ("platform_direct", "platform_direct_static", "platform_direct_rendered")


def contains_ci(col: Column, text: str) -> Column:
    return col.ilike(f"%{text}%")


def not_contains_ci(col: Column, text: str) -> Column:
    return ~col.ilike(f"%{text}%")


def equals_ci(col: Column, text: str | Column) -> Column:
    other = text if isinstance(text, Column) else F.lit(text)
    return F.lower(col) == F.lower(other)


def is_bool(col: Column, value: bool) -> Column:
    """IS TRUE / IS FALSE: an unknown value matches neither."""
    return col.eqNullSafe(F.lit(value))


def in_range(col: Column, low=None, high=None) -> Column:
    tests = [] if low is None else [col >= low]
    return all_of(tests + ([] if high is None else [col <= high]))


def not_value_or_null(col: Column, value: str) -> Column:
    return (col != value) | col.isNull()


def like_any(col: Column, patterns: Sequence[str]) -> Column:
    return any_of([col.ilike(p) for p in patterns])


def mentions_any(col: Column, words: Sequence[str]) -> Column:
    """Plain substring test for any of ``words`` on lower-cased text."""
    return any_of([F.lower(col).contains(w) for w in words])


def stale_or_missing(ts: Column, cutoff: Column) -> Column:
    return ts.isNull() | (ts < cutoff)


def at_least(col: Column, k) -> Column:
    return F.coalesce(col, F.lit(0)) >= k


def looks_like_sibling(name: Column) -> Column:
    """A multi-word name with a property word that is not a plan code."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    return F.coalesce(
        (F.length(name) >= 5) & (F.size(words) >= 2) & ~name.rlike(PLAN_CODE) & mentions_any(name, SIBLING_WORDS),
        F.lit(False),
    )


def valid_plan_name(name: Column) -> Column:
    return (
        name.rlike(PLAN_NAME) & ~name.rlike(NOT_PLAN_PREFIX) & ~name.rlike(UNIT_NUMBER)
        & ~F.lower(name).isin(*CONTROL_LABELS)
    )


def plausible_rent(price: Column, low: float, high: float) -> Column:
    return price.between(low, high)


def outcome_class(outcome: Column) -> Column:
    """success / failure / neither; the static and rendered direct outcomes count as neither."""
    return (
        F.when(outcome.isin(*SUCCESS_OUTCOMES), "success")
        .when(outcome.isin(*FAILURE_OUTCOMES), "failure")
        .otherwise("neither")
    )
