"""Columns over the time fields of facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def effective(start: Column, mentioned: Column, end: Column) -> Column:
    return F.coalesce(start, mentioned, end)


def updated_within(updated: Column, after=None, before=None) -> Column:
    """Strictly inside the bounds that are given."""
    test = F.lit(True)
    if after is not None:
        test = test & (updated > after)
    if before is not None:
        test = test & (updated < before)
    return test


def overlaps(start: Column, end: Column, mentioned: Column, low: Column, high: Column) -> Column:
    """The event's range overlaps the window, or one of its times lies in it."""
    return F.coalesce((start <= high) & (end >= low), F.lit(False)) | F.coalesce(start.between(low, high), F.lit(False)) | F.coalesce(end.between(low, high), F.lit(False)) | F.coalesce(mentioned.between(low, high), F.lit(False))


def as_of(t: Column, cutoff: Column) -> Column:
    """Not later than the cutoff; undated rows stay."""
    return t.isNull() | (t <= cutoff)


def proximity(t: Column, low: Column, high: Column, undated: float = 0.5) -> Column:
    """1 at the middle of a window down to 0 at its ends; 1 for an empty window."""
    total = (micros(high) - micros(low)) / F.lit(float(DAY))
    middle = (micros(low) + micros(high)) / F.lit(2.0)
    away = F.abs(micros(t) - middle) / F.lit(float(DAY))
    return F.when(t.isNull(), undated).when(total <= 0, 1.0).otherwise(1.0 - F.least(away / (total / 2), F.lit(1.0)))


def recency(days: Column, function: str = "linear", window: float = 365.0, half_life: float = 90.0) -> Column:
    """Weight of an age in days; future ages count as 0."""
    days = F.greatest(days.cast("double"), F.lit(0.0))
    if function == "none":
        return F.lit(1.0)
    if function == "exponential":
        return F.pow(F.lit(0.5), days / half_life)
    return F.greatest(1.0 - days / window, F.lit(0.1))


def infer_offset(text: Column) -> Column:
    """Days from relative words, first match wins; null without one."""
    rules = ((r"\byesterday\b|\blast night\b", -1), (r"\btoday\b|\bthis morning\b|\btonight\b", 0), (r"\btomorrow\b", 1), (r"\blast week\b", -7), (r"\bnext week\b", 7), (r"\blast month\b", -30), (r"\bnext month\b", 30))
    out = F.lit(None).cast("int")
    for pattern, days in reversed(rules):
        out = F.when(F.lower(text).rlike(pattern), days).otherwise(out)
    return out
