"""Predicates over tag arrays, and trees of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _array(tags: Sequence[str]) -> Column:
    return F.array(*(F.lit(t) for t in tags)).cast("array<string>")


def untagged(column: Column) -> Column:
    return column.isNull() | (F.size(column) == 0)


def match(column: Column, tags: Sequence[str] | None, mode: str = "any") -> Column:
    """Whether a tag array matches ``tags``; never null.

    ``any`` and ``all`` let untagged rows pass, ``any_strict`` and ``all_strict`` do
    not; ``exact`` compares as sets, and without tags keeps untagged rows only.  In
    every other mode no tags mean no filter.
    """
    tags = list(dict.fromkeys(tags or []))
    if not tags:
        return untagged(column) if mode == "exact" else F.lit(True)
    wanted, held = _array(tags), F.coalesce(column, F.array().cast("array<string>"))
    overlap, superset = F.arrays_overlap(held, wanted), F.size(F.array_except(wanted, held)) == 0
    found = {
        "any": untagged(column) | overlap,
        "all": untagged(column) | superset,
        "any_strict": overlap,
        "all_strict": superset,
        "exact": superset & (F.size(F.array_except(held, wanted)) == 0),
    }
    return F.coalesce(found[mode], F.lit(False))


def group(column: Column, node: Mapping) -> Column:
    """A tree of ``{"tags": [...], "match": mode}`` leaves (``any_strict`` unless said), ``and``, ``or`` and ``not``."""
    if "and" in node:
        return reduce(Column.__and__, (group(column, n) for n in node["and"]), F.lit(True))
    if "or" in node:
        return reduce(Column.__or__, (group(column, n) for n in node["or"]), F.lit(False))
    if "not" in node:
        return ~group(column, node["not"])
    return match(column, node["tags"], node.get("match", "any_strict"))


def groups(column: Column, nodes: Sequence[Mapping]) -> Column:
    """All trees hold."""
    return group(column, {"and": list(nodes)})


def scope_cover(column: Column, globs: Sequence[str]) -> Column:
    """Every tag fits some glob and every glob fits some tag."""
    patterns = [_glob(g) for g in globs]
    held = F.coalesce(column, F.array().cast("array<string>"))
    each = F.forall(held, lambda t: reduce(Column.__or__, (t.rlike(p) for p in patterns), F.lit(False)))
    return reduce(Column.__and__, (_some(held, p) for p in patterns), each)


def _some(held: Column, pattern: str) -> Column:
    return F.exists(held, lambda t: t.rlike(pattern))


def _glob(pattern: str) -> str:
    special = {"*": ".*", "?": "."}
    return "^" + "".join(special.get(c) or (c if c.isalnum() else "\\" + c) for c in pattern) + "$"
