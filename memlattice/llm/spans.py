"""Places of pattern matches as native array expressions.

``split`` gives what stands between the matches that ``regexp_extract_all`` gives, so
lengths of both, alternating, add up to the places.  Places count code points.  Sums
over an array are made block by block, so that a text of very many matches does not
copy a growing array for each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,match:string>>"
NONE = f"cast(array() as {SPAN})"
INTS = "cast(array() as array<int>)"


def _scan(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` gives over the values before each; for short arrays."""
    state = F.struct(start.alias("at"), F.expr(INTS).alias("found"))
    return F.aggregate(values, state, lambda s, v: F.struct(step(s["at"], v).alias("at"), F.concat(s["found"], F.array(s["at"])).alias("found")), lambda s: s["found"])


def scanned(values: str, step: Callable[[Column, Column], Column]) -> Column:
    """For a settled column of integer arrays: 0 and what an associative ``step`` (sum, greatest) gives over the values before each.

    Blocks of about the root of the length are scanned by themselves from the totals
    of the blocks before, so n values cost about n times the root of n.
    """
    zero, n = F.lit(0), F.size(values)
    width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(zero, F.floor((n - 1) / width).cast("int")), lambda b: F.slice(values, b * width + 1, width))
    totals = F.transform(blocks, lambda block: F.aggregate(block, zero, step))
    return F.when(n > 0, F.flatten(F.zip_with(blocks, _scan(totals, zero, step), lambda block, start: _scan(block, start, step))))


def lengths(between: Column, matches: Column) -> Column:
    """The length of each match and what stands before it; both arguments are columns of arrays."""
    # Both arrays are arguments, not free in the lambda: an optimizer that inlines them there would split the text for each match.
    pairs = F.zip_with(between, matches, lambda gap, match: F.length(gap) + F.length(match))
    return F.slice(pairs, 1, F.size(matches))


def contexts(between: Column, matches: str, most: int) -> Column:
    """The last ``most`` characters before each match, as far back as the match before it."""
    end = lambda gap, k: F.right(F.concat(F.coalesce(F.get(matches, k - 1), F.lit("")), gap), F.lit(most))
    return F.slice(F.transform(between, end), 1, F.size(matches))


def places(lengths: str, matches: str) -> Column:
    """``start``, ``end`` and ``match`` of every match, in order, from settled columns."""
    upto = F.zip_with(scanned(lengths, lambda a, b: a + b), lengths, lambda before, own: before + own)
    return F.zip_with(upto, matches, lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match")))


def labelled(spans: Column, k: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def of_kind(spans: Column | str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def joined(kinds: Sequence[tuple[str, Column]], order: str) -> Column:
    """``kind:start:end`` of all spans, comma-joined: by kind as given ("kind"), or by start and then kind ("start")."""
    every = F.concat(*(labelled(spans, k, name) for k, (name, spans) in enumerate(kinds)))
    if order == "kind":
        every = F.transform(every, lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
