"""Limits of scopes by rules of tag globs: which rule covers a scope exactly, and whether there is room.

Globs are looked up by what they begin or end with, so tags meet the globs that may fit
them and not all of them; a rule is asked for only where its rarest glob fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPECIAL = r"[*?\[]"


def glob_pattern(glob: Column) -> Column:
    """A glob as a regular expression of the whole tag: ``*``, ``?``, ``[seq]`` and ``[!seq]``, case-sensitive; an unclosed ``[`` is itself."""
    parts = F.regexp_extract_all(glob, F.lit(r"\[!?\]?[^\]]*\]|\*|\?|[\s\S]"), F.lit(0))

    def one(p: Column) -> Column:
        inside = F.regexp_replace(F.substring(p, F.lit(2), F.length(p) - 2), r"([\\\[\]&~|^])", r"\\$1")
        negated = F.startswith(p, F.lit("[!"))
        body = F.when(negated, F.concat(F.lit("^"), F.substring(inside, F.lit(2), F.length(inside)))).otherwise(inside)
        return (
            F.when(p == "*", F.lit(r"[\s\S]*")).when(p == "?", F.lit(r"[\s\S]")).when((F.length(p) > 2) & F.startswith(p, F.lit("[")), F.concat(F.lit("["), body, F.lit("]")))
            .otherwise(F.regexp_replace(p, r"([^A-Za-z0-9_\s])", r"\\$1"))
        )

    return F.concat(F.lit("^"), F.array_join(F.transform(parts, one), ""), F.lit("$"))


def fits(tags: DataFrame, globs: DataFrame) -> DataFrame:
    """``tag``, ``glob`` for each distinct tag and each distinct glob that fits it.

    A glob is filed under its longer literal end; a tag asks for its ends of the lengths
    there are.  A glob with a wildcard at either end of nothing else meets every tag.
    """
    glob = globs.select("glob").where(F.length("glob") > 0).distinct()
    front, back = F.regexp_extract("glob", rf"^((?:(?!{_SPECIAL})[\s\S])*)", 1), F.regexp_extract("glob", r"([^*?\[\]]*)$", 1)
    front_first = F.length(front) >= F.length(back)
    filed = glob.select("glob", glob_pattern(F.col("glob")).alias("_pattern"), front_first.alias("_front"), F.when(front_first, front).otherwise(back).alias("_end"))
    lengths = filed.select("_front", F.length("_end").alias("_n")).distinct()
    asked = tags.select("tag").distinct().join(F.broadcast(lengths), F.length("tag") >= F.col("_n"))  # a row a length of a glob's end
    end = F.when(F.col("_front"), F.substring("tag", F.lit(1), F.col("_n"))).otherwise(F.expr("right(tag, _n)"))
    asked = asked.select("tag", "_front", end.alias("_end"))
    return asked.join(filed, ["_front", "_end"]).where(F.expr("tag rlike _pattern")).select("tag", "glob")


def covering_rules(scopes: DataFrame, rules: DataFrame) -> DataFrame:
    """``scope``, ``rule_id``, ``limit``: for each distinct scope the first rule that covers it exactly, if any.

    ``scopes`` has ``scope`` (array of tags).  ``rules`` has ``rule_id`` (their order),
    ``globs`` and ``limit``; rules without globs, with an empty or null one, or without
    a limit are none.  Exact cover: every tag fits a glob of the rule and every glob
    fits a tag.  The empty scope is covered by no rule.
    """
    distinct = scopes.select(F.array_sort(F.array_distinct(F.filter("scope", lambda t: t.isNotNull()))).alias("scope")).where(F.size("scope") > 0).distinct()
    good = rules.where((F.size("globs") > 0) & F.col("limit").isNotNull() & ~F.exists("globs", lambda g: g.isNull() | (g == ""))).select("rule_id", F.array_distinct("globs").alias("globs"), "limit")
    each_tag, each_glob = distinct.select("scope", F.explode("scope").alias("tag")), good.select("rule_id", F.explode("globs").alias("glob"))
    pairs = fits(each_tag, each_glob)
    held = each_tag.join(pairs, "tag").groupBy("scope", "tag").agg(F.collect_list("glob").alias("fitting"))  # globs that fit one tag
    held = held.groupBy("scope").agg(F.collect_list("fitting").alias("fitting")).where(F.size("fitting") == F.size("scope"))
    rarity = pairs.groupBy("glob").agg(F.count("*").alias("n"))
    anchor = each_glob.join(rarity, "glob").groupBy("rule_id").agg(F.min_by("glob", F.struct("n", "glob")).alias("glob"))
    candidates = each_tag.join(pairs, "tag").join(anchor, "glob").select("scope", "rule_id").distinct()
    both = candidates.join(held, "scope").join(good, "rule_id")
    covered = F.forall("fitting", lambda f: F.arrays_overlap(f, F.col("globs"))) & (F.size(F.array_except("globs", F.flatten("fitting"))) == 0)
    return both.where(covered).groupBy("scope").agg(F.min_by("limit", "rule_id").alias("limit"), F.min("rule_id").alias("rule_id")).select("scope", "rule_id", "limit")


def counts(scopes: DataFrame, observations: DataFrame) -> DataFrame:
    """``scope``, ``n``: observations (column ``tags``) that hold all tags of each distinct scope; untagged ones count nowhere.

    Scopes are looked up by the tag that fewest observations hold.
    """
    distinct = scopes.select(F.array_sort(F.array_distinct(F.filter("scope", lambda t: t.isNotNull()))).alias("scope")).where(F.size("scope") > 0).distinct()
    each = observations.select(F.monotonically_increasing_id().alias("_o"), "tags").select("tags", F.explode(F.array_distinct("tags")).alias("tag"))
    frequent = each.groupBy("tag").agg(F.count("*").alias("n"))
    anchored = distinct.select("scope", F.explode("scope").alias("tag")).join(frequent, "tag", "left").groupBy("scope").agg(F.min_by("tag", F.struct(F.coalesce("n", F.lit(0)), "tag")).alias("tag"))
    hit = each.join(anchored, "tag").where(F.size(F.array_except("scope", "tags")) == 0).groupBy("scope").agg(F.count("*").alias("n"))
    return distinct.join(hit, "scope", "left").select("scope", F.coalesce("n", F.lit(0)).alias("n"))


def room(scopes: DataFrame, rules: DataFrame, observations: DataFrame, default: int = -1) -> DataFrame:
    """``scope``, ``rule_id``, ``limit``, ``n``, ``room`` of each distinct tagged scope: how many observations it may still get.

    Without a covering rule ``default`` is the limit; a negative limit is none, and
    ``room`` is then null.
    """
    counted = counts(scopes, observations).join(covering_rules(scopes, rules), "scope", "left")
    limit = F.coalesce("limit", F.lit(default))
    return counted.select("scope", "rule_id", limit.alias("limit"), "n", F.when(limit >= 0, F.greatest(limit - F.col("n"), F.lit(0))).cast("long").alias("room"))
