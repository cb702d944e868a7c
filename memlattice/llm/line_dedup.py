"""Repeated passages, as content-defined chunks of lines.

A rolling hash over every two line hashes in a row names the gap between two lines, so
what is decided there depends on these two lines alone and no line before or behind
shifts it.  Lines joined by gaps that are met more than once are a run; so are those
among them joined by gaps that are met in more than half the places of either line,
which leave a frequent line out.  Both kinds of runs are cut in two further ways: where
the rolling hash hits one value in ``ROLLING``, and where a gap is met another number of
times than the one before, so that shortened and lengthened copies share chunks.

A run goes if an earlier place holds the same lines whole as a chunk, and so does a
chunk of a run that stays; nothing is put together from several places.  A chunk has two
lines or more, or is one line of ``LONG_LINE`` words.  Empty lines do not count.  What
goes is compared byte by byte with what stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm.common import guarded, materialized, settled

#: Words from which one line is a passage by itself.
LONG_LINE = 50
#: One of so many values of the rolling hash cuts a run.
ROLLING = 8


def line_pairs(docs: DataFrame, long_line: int = LONG_LINE) -> DataFrame:
    """Lines that are not empty: ``doc_id``, ``_text`` (hash of the text), ``i``, ``pos``, ``h``, ``long``, and the hash ``nh`` of the next one.

    Rows equal in doc_id and text are one document.
    """
    is_long = lambda x: F.when(F.length(x) >= 2 * long_line - 1, F.regexp_count(x, F.lit(r"[^ \t-\r]+")) >= long_line).otherwise(False)
    line = lambda x: F.struct(F.xxhash64(x).alias("h"), is_long(x).alias("long"), (x == "").alias("empty"))
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("_text"), F.filter(F.transform(F.split("text", "\n", -1), line), lambda x: ~x["empty"]).alias("_lines"))
    # The hash stands for the text here; that of the lines tells apart what a clash would join.
    texts = texts.withColumn("_key", F.xxhash64("_lines")).dropDuplicates(["doc_id", "_text", "_key"]).drop("_key")
    lines = texts.select("doc_id", "_text", "_lines", F.posexplode("_lines").alias("i", "l"))
    return lines.select("doc_id", "_text", "i", "l.h", "l.long", F.get("_lines", F.col("i") + 1)["h"].alias("nh"))


def _together(lines: DataFrame) -> DataFrame:
    """``h``, ``nh``, ``both``, ``most``, ``cut``: repeated pairs, how often they are met, whether that is in most places of either line, and whether the rolling hash cuts there nevertheless."""
    # Tables of their own, so that a frequent line is summed where it is and its join can be split.
    single = materialized(lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "lines-counted")
    pairs = lines.where("nh is not null").groupBy("h", "nh").agg(F.count("*").alias("both")).where("both > 1")
    pairs = pairs.join(single, "h").join(single.select(F.col("h").alias("nh"), F.col("n").alias("m")), "nh")
    most = F.expr("2 * both > n and 2 * both > m").alias("most")
    return materialized(pairs.select("h", "nh", "both", most, (F.pmod(F.xxhash64("h", "nh"), F.lit(ROLLING)) == 0).alias("cut")), "together")


def _chunks(gaps: DataFrame, *alike: str) -> DataFrame:
    """Lines joined by gaps in a row, equal in ``alike``: ``doc_id``, ``_text``, ``start``, ``n`` (lines), ``key``."""
    place = Window.partitionBy("doc_id", "_text", *alike).orderBy("i")
    each = gaps.withColumn("run", F.col("i") - F.row_number().over(place))
    runs = each.groupBy("doc_id", "_text", *alike, "run").agg(F.array_sort(F.collect_list(F.struct("i", "h", "nh"))).alias("g"))
    hashes = F.concat(F.transform("g", lambda x: x["h"]), F.array(F.element_at("g", -1)["nh"]))
    return runs.select("doc_id", "_text", F.col("g")[0]["i"].alias("start"), (F.size("g") + 1).alias("n"), F.xxhash64(hashes).alias("key"))


def _place() -> Column:
    return F.struct("doc_id", "_text", "start")


def repeats(docs: DataFrame, long_line: int = LONG_LINE) -> DataFrame:
    """Chunks that occurred before, by hash, and (``gone`` false) their first places: ``doc_id``, ``_text``, ``start``, ``n``, ``key``, ``gone``."""
    lines = materialized(line_pairs(docs, long_line), "lines")
    gaps = materialized(lines.where("nh is not null").join(_together(lines), ["h", "nh"]).select("doc_id", "_text", "i", "h", "nh", "both", "most", "cut"), "gaps")
    most = gaps.where("most")
    long = lines.where("long").select("doc_id", "_text", F.col("i").alias("start"), F.lit(1).alias("n"), F.xxhash64(F.array("h")).alias("key"))
    runs = _chunks(gaps).unionByName(_chunks(most)).withColumn("run", F.lit(True))
    parts = long
    for some in (gaps, most):
        parts = parts.unionByName(_chunks(some.where("not cut"))).unionByName(_chunks(some, "both"))
    every = runs.unionByName(parts.withColumn("run", F.lit(False)))
    every = materialized(every.groupBy("doc_id", "_text", "start", "n", "key").agg(F.max("run").alias("run")), "chunks")
    first = every.groupBy("key", "n").agg(F.min(_place()).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    seen = materialized(every.join(materialized(first, "first-places"), ["key", "n"]).withColumn("gone", ~_place().eqNullSafe(F.col("first"))), "seen")
    # Of a run that goes as a whole, no part is asked for once more.
    end = F.col("start") + F.col("n")
    whole = seen.where("run and gone").select("doc_id", "_text", end.alias("end"), F.explode(F.sequence("start", end - 1)).alias("start"))
    held = [F.col("s.doc_id").eqNullSafe(F.col("w.doc_id")), F.col("s._text") == F.col("w._text"), F.col("s.start") == F.col("w.start"), F.expr("s.start + s.n <= w.end")]
    parts = seen.where("gone and not run").alias("s").join(whole.alias("w"), held, "left_anti").select("s.*")
    going = materialized(seen.where("run and gone").unionByName(parts), "going")
    stay = going.select("first.*", "n", "key").distinct().withColumn("gone", F.lit(False))
    return going.select("doc_id", "_text", "start", "n", "key", "gone").unionByName(stay)


def removals(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``_text``, ``ranges``: the (start, n) line ranges of each text that occurred before.

    The first occurrence is the one with the smallest (doc_id, hash of the text, line);
    it stays.  Chunks of one hash are told apart by their bytes.
    """
    found = repeats(docs, **options).groupBy("doc_id", "_text").agg(F.collect_list(F.struct("start", "n", "key", "gone")).alias("_found"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")
    held = texts.join(found.withColumnRenamed("doc_id", "_id"), texts.doc_id.eqNullSafe(F.col("_id")) & (texts._text == found._text)).select(texts.doc_id, texts._text, "text", "_found")
    numbered = F.filter(F.transform(F.split("text", "\n", -1), lambda x, k: F.struct(k.alias("pos"), x.alias("bytes"))), lambda x: x["bytes"] != "")
    held = settled(held, _l=numbered)
    line = lambda k: F.get("_l", k)["pos"]
    chunk = lambda k: F.array_join(F.transform(F.slice("_l", k["start"] + 1, k["n"]), lambda x: x["bytes"]), "\n")
    held = held.select("doc_id", "_text", F.inline(F.transform("_found", lambda k: F.struct(line(k["start"]).alias("start"), line(k["start"] + k["n"] - 1).alias("end"), k["key"].alias("key"), k["gone"].alias("gone"), chunk(k).alias("bytes")))))
    held = materialized(held.withColumn("other", F.xxhash64("bytes", F.lit(1))), "held")
    # Equal bytes: the first occurrence holds its bytes once, and each later one is compared with them.
    first = materialized(held.groupBy("key", "other").agg(F.min_by("bytes", _place()).alias("first_bytes"), F.min(_place()).alias("first")), "first")
    same = held.where("gone").join(first, ["key", "other"]).where((F.col("bytes") == F.col("first_bytes")) & ~_place().eqNullSafe(F.col("first")))
    return same.groupBy("doc_id", "_text").agg(F.collect_set(F.struct("start", (F.col("end") - F.col("start") + 1).alias("n"))).alias("ranges"))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` and ``n_chars`` (if there) renewed.

    Adds ``n_lines`` and ``n_removed``; columns of these names are replaced.  No row
    goes: a text of nothing but repeats becomes empty, null texts stay null with no
    lines, and an empty text is one line.  Rows equal in doc_id and text share their
    result.  Texts without a repeat come back byte for byte.
    """
    docs, named, _ = guarded(docs)
    gone = removals(docs, **options).withColumnsRenamed({"doc_id": "_id", "_text": "_hash", "ranges": "_ranges"})
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    marked = docs.select(*kept).withColumn("_text", F.xxhash64("text"))
    marked = marked.join(gone, marked.doc_id.eqNullSafe(gone._id) & (marked._text == gone._hash), "left")
    marked = settled(marked, _l=F.when(F.col("_ranges").isNotNull(), F.split("text", "\n", -1)))
    out = F.flatten(F.transform("_ranges", lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1)))
    marked = marked.withColumn("_stay", F.when(F.col("_ranges").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), out)))
    line = F.col("_l")
    text = F.when(F.col("_ranges").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_stay", lambda i: F.get(line, i)), "\n"))
    removed = F.when(F.col("_ranges").isNull(), 0).otherwise(F.size("_l") - F.size("_stay")).cast("long")
    shown = {c: F.col(c) for c in kept} | {"text": text}
    if "n_chars" in shown:
        shown["n_chars"] = F.when(F.col("_ranges").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    result = marked.select(*(v.alias(k) for k, v in shown.items()), F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"), removed.alias("n_removed"))
    return named(result)
