"""URL filtering by rules and, where none fits, by character language models.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, are
counted over the URLs that a rule decides, but for one in ``HELD_OUT`` of their
texts.  Each character's probability is interpolated over context lengths 0 to
``ORDER`` with Witten-Bell weights.  A URL is judged by the difference of its
log-likelihoods per character against a threshold calibrated on the URLs held out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.llm.common import guarded, materialized, named, settled

#: verdict, host, path (fixed values).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ORDER = 5
#: One text in so many is left out of the counts, for calibration.
HELD_OUT = 4
#: Buckets of scores in which the threshold is calibrated.
STEPS = 400
#: Stands before a URL's first characters.
START = "\x02"
#: A character's log ratio counts in whole steps of one in so many, so that sums have one value in any order.
UNIT = 1 << 20


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lowered, and path."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``ruled``, the verdict of the longest rule that fits."""
    host, path = parts(F.col(url_col))
    rows = pages.withColumns({"host": host, "path": path})
    rule = verdict = F.lit(None).cast("string")
    for decides, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(decides)).otherwise(verdict)
    return rows.withColumns({"rule": rule, "ruled": verdict})


def grams(text: str) -> Iterator[str]:
    """Contexts of each length with the character after them, longest last for each place."""
    padded = START * ORDER + text
    for i in range(ORDER, len(padded)):
        for k in range(ORDER + 1):
            yield padded[i - k : i + 1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["gram", "na", "nr"])

    for batch in batches:
        for text, rejected, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for gram in grams(text):
                counts[gram][rejected] += n
        if len(counts) > 500_000:
            yield out()
            counts.clear()
    yield out()


def models(labelled: DataFrame) -> DataFrame:
    """Counts of both models for ``text``, ``rejected`` (0 or 1), ``n`` (how often) rows, one row a ``string``.

    ``na`` and ``nr`` count it as a context with a character after it, in accepted and
    in rejected texts; ``ca``, ``cr`` count it as a context, and ``ta``, ``tr`` the
    distinct characters after it.
    """
    counted = labelled.mapInArrow(_count, "gram string, na long, nr long").groupBy("gram").agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
    counted = materialized(counted, "grams")
    none = F.lit(0).cast("long")
    grams = counted.select(F.col("gram").alias("string"), "na", "nr", *(none.alias(c) for c in ("ca", "cr", "ta", "tr")))
    before = F.substring("gram", F.lit(1), F.length("gram") - 1)
    contexts = counted.select(before.alias("string"), none, none, "na", "nr", (F.col("na") > 0).cast("long"), (F.col("nr") > 0).cast("long"))
    return grams.union(contexts).groupBy("string").agg(*(F.sum(c).alias(c) for c in ("na", "nr", "ca", "cr", "ta", "tr")))


def scores(texts: DataFrame, stats: DataFrame) -> DataFrame:
    """``text`` and its ``score``, the log-likelihood difference per character (0 without characters), for distinct texts.

    Probabilities are worked out from the shortest contexts to the longest, each
    length from its own counts and the row of the string without its first character:
    equality joins of distinct strings, in which no key has more rows than there are
    characters.
    """
    # Two hashes stand for a text, so that no row of a character carries all of it.
    texts = texts.select("text", F.xxhash64("text").alias("h"), F.hash("text").alias("g"))
    rows = settled(texts.where(F.length("text") > 0).select("h", "g", F.length("text").alias("size"), "text"), text=F.split(F.concat(F.lit(START * ORDER), "text"), "", -1))
    places = F.sequence(F.lit(1), F.col("size"))
    held = rows.select("h", "g", "size", F.explode(F.transform(places, lambda i: F.array_join(F.slice("text", i, ORDER + 1), ""))).alias("gram"))
    wanted = [materialized(held.select("gram").distinct(), "wanted")]
    for length in range(ORDER, 0, -1):
        wanted.insert(0, wanted[0].select(F.substring("gram", F.lit(2), F.lit(length)).alias("gram")).distinct())
    own = stats.where("na + nr > 0").select(F.col("string").alias("gram"), "na", "nr")
    context = stats.where("ca + cr > 0").select(F.col("string").alias("context"), "ca", "cr", "ta", "tr")
    known = None
    for length, grams in enumerate(wanted):
        rows = grams.select("gram", F.substring("gram", F.lit(1), F.lit(length)).alias("context"), F.substring("gram", F.lit(2), F.lit(length)).alias("tail"))
        if known is None:
            rows = rows.withColumns({"pa": F.lit(1 / 256), "pr": F.lit(1 / 256)})
        else:
            rows = rows.join(known.withColumnRenamed("gram", "tail"), "tail")
        rows = rows.join(own, "gram", "left").join(context, "context", "left")
        # A context never seen leaves the shorter one's probability.
        mixed = lambda n, c, t, p: F.when(F.col(c) > 0, (F.coalesce(n, F.lit(0)) + F.col(t) * F.col(p)) / (F.col(c) + F.col(t))).otherwise(F.col(p)).alias(p)
        known = rows.select("gram", mixed("na", "ca", "ta", "pa"), mixed("nr", "cr", "tr", "pr"))
    ratio = F.round((F.log("pa") - F.log("pr")) * UNIT).cast("long")
    summed = held.join(known.select("gram", ratio.alias("ratio")), "gram").groupBy("h", "g").agg((F.sum("ratio") / UNIT / F.first("size")).alias("score"))
    return texts.join(summed, ["h", "g"], "left").select("text", F.coalesce("score", F.lit(0.0)).alias("score"))


def judge(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, ``rule`` and ``verdict``; columns of these names are replaced, all others kept as they are.

    The models see host and path together, A-Z of the host lowered; equal ones are
    scored once.  Null urls have neither and score 0.  Without a rule's allow or
    block among the URLs held out the threshold is 0, and a score at the threshold is
    allowed.  Repeated rows each get a row.
    """
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "ruled", "verdict")]
    pages, back, of = guarded(pages.select(*map(named, kept)))
    kept, url_col = pages.columns, of[url_col]
    rows = ruled(pages, url_col, rules).withColumn("_text", F.concat("host", "path"))
    held_out = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    labelled = rows.where("ruled is not null").groupBy(F.col("_text").alias("text")).agg(F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("b"))
    labelled = materialized(labelled, "labelled")
    copies = labelled.where(~held_out).select("text", F.array(F.struct(F.lit(0).alias("rejected"), F.col("a").alias("n")), F.struct(F.lit(1).alias("rejected"), F.col("b").alias("n"))).alias("_each"))
    counted = copies.select("text", F.inline("_each")).where("n > 0")
    stats = materialized(models(counted), "models")
    asked = rows.where("ruled is null").select(F.col("_text").alias("text")).union(labelled.where(held_out).select("text")).distinct()
    scored = materialized(scores(materialized(asked, "asked"), stats), "scores")
    cut = threshold(labelled.where(held_out), scored)
    scored = scored.select(F.col("text").alias("_scored"), F.col("score").alias("_score"))
    # Equal texts of a hot url are dealt to several tasks by a salt.
    salts = 16
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*(c for c in kept if c != url_col)) if len(kept) > 1 else F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    open_ = rows.where("ruled is null")
    spread = scored.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    judged = open_.join(spread, (open_._text == spread._scored) & (open_._salt == spread._s), "left").withColumn("verdict", F.when(F.coalesce("_score", F.lit(0.0)) >= cut, "allow").otherwise("block"))
    columns = [*kept, "host", "path", "rule", "verdict"]
    return back(rows.where("ruled is not null").withColumn("verdict", F.col("ruled")).select(*columns).union(judged.select(*columns)))


def threshold(labelled: DataFrame, scored: DataFrame) -> float:
    """The score that parts labelled texts (``a`` accepted and ``b`` rejected rows of each) with the best balanced accuracy, from counts in ``STEPS`` buckets."""
    bucket = F.least(F.greatest(F.floor((F.col("score") + 4) * (STEPS / 8)), F.lit(0)), F.lit(STEPS - 1))
    found = labelled.join(scored, "text").groupBy(bucket.alias("k")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).orderBy("k").collect()
    accepted, rejected = sum(r.a for r in found), sum(r.b for r in found)
    if not accepted or not rejected:
        return 0.0
    best, cut, below = -1.0, 0.0, [0, 0]
    for place, r in enumerate(found):
        right = (accepted - below[0]) / accepted + below[1] / rejected
        if right > best:
            last = found[place - 1].k + 1 if place else r.k
            best, cut = right, (last + r.k) / 2 * 8 / STEPS - 4
        below = [below[0] + r.a, below[1] + r.b]
    return cut


def digests(judged: DataFrame) -> DataFrame:
    """The query's columns."""
    return judged.select("page_id", "host", "path", "rule", "verdict")


