"""Quality rules as a bitmask ledger.

Every rule is evaluated once; a document keeps its measurements and one bit for
each rule it fails.  A policy is a set of bits with a version, so another policy,
or an ablation of one, needs no text: it is bitwise work on the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.llm.common import guarded, settled, text_or_empty

SPACE = r"[ \t-\r]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: name, failure condition over the measurements; a rule's bit is its place here.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words AND n_symbols > 5"),
    ("shouting", "2 * n_bangs > n_words AND n_bangs > 5"),
    ("repeated_lines", "2 * n_dup_lines > n_lines AND n_dup_lines > 2"),
    ("long_words", "word_chars > 40 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[name] for name in self.rules)


BASE = Policy(1, ("few_words", "repeated_windows"))
PRODUCTION = Policy(2, tuple(name for name, _ in RULES))

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bangs", "n_lines")


def _dropped(text: Column, characters: str) -> Column:
    """How many of the text's characters are among ``characters``."""
    return reduce(lambda total, c: total + F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))), characters, F.lit(0))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements, all long; null texts count as empty.

    Columns of the same names are replaced.  Nothing is shuffled: repeats within a
    text are found by hash sets over its own arrays, and only texts that have a
    repeated window sort them.
    """
    docs, named, of = guarded(docs)
    kept = [c for c in docs.columns if c.lower() not in MEASUREMENTS]
    rows = docs.select(*kept, text_or_empty(of[text_col]).alias("_t"))
    rows = rows.withColumns({"_w": F.array_remove(F.split("_t", SPACE + "+", -1), ""), "_l": F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))})
    rows = rows.withColumns({"_n": F.size("_w"), "_h": F.transform("_w", lambda w: F.xxhash64(w))})
    h = F.col("_h")
    runs = F.transform(F.slice("_h", F.lit(1), F.greatest(F.col("_n") - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(h[i + k] for k in range(1, WINDOW))))
    rows = rows.withColumn("_r", F.when(F.size(F.array_distinct("_h")) < F.col("_n"), runs))
    ordered = F.array_sort(F.transform("_r", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_s", F.when(F.size(F.array_distinct("_r")) < F.size("_r"), ordered))
    s = F.col("_s")
    again = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("_p", F.array_sort(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    found = {
        "n_words": F.col("_n"),
        "word_chars": F.length(F.array_join("_w", "")),
        "n_symbols": _dropped(F.col("_t"), SYMBOLS),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_bangs": _dropped(F.col("_t"), "!"),
        "n_lines": F.size("_l"),
    }
    return named(rows.select(*kept, *(v.cast("long").alias(k) for k, v in found.items())))


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its measurements and ``failures``, a bit for each rule failed."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(test), F.lit(BIT[name])).otherwise(F.lit(0)) for name, test in RULES))
    return settled(measure(docs, text_col), failures=bits.cast("long"))


def failed(policy: Policy) -> Column:
    return F.col("failures").bitwiseAND(F.lit(policy.mask)) != 0


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: ``rejected`` by it, and ``alone``, kept without it.

    Documents are first counted by failure mask, of which there are no more than
    two to the number of rules.
    """
    masks = book.groupBy("failures").count()
    one = F.col("failures").bitwiseAND(F.lit(policy.mask))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in policy.rules))
    each = masks.select(one.alias("m"), "count", F.explode(rules).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(F.col("m").bitwiseAND(F.col("r.bit")) != 0, F.col("count"))), F.lit(0)).alias("rejected"),
        F.coalesce(F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("count"))), F.lit(0)).alias("alone"),
    )


def accept(docs: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The documents that a policy keeps, with their own columns, whatever their names; null texts count as empty and fail."""
    docs, named, _ = guarded(docs)
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))
    return named(ledger(rows).where(~failed(policy)).select("row.*"))


def digests(book: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The query's columns."""
    return book.select("doc_id", *MEASUREMENTS[:5], failed(BASE).alias("base_failed"), (~failed(BASE) & ~failed(policy)).alias("kept"), "failures")
