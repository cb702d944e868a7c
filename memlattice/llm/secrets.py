"""Secrets, through an incremental ledger of content-addressed blobs.

Every version of a text is a blob named by its SHA-256.  A rule set has a version.
Only pairs of blob and rule version that the ledger does not hold are scanned; the
findings are kept with the pair, and joined back to every path (document) that ever
had the blob.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.llm.common import materialized, settled, text_or_empty
from memlattice.llm.spans import NONE, joined, labelled, lengths, of_kind, places

#: The definitions, as plain patterns (fixed values); in "assign" the key's letters are of either case.
BASE = {
    "assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: The same for Java; failing runs of the last two cannot hold another match, so their length is in the pattern.
JAVA = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?+ *+[:=] *+["']?([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"[0-9a-f]{16,}+",
}
#: Spans the rule set adds.
MORE = {
    "private_key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "web_token": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "access_token": r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{20,}+|sk_live_[A-Za-z0-9]{24,}+)",
    "url_password": r"(?<![a-z])[a-z]{2,10}://[^\s/:@]{1,64}:[^\s/:@]{4,64}@",
}
RULES = {**JAVA, **MORE}
VERSION = 1
#: Blobs whose findings are broadcast to their rows: those with the most.
HOT_BLOBS = 200
GATE = r"""(?i:password|passwd|secret|token|api_?key)["']?+ *+[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|-----BEGIN |eyJ|gh[pousr]_|xox[abprs]-|sk_live_|://[^\s/:@]{1,64}:[^\s/:@]{4,64}@"""

FINDING = "array<struct<kind:string,start:int,end:int>>"


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blob of every row's text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_or_empty(text_col).cast("binary"), 256).alias("blob"))


def _kept(kind: str, span: Column) -> Column:
    if kind != "assign":
        return F.lit(True)
    return F.length(F.regexp_extract(span["match"], JAVA["assign"], 1)) >= LEAST["assign"]


def scan(blobs: DataFrame, version: int = VERSION) -> DataFrame:
    """``blob``, ``version`` and its ``findings`` for ``blob``, ``text`` rows; built-in functions only."""
    rows = settled(blobs, _g=F.col("text").rlike(GATE))
    rows = settled(rows, **{f"_m_{k}": F.when(F.col("_g"), F.regexp_extract_all("text", F.lit(p), F.lit(0))) for k, p in RULES.items()})
    rows = settled(rows, **{f"_l_{k}": F.when(F.size(f"_m_{k}") > 0, lengths(F.split("text", p, -1), F.col(f"_m_{k}"))) for k, p in RULES.items()})
    rows = settled(rows, **{f"_p_{k}": F.when(F.size(f"_m_{k}") > 0, places(f"_l_{k}", f"_m_{k}")) for k in RULES})
    kept = [labelled(F.filter(F.coalesce(f"_p_{k}", F.expr(NONE)), partial(_kept, k)), n, k) for n, k in enumerate(RULES)]
    found = [F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))) for spans in kept]
    return rows.select("blob", F.lit(version).alias("version"), F.concat(*found).cast(FINDING).alias("findings"))


def update(docs: DataFrame, ledger: DataFrame | None = None, version: int = VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ledger rows for the blobs of ``docs`` that ``ledger`` lacks under ``version``.

    Equal texts are one blob, found by their hash before they are sent anywhere
    twice; append the result to the ledger.
    """
    blobs = docs.select(F.sha2(text_or_empty(text_col).cast("binary"), 256).alias("blob"), text_or_empty(text_col).alias("text"))
    if ledger is not None:
        known = ledger.where(F.col("version") == version).select("blob")
        blobs = blobs.join(known, "blob", "left_anti")
    return scan(blobs.dropDuplicates(["blob"]), version)


def paths(docs: DataFrame, ledger: DataFrame, version: int = VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``blob`` and ``findings`` of every row of ``docs`` under a rule version.

    Null texts are the empty blob; repeated rows each give a row; other columns are
    not read.  Most blobs have no finding, so only those that do are joined.  The
    HOT_BLOBS blobs with the most rows are sent to every executor, so that no more
    rows of one blob than one in HOT_BLOBS of all meet in a task.
    """
    known = ledger.where((F.col("version") == version) & (F.size("findings") > 0)).select("blob", "findings").dropDuplicates(["blob"])
    rows = versions(docs, id_col, text_col)
    hot = rows.groupBy("blob").count().where("count > 100").orderBy(F.desc("count"), "blob").limit(HOT_BLOBS).select("blob")
    hot = materialized(hot.join(known, "blob", "left").select("blob", F.col("findings").alias("_hot"), F.lit(True).alias("_is_hot")), "hot")
    rows = rows.join(F.broadcast(hot), "blob", "left")  # HOT_BLOBS rows at most
    # What is known already takes a key of its own, which no blob has and which spreads its rows.
    key = F.when(F.col("_is_hot"), F.concat(F.lit("#"), F.xxhash64("doc_id").cast("string"))).otherwise(F.col("blob"))
    found = rows.withColumn("_key", key).join(known.withColumnRenamed("blob", "_key"), "_key", "left")
    return found.select("doc_id", "blob", F.coalesce("_hot", "findings", F.expr(f"cast(array() as {FINDING})")).alias("findings"))


def scan_all(docs: DataFrame) -> DataFrame:
    """Findings of ``docs`` through a new ledger, written to the shared folder."""
    return paths(docs, materialized(update(docs), "ledger"))


def digests(found: DataFrame) -> DataFrame:
    """The query's columns; in ``spans`` the added kinds follow the base ones at the same start."""
    of = {k: of_kind("findings", k) for k in RULES}
    base = [(k, of[k]) for k in BASE]
    return found.select(
        "doc_id",
        *(F.size(of[k]).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base, "start").cast("binary"), 256).alias("base_sha256"),
        joined([*base, *((k, of[k]) for k in MORE)], "start").alias("spans"),
    )


def plain(text: str) -> list[tuple[str, int, int]]:
    """The base spans of a text by the plain patterns, for tests."""
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text, re.I | re.A if kind == "assign" else 0):
            if len(m[2] if kind == "assign" else m[0]) >= LEAST[kind]:
                out.append((kind, m.start(), m.end()))
    return out
