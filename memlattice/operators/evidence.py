"""Evidence, claims, packets and the secondary searches."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.config import DEFAULT
from memlattice.functions.scoring import dot, norm
from memlattice.functions.texts import folded, token_estimate, tokens
from memlattice.operators.budget import pack
from memlattice.operators.retrieval import ranked
from memlattice.storage import settled


def recall_depth(max_tokens: Column, factor: float, low: int = 20, high: int = 2000) -> Column:
    """Candidates to fetch for a token limit, bounded."""
    return F.least(F.greatest(F.round(max_tokens * factor), F.lit(low)), F.lit(high)).cast("long")


def observation_expansion(seeds: DataFrame, sources: DataFrame, postings: DataFrame, fanout: int = DEFAULT.entity_fanout) -> DataFrame:
    """Observations that share entities with seed observations through their sources.

    ``sources``: obs, unit_id.  Of each entity the ``fanout`` last units count.
    """
    own = seeds.select("query_id", F.col("unit_id").alias("obs")).join(sources, "obs").select("query_id", "unit_id")
    entities = own.join(postings, "unit_id").select("query_id", "entity_id").distinct()
    capped = ranked(postings, ["entity_id"], F.desc("unit_id"), most=fanout, name="r").select("entity_id", "unit_id")
    found = entities.join(capped, "entity_id").join(sources, "unit_id").groupBy("query_id", F.col("obs").alias("unit_id")).agg(F.countDistinct("entity_id").alias("shared"))
    return found.join(seeds.select("query_id", "unit_id").distinct(), ["query_id", "unit_id"], "left_anti")


def rerank_text(text: Column, context: Column, at: Column) -> Column:
    """A unit's text for a reranker, with its date and context in front."""
    date = F.when(at.isNotNull(), F.concat(F.lit("[Date: "), F.date_format(at, "yyyy-MM-dd"), F.lit("] "))).otherwise("")
    return F.concat(date, F.coalesce(F.concat(context, F.lit(": ")), F.lit("")), text)


def terms_in(text: Column, terms: Sequence[str]) -> Column:
    """How many terms a text holds."""
    return F.size(F.filter(F.array(*map(F.lit, terms)), lambda w: F.contains(text, w)))


def anchor_adjustment(text: Column, wanted: Sequence[str], other: Sequence[str], up: float = 0.18, down: float = -0.12) -> Column:
    return F.when(terms_in(text, wanted) > 0, up).when(terms_in(text, other) > 0, down).otherwise(0.0)


def weighted_terms(text: Column, weights: Mapping[str, float]) -> Column:
    total = F.lit(0.0)
    for term, weight in weights.items():
        total = total + F.when(F.contains(text, F.lit(term)), weight).otherwise(0.0)
    return total


def lexical_search(units: DataFrame, text: Column, terms: Sequence[str], phrase: str, least: int = 2) -> DataFrame:
    """Units with at least ``least`` of the terms, by hits, coverage and the exact phrase."""
    hits = F.size(F.array_intersect(tokens(text), F.array(*map(F.lit, terms))))
    exact = F.when(F.contains(F.lower(text), F.lit(phrase)), 0.16).otherwise(0.0)
    scored = units.withColumn("hits", hits).where(F.col("hits") >= least)
    return scored.withColumn("score", F.round(0.34 + 0.055 * F.col("hits") + 0.4 * F.col("hits") / len(terms) + exact, 6))


def context_search(units: DataFrame, text: Column, title: Column, terms: Sequence[str], key: str, limit: int) -> DataFrame:
    wanted = F.array(*map(F.lit, terms))
    hits, titles = F.size(F.array_intersect(tokens(text), wanted)), F.size(F.array_intersect(tokens(title), wanted))
    scored = units.select(key, (hits + 2 * titles).alias("score"), titles.alias("_titles")).where("score > 0")
    return scored.orderBy(F.desc("score"), F.desc("_titles"), key).limit(limit).select(key, "score")


def claims(rows: DataFrame, lead: int = 48) -> DataFrame:
    """Claims of a slot merged: fewest tokens, most authority.

    Equal folded lower-case texts are one claim, and so is a claim that begins with
    another of the slot if both have ``lead`` characters or more; the shortest names it.
    In sorted order a claim's beginnings stand before it, so one pass that remembers
    the last of them finds it, however many share a beginning.
    """
    from pyspark.sql import types as T

    key = folded(F.lower("claim"))
    each = rows.groupBy("slot", key.alias("claim")).agg(F.min("tokens").alias("tokens"), F.max("authority").alias("authority"), F.count("*").alias("n"))
    each = each.withColumn("_lead", F.substring("claim", 1, lead)).repartition("slot", "_lead").sortWithinPartitions("slot", "_lead", "claim").drop("_lead")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, root = None, None
        for frame in frames:
            roots = []
            for this, claim in zip(frame["slot"], frame["claim"], strict=True):
                if this != slot or root is None or claim is None or len(root) < lead or not claim.startswith(root):
                    slot, root = this, claim
                roots.append(root)
            yield frame.assign(claim=roots)

    merged = each.mapInPandas(run, T.StructType(each.schema.fields))
    return merged.groupBy("slot", "claim").agg(F.min("tokens").alias("tokens"), F.max("authority").alias("authority"), F.sum("n").alias("n"))


def literal_search(sources: DataFrame, text: str, words: Sequence[str], every: bool = True, around: int = 700) -> DataFrame:
    """Sources that hold all (or any) of the words in any case: ``at``, the first place of one from 1, and the text up to ``around`` characters on either side."""
    low = F.lower(text)
    places = F.array(*(F.instr(low, w.lower()) for w in words))
    found = sources.withColumn("_p", places).where(F.forall("_p", lambda p: p > 0) if every else F.exists("_p", lambda p: p > 0))
    first = F.array_min(F.filter("_p", lambda p: p > 0))
    begin = F.greatest(F.lit(1), first - around)
    return found.withColumns({"at": first, "around": F.substring(F.col(text), begin, first - begin + around)}).drop("_p")


def missing_slots(required: Sequence[str], covered: Column) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), covered))


def packets(rows: DataFrame, most: int) -> DataFrame:
    """Items of one claim united, then packed by priority into a budget of a packet."""
    united = rows.groupBy("packet", "claim").agg(F.min("priority").alias("priority"), F.max_by("text", "priority").alias("text"), F.array_distinct(F.flatten(F.collect_list("evidence"))).alias("evidence"))
    return pack(united, ["packet"], "priority", token_estimate(F.col("text")) * 4, most)


def token_compatible(pairs: DataFrame, left: str, right: str, least: float = 0.6) -> DataFrame:
    """Whether every word of the shorter name has an equal, prefixing or alike word in the other."""
    from difflib import SequenceMatcher

    @F.pandas_udf("boolean")
    def compatible(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> bool:
            short, long = sorted((x.lower().split(), y.lower().split()), key=len)
            near = lambda u, v: u == v or u.startswith(v) or v.startswith(u) or SequenceMatcher(None, u, v).ratio() >= least
            return bool(short) and all(any(near(u, v) for v in long) for u in short)

        return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return pairs.withColumn("compatible", compatible(F.col(left), F.col(right)))


def topics(members: DataFrame, hierarchy: DataFrame, samples: int) -> DataFrame:
    """Roots of a hierarchy (``leaf``, ``root``) with their members, leaves that have any, and the ``samples`` members of most weight."""
    each = members.join(hierarchy, "leaf")
    best = ranked(each, ["root"], F.desc("weight"), F.asc("unit_id"), most=samples)
    best = best.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "unit_id"))), lambda x: x["unit_id"]).alias("samples"))
    counts = each.groupBy("root", "leaf").count().groupBy("root").agg(F.sum("count").alias("members"), F.count("*").alias("leaves"))
    return counts.join(best, "root")


OPERATIONS = ("append_block", "insert_block", "replace_block", "remove_block", "add_section", "remove_section", "replace_section_blocks", "rename_section")


class Document:
    """Sections in order, each with an id, a heading and (id, text) blocks; ``apply`` says whether an operation fits."""

    def __init__(self):
        self.sections: list[dict] = []
        self.made, self.applied, self.skipped = 0, 0, 0

    def _section(self, name: str | None) -> dict | None:
        return next((s for s in self.sections if s["id"] == name), None)

    def _blocks(self, texts) -> list[list[str]]:
        out = []
        for text in texts:
            self.made += 1
            out.append([f"b{self.made}", text or ""])
        return out

    def apply(self, op: str, section: str | None, block: str | None, after: str | None, text: str | None) -> None:
        done = getattr(self, f"_{op}", lambda *_: False)(self._section(section), section, block, after, text)
        self.applied, self.skipped = self.applied + bool(done), self.skipped + (not done)

    def _append_block(self, held, section, block, after, text):
        if held is None:
            return False
        held["blocks"] += self._blocks([text])
        return True

    def _insert_block(self, held, section, block, after, text):
        places = [b[0] for b in held["blocks"]] if held else []
        if held is None or (after is not None and after not in places):
            return False
        at = places.index(after) + 1 if after is not None else 0
        held["blocks"][at:at] = self._blocks([text])
        return True

    def _replace_block(self, held, section, block, after, text):
        found = [b for b in held["blocks"] if b[0] == block] if held else []
        for b in found:
            b[1] = text or ""
        return bool(found)

    def _remove_block(self, held, section, block, after, text):
        if held is None or block not in [b[0] for b in held["blocks"]]:
            return False
        held["blocks"] = [b for b in held["blocks"] if b[0] != block]
        return True

    def _add_section(self, held, section, block, after, text):
        """``section`` is the new id; one that exists gets a number behind it."""
        places = [s["id"] for s in self.sections]
        if section is None or (after is not None and after not in places):
            return False
        name, number = section, 2
        while name in places:
            name, number = f"{section}-{number}", number + 1
        at = places.index(after) + 1 if after is not None else len(places)
        self.sections.insert(at, {"id": name, "heading": text or "", "blocks": []})
        return True

    def _remove_section(self, held, section, block, after, text):
        if held is None:
            return False
        self.sections.remove(held)
        return True

    def _replace_section_blocks(self, held, section, block, after, text):
        if held is None:
            return False
        held["blocks"] = self._blocks((text or "").split("\n\n")) if text else []
        return True

    def _rename_section(self, held, section, block, after, text):
        if held is None or not text:
            return False
        held["heading"] = text
        return True


def apply_operations(operations: DataFrame) -> DataFrame:
    """Sections of each document after its operations (doc_id, seq, op, section, block, after, text) in order.

    Eight kinds (OPERATIONS); what names something that is not there, or is of no kind,
    is skipped.  ``text`` is a block, a heading, or blocks parted by an empty line.
    Rows: ``place`` and ``section`` (null for a document without sections), ``heading``,
    ``blocks`` (texts in order), and the document's ``applied`` and ``skipped``.
    Operations are read in order as a stream: a task holds one document's sections,
    however many operations made them.
    """
    kind = operations.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "seq", "op", "section", "block", "after", "text"]
    ordered = operations.select(*names).repartition("doc_id").sortWithinPartitions(*names)

    def rows(doc_id, document: Document) -> pd.DataFrame:
        held = document.sections or [{"id": None, "heading": None, "blocks": []}]
        return pd.DataFrame([(doc_id, k, s["id"], s["heading"], [b[1] for b in s["blocks"]], document.applied, document.skipped) for k, s in enumerate(held)], columns=["doc_id", "place", "section", "heading", "blocks", "applied", "skipped"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, document = None, None
        for frame in frames:
            frame = frame.astype(object).where(frame.notna(), None)
            for doc_id, _, *operation in frame.itertuples(index=False, name=None):
                if document is None or doc_id != now:
                    if document is not None:
                        yield rows(now, document)
                    now, document = doc_id, Document()
                document.apply(*operation)
        if document is not None:
            yield rows(now, document)

    return ordered.mapInPandas(run, f"doc_id {kind}, place int, section string, heading string, blocks array<string>, applied int, skipped int")


def diverse_samples(rows: DataFrame, limit: int) -> DataFrame:
    """Up to ``limit`` units of each topic: oldest, newest, nearest the centre, then each the farthest from those chosen.

    Every choice is an aggregate over all units of the topic (ties: oldest, then id),
    so nothing is collected but the ``limit`` vectors of a topic that are chosen.
    """
    length = norm(F.col("embedding"))
    v = F.transform("embedding", lambda x: x.cast("double") / F.when(length > 0, length).otherwise(1.0))
    held = rows.select("topic", "unit_id", "at", v.alias("v"))
    mean = held.select("topic", F.posexplode("v").alias("k", "x")).groupBy("topic", "k").agg(F.avg("x").alias("x"))
    centre = mean.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("centre"))
    unit, place = F.struct("unit_id", "v"), F.struct("at", "unit_id")
    ends = held.groupBy("topic").agg(F.min_by(unit, place).alias("a"), F.max_by(unit, place).alias("b"))
    near = held.join(centre, "topic").groupBy("topic").agg(F.min_by(unit, F.struct((-dot(F.col("v"), F.col("centre"))).alias("s"), "at", "unit_id")).alias("c"))
    add = lambda picks, p: F.when(F.exists(picks, lambda x: x["unit_id"] == p["unit_id"]), picks).otherwise(F.concat(picks, F.array(p)))
    chosen = settled(ends.join(near, "topic").select("topic", F.slice(add(add(F.array("a"), F.col("b")), F.col("c")), 1, limit).alias("picks")))
    for _ in range(limit - 1):
        open_ = held.join(chosen, "topic").where((F.size("picks") < limit) & ~F.exists("picks", lambda p: p["unit_id"] == F.col("unit_id")))
        closest = F.array_max(F.transform("picks", lambda p: dot(F.col("v"), p["v"])))
        pick = open_.groupBy("topic").agg(F.min_by(unit, F.struct(closest.alias("s"), "at", "unit_id")).alias("p"))
        chosen = settled(chosen.join(pick, "topic", "left").select("topic", F.when(F.col("p").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array("p"))).alias("picks")))
    return chosen.select("topic", F.posexplode("picks").alias("place", "p")).select("topic", F.col("p.unit_id").alias("unit_id"), F.col("place").cast("long").alias("place"))
