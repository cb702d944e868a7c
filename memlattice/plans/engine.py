"""The Python surface: recall, statistics and maintenance over tables of one store."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.config import DEFAULT, Config
from memlattice.functions import tags as tag
from memlattice.operators import aggregates, graph, lifecycle
from memlattice.plans import recall


class Engine:
    """``units`` (unit_id, bank_id, kind, text, embedding, tags, ...), ``links`` and ``postings`` as frames."""

    def __init__(self, tables: Mapping[str, DataFrame], config: Config = DEFAULT):
        self.tables, self.config = dict(tables), config
        self.stats_seconds, self.clock = 60.0, time.monotonic
        self.cached: dict[str, tuple[float, dict[str, int]]] = {}

    def units(self, bank: str | None = None, tags: list[str] | None = None, mode: str = "any") -> DataFrame:
        found = self.tables["units"]
        if bank is not None:
            found = found.where(F.col("bank_id") == bank)
        return found.where(tag.match(F.col("tags"), tags, mode)) if tags or mode == "exact" else found

    def recall(self, queries: DataFrame, bank: str | None = None, tags: list[str] | None = None, mode: str = "any", **options) -> DataFrame:
        """The arms that the tables allow: links and postings add the graph, times the temporal one."""
        graph_tables = {k: self.tables.get(k) for k in ("links", "postings")}
        return recall.hybrid(queries, self.units(bank, tags, mode), **{**graph_tables, "config": self.config, **options})

    def retain(self, units: DataFrame, at: str = "created_at") -> tuple[DataFrame, DataFrame]:
        """Units to append, without those stored, and their links.

        Links lead to other new units and to stored ones: in time, by vectors, and to
        the causes a unit names (``batch``, ``index``, ``causes``), as far as the
        columns are there.
        """
        stored, keys = self.tables["units"], ["bank_id", "kind"]
        new = units.join(stored.select("unit_id"), "unit_id", "left_anti")
        links = graph.links_to_stored(new, stored, keys, at, most=self.config.temporal_links)
        if "embedding" in units.columns and "embedding" in stored.columns:
            links = links.unionByName(graph.similar_stored(new, stored, ["bank_id"], self.config.semantic_links, self.config.semantic_link_floor))
        if "causes" in units.columns:
            links = links.unionByName(graph.causal_links(new).select("from_unit", "to_unit", "weight", "link_type"))
        self.cached.clear()
        return new, links

    def stats(self) -> DataFrame:
        return aggregates.count_by(self.tables["units"], "bank_id", "kind")

    def cached_stats(self, bank: str) -> dict[str, int]:
        """Units of a bank by kind, remembered for ``stats_seconds``; ``retain`` forgets all, ``forget`` one bank."""
        held = self.cached.get(bank)
        if held is None or self.clock() - held[0] >= self.stats_seconds:
            rows = self.stats().where(F.col("bank_id") == bank).collect()  # a row for each kind
            held = self.cached[bank] = (self.clock(), {r.kind: r.n for r in rows})
        return held[1]

    def forget(self, bank: str) -> None:
        self.cached.pop(bank, None)

    def links(self) -> DataFrame:
        return aggregates.link_counts(self.tables["links"], self.tables["postings"])

    def timeseries(self, at: str, unit: str = "day") -> DataFrame:
        return aggregates.timeseries(self.tables["units"], F.col(at), unit, "kind")

    def scopes(self, mode: str = "combined") -> DataFrame:
        return lifecycle.scopes(self.tables["units"], mode)
