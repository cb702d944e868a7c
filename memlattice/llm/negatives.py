"""Hard-negative mining over product-quantized vectors with stored residual norms.

Vectors become whole numbers.  Each pair of components is a subspace with a codebook
fitted on a bounded sample; every row is indexed by its codes and by the length of
what the codes leave over.  The inner product of an anchor with the codes is a sum of
looked-up numbers, and by Cauchy and Schwarz the true score differs from it by at most
the anchor's length times the residual's.  Only rows whose interval can still belong
to the answer are scored exactly, so the answer does not depend on the codebooks.

Rows are dealt into tiles; all anchors pass every tile in turn, and only the best few
of a tile leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm.common import arrow_rows, materialized

#: Rows that the codebooks are fitted on, the least by hash of their id; every row is indexed.
SAMPLE_ROWS = 4096
SUBSPACE, CENTROIDS, ROUNDS = 2, 256, 6
#: Rows of a tile, at most and where there are few.
TILE, SMALL_TILE = 65_536, 2048

_CODED = "vec_id long, label int, residual double, codes binary, whole binary"


def whole_rows(rows: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id``, ``label``, ``q`` (whole numbers, ``floor(scale * x)``) of the rows that take part.

    Rows with a null id, label or vector, or a component that is null or not finite, do
    not.  Of rows with one id the least by label and then vector counts.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    q = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("long"))
    one = kept.select(F.col("vec_id").cast("long"), F.struct(F.col("label").cast("int").alias("label"), q.alias("q")).alias("r"))
    return one.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.q")


def fit(sample: np.ndarray) -> list[np.ndarray]:
    """A codebook of whole numbers for each subspace, by rounds of k-means from spread starting rows."""
    books = []
    for start in range(0, sample.shape[1], SUBSPACE):
        part = sample[:, start : start + SUBSPACE].astype(np.float64)
        points = np.unique(part, axis=0)
        book = points[np.linspace(0, len(points) - 1, min(CENTROIDS, len(points))).astype(np.int64)]
        for _ in range(ROUNDS):
            near = _nearest(part, book)
            count = np.bincount(near, minlength=len(book))
            mean = np.stack([np.bincount(near, weights=c, minlength=len(book)) for c in part.T], axis=1)
            book = np.where(count[:, None] > 0, mean / np.maximum(count, 1)[:, None], book)
        books.append(np.unique(np.rint(book), axis=0))
    return books


def _nearest(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book**2).sum(axis=1)[None, :] - 2 * part @ book.T, axis=1)


def encode(q: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes, and the length of what they leave over, not below the true one."""
    codes, left = np.zeros((len(q), len(books)), dtype=np.uint8), np.zeros(len(q))
    for k, book in enumerate(books):
        part = q[:, k * SUBSPACE : (k + 1) * SUBSPACE].astype(np.float64)
        codes[:, k] = _nearest(part, book)
        left += ((part - book[codes[:, k]]) ** 2).sum(axis=1)
    return codes, np.sqrt(left) * (1 + 1e-12)


def index(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, list[np.ndarray], int]:
    """The indexed rows as a table in the shared folder, the codebooks, and how many rows there are.

    Shorter vectors count as filled up with zeros.  Components whose scores would not
    fit into a long are refused.
    """
    spark = rows.sparkSession
    rows = materialized(rows, "whole")
    peak = F.max(F.greatest(F.abs(F.array_max("q").cast("double")), F.abs(F.array_min("q").cast("double"))))
    n, dims, peak = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0)), F.coalesce(peak, F.lit(0.0))).first()
    if peak > 2**31 - 1 or dims * peak * peak >= 2**63:
        raise ValueError(f"components up to {peak:.3g} times {dims}: scores would not fit into a long")
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("q").collect()
    books = fit(_filled([r.q for r in some], dims)) if some else []
    arrow_rows(spark, 4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _filled(batch.column(2).to_pylist(), dims)
            codes, left = encode(q, books)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(left), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in q], pa.binary())], names=["vec_id", "label", "residual", "codes", "whole"])

    return materialized(rows.select("vec_id", "label", "q").mapInArrow(run, _CODED), "coded"), books, n


def _filled(vectors: list[list[int]], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.int32)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


class Tile:
    """Rows that anchors are held against."""

    def __init__(self, rows: pa.Table, books: list[np.ndarray]):
        self.books, n = books, rows.num_rows
        self.ids, self.labels, self.residual = (rows.column(c).to_numpy() for c in ("vec_id", "label", "residual"))
        self.codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(n, -1).T.copy() if books else np.zeros((0, n), np.uint8)
        self.whole = np.frombuffer(b"".join(rows.column("whole").to_pylist()), np.int32).reshape(n, -1) if books else np.zeros((n, 0), np.int32)
        self.scored = 0

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the score of each row with the anchor is at least and at most."""
        about = np.zeros(len(self.ids))
        for k, book in enumerate(self.books):
            about += (book @ anchor[k * SUBSPACE : (k + 1) * SUBSPACE].astype(np.float64))[self.codes[k]]
        off = np.sqrt((anchor.astype(np.float64) ** 2).sum()) * self.residual * (1 + 1e-9) + np.abs(about) * 1e-9 + 1
        return about - off, about + off

    def exact(self, some: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        self.scored += len(some)
        rows = self.whole[some]
        if rows.size and float(np.abs(rows).max()) * float(np.abs(anchor).max()) * rows.shape[1] < 2**53:
            return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
        return (rows.astype(np.int64) * anchor.astype(np.int64)).sum(axis=1)

    def positives(self, anchor_id: int, label: int, anchor: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the best of one label."""
        some = np.flatnonzero((self.labels == label) & (self.ids != anchor_id))
        if len(some) > most:
            low, high = (b[some] for b in self.bounds(anchor))
            some = some[high >= np.partition(low, -most)[-most]]
        return self._best(some, self.exact(some, anchor), most)

    def negatives(self, label: int, anchor: np.ndarray, positives: list[int], share: tuple[int, int], most: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each positive's score, rows and scores of the best of other labels inside its window."""
        other = np.flatnonzero(self.labels != label)
        low, high = (b[other] for b in self.bounds(anchor))
        out, known = [], {}
        for score in positives:
            if score not in known:
                floor, roof = -(-share[0] * score // 100), share[1] * score // 100  # whole percents, in Python's integers
                may = (high >= floor) & (low <= roof)
                sure = low[(low >= floor) & (high <= roof)]
                if len(sure) >= most:
                    may &= high >= np.partition(sure, -most)[-most]
                some = other[may]
                exact = self.exact(some, anchor)
                held = (floor <= exact) & (exact <= roof)
                known[score] = self._best(some[held], exact[held], most)
            out.append(known[score])
        return out

    def _best(self, some: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[some], -scores))[:most]
        return some[order], scores[order]


def _met(coded: DataFrame, anchors: DataFrame, books: list[np.ndarray], n: int, schema: str, answer) -> DataFrame:
    """What ``answer(tile, anchor)`` gives for all anchors and tiles.

    Rows go to one tile each and anchors, which are few, to every tile; a task holds one
    tile's rows and a batch of anchors at a time.
    """
    spark = coded.sparkSession
    tiles = max(-(-n // TILE), min(-(-n // SMALL_TILE), int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    dealt = coded.select(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(tiles)).cast("int").alias("tile"), F.lit(0).alias("side"), "vec_id", "label", "residual", "codes", "whole", F.expr("cast(null as array<struct<positive_id:long,score:long>>)").alias("positives"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.lit(1).alias("side"), "vec_id", "label", "residual", "codes", "whole", "positives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tile = None, [], None
        for batch in batches:
            tile_of, side = (batch.column(k).to_numpy() for k in (0, 1))
            cuts = np.flatnonzero((np.diff(tile_of) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if tile_of[a] != at:
                    at, held, tile = tile_of[a], [], None
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if side[a] == 0:
                    held.append(part.drop_columns(["positives"]))
                elif held:
                    tile = tile or Tile(pa.concat_tables(held).combine_chunks(), books)
                    out = [x for row in part.select(["vec_id", "label", "whole", "positives"]).to_pylist() for x in answer(tile, row, np.frombuffer(row["whole"], np.int32))]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    arrow_rows(spark, 1024)
    rows = dealt.unionByName(asked).repartition("tile").sortWithinPartitions("tile", "side")
    return rows.mapInArrow(run, schema)


def _first(found: DataFrame, keys: list[str], score: str, key: str, most: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), key))).where(F.col("rank") <= most)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: int = 256, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``rows`` has ``vec_id``, ``label`` and ``embedding``; other columns are not read.  An
    anchor's positives are its best ``positives`` other rows of its label; a positive's
    negatives are the best ``negatives`` rows of other labels that score from
    ``share[0]`` to ``share[1]`` percent of it.  Ties go to the smaller ``vec_id``.
    Which rows take part: see ``whole_rows``.  Anchors without a positive and positives
    without a negative have no rows; an empty table gives none.  The result does not
    depend on the sample or the tiles.
    """
    coded, books, n = index(whole_rows(rows, scale), sample_rows)
    anchors = coded.where(is_anchor)
    none = F.expr("cast(null as array<struct<positive_id:long,score:long>>)")

    def good(tile: Tile, row: dict, anchor: np.ndarray) -> Iterator[tuple]:
        some, scores = tile.positives(row["vec_id"], row["label"], anchor, positives)
        return zip([row["vec_id"]] * len(some), tile.ids[some].tolist(), scores.tolist(), strict=True)

    def bad(tile: Tile, row: dict, anchor: np.ndarray) -> Iterator[tuple]:
        found = tile.negatives(row["label"], anchor, [p["score"] for p in row["positives"]], share, negatives)
        for p, (some, scores) in zip(row["positives"], found, strict=True):
            yield from ((row["vec_id"], p["positive_id"], p["score"], i, s) for i, s in zip(tile.ids[some].tolist(), scores.tolist(), strict=True))

    near = _met(coded, anchors.withColumn("positives", none), books, n, "anchor_id long, positive_id long, positive_score long", good)
    near = _first(near, ["anchor_id"], "positive_score", "positive_id", positives)
    near = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("positive_id", F.col("positive_score").alias("score")))).alias("positives"))
    near = materialized(near, "positives")
    asked = anchors.join(near, anchors.vec_id == near.anchor_id).drop("anchor_id")
    far = _met(coded, asked, books, n, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", bad)
    far = _first(far, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return far.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
