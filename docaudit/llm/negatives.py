"""Hard negatives by the threshold algorithm over sorted lists of vector components.

Vectors become whole numbers, floor(256 * component). A block of candidates keeps one list of its rows for each
dimension, sorted by component. For an anchor, lists are read from the end that its component's sign asks for
(sorted access), newly met rows get their whole-number inner product (random access), and the sum of the anchor's
components times the values last read bounds all rows not yet met. Reading stops where that bound lies strictly
below the k-th score of every window (of all that is met, for positives), or below all that a window lets in.

First each anchor meets the blocks of its own label, for its positives; then, with the windows that their scores
give, all blocks, for the rows of other labels. The stated anchors go against all rows in blocks: blocks of
BLOCK_VALUES numbers, and chunks of ANCHORS anchors, each chunk meeting each block in a task of its own. Blocks
give at most k rows for each window, which are ranked by window afterwards.

Defined results: rows without id, label or vector, with an empty vector or a null or non-finite component take no
part; of rows with one id, the one with the smallest label, then vector, takes part; a component that a shorter
vector lacks counts as 0; numbers beyond +-2^24 count as that bound, so that sums stay exact in 64 bits; an anchor
without others of its label has no rows; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm.blockjoin import meet
from docaudit.llm.common import partitions, persisted

#: Numbers of a block of candidates (rows times dimensions), and anchors of a chunk.
BLOCK_VALUES, ANCHORS = 1 << 19, 512
BOUND = 1 << 24
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", relabel: Column | None = None) -> DataFrame:
    """id, label, v (array<int>) of the rows that take part, one for each id."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(256 * c, F.lit(-1e9)), F.lit(1e9))), F.lit(-BOUND)), F.lit(BOUND)).cast("int")
    label = F.col(label_col) if relabel is None else relabel
    out = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).where((F.size(vec_col) > 0) & ~bad)
    out = out.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, scaled).alias("v"))
    return out.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.*")


def matrix(vectors: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of int64, short ones filled with 0."""
    a = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(a.offsets.to_numpy())
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    inner = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fits = inner < wide
    out[np.repeat(np.arange(len(sizes)), sizes)[fits], inner[fits]] = flat[fits]
    return out


class Lists:
    """A block of candidates with a sorted list for each dimension."""

    #: Rows of each list that are read before the bound is looked at first; then twice as many each time.
    FIRST = 16

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")  # rows by id, so that ties keep the smaller ids
        self.ids, self.labels, self.values = ids[order], labels[order], values[order]
        self.width, self.rows = values.shape[1], len(ids)
        self.up = np.argsort(self.values, axis=0, kind="stable").T.astype(np.int32)
        self.most = int(np.abs(self.values).max(initial=0))

    def bound(self, anchor: np.ndarray, depth: int) -> int:
        """What no row outside the first depth rows of each list can exceed."""
        if depth >= self.rows:
            return LEAST
        d = np.arange(self.width)
        last = np.where(anchor > 0, self.values[self.up[:, self.rows - depth], d], self.values[self.up[:, depth - 1], d])
        return int((last * anchor).sum())

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (least, most score): rows and scores of its first k allowed rows, by score, then id."""
        scores = np.full(self.rows, LEAST, np.int64)
        seen, depth = np.zeros(self.rows, bool), 0
        signed = np.flatnonzero(anchor)
        forward, back = signed[anchor[signed] < 0], signed[anchor[signed] > 0]
        while True:
            to = min(self.rows, max(self.FIRST, 2 * depth))
            met = np.zeros(self.rows, bool)
            met[self.up[forward, depth:to].ravel()] = True
            met[self.up[back, self.rows - to : self.rows - depth].ravel()] = True
            if not len(signed):
                met[:] = True
            new = np.flatnonzero(met & ~seen & allowed)
            scores[new] = self.values[new] @ anchor
            seen |= met
            depth = to
            bound = LEAST if not len(signed) else self.bound(anchor, depth)
            done = seen & allowed
            kth = [self._kth(scores[done], low, high, k) for low, high in windows]
            if depth >= self.rows or all(bound < x for x in kth):
                break
        at = np.flatnonzero(done)
        return [self._first(at, scores[at], low, high, k) for low, high in windows]

    @staticmethod
    def _kth(scores: np.ndarray, low: int, high: int, k: int) -> int:
        """The window's k-th score; its least one where it has fewer rows. A window without scores asks for nothing."""
        if low > high:
            return MOST
        inside = scores[(scores >= low) & (scores <= high)]
        return int(np.partition(inside, len(inside) - k)[len(inside) - k]) if len(inside) >= k else low

    @staticmethod
    def _first(at: np.ndarray, scores: np.ndarray, low: int, high: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        if len(inside) > k:
            kth = np.partition(scores[inside], len(inside) - k)[len(inside) - k]
            inside = inside[scores[inside] >= kth]
        inside = inside[np.argsort(-scores[inside], kind="stable")][:k]
        return at[inside], scores[inside]


def _lists(rows: pa.Table) -> Lists:
    return Lists(rows["id"].to_numpy(), rows["label"].to_numpy(), matrix(rows["v"]))


def _batch(columns: list[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names)


def _positives(k: int):
    def answer(rows, asked):
        if asked is None:
            return _lists(rows)
        out: list[list[np.ndarray]] = [[], [], []]
        for anchor, vector in zip(asked["id"].to_numpy(), matrix(asked["v"], rows.width), strict=True):
            ((at, scores),) = rows.search(vector, rows.ids != anchor, [(LEAST, MOST)], k)
            for c, x in zip(out, (np.full(len(at), anchor), rows.ids[at], scores), strict=True):
                c.append(x)
        return _batch(out, ["anchor_id", "positive_id", "positive_score"])

    return answer


def _negatives(k: int, low: int, high: int):
    def answer(rows, asked):
        if asked is None:
            return _lists(rows)
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        for anchor, label, vector, found in zip(asked["id"].to_numpy(), asked["label"].to_numpy(), matrix(asked["v"], rows.width), asked["windows"].to_pylist(), strict=True):
            hits = rows.search(vector, (rows.labels != label) & (rows.ids != anchor), [(-(-low * w["score"] // 100), high * w["score"] // 100) for w in found], k)
            for w, (at, scores) in zip(found, hits, strict=True):
                for c, x in zip(out, (np.full(len(at), anchor), np.full(len(at), w["id"]), rows.ids[at], np.full(len(at), w["score"]), scores), strict=True):
                    c.append(x)
        return _batch(out, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    return answer


def ranked(rows: DataFrame, by: list[str], score: str, other: str, k: int) -> DataFrame:
    """The first k rows by group, with rank."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(other))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = 100,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, relabel: Column | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors are the rows whose id every
    divides; a negative's score lies from low to high percent of its positive's. relabel: the label to go by."""
    x = persisted(whole_vectors(rows, id_col, vec_col, label_col, relabel), "vectors")
    stats = x.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n"), F.sum((F.col("id") % every == 0).cast("long")).alias("asks")).first()
    width, n, asks = stats["width"] or 1, stats["n"], stats["asks"] or 0
    size, parts = max(64, BLOCK_VALUES // width), partitions(rows.sparkSession)
    deal = lambda c, k: F.pmod(F.xxhash64("id", F.lit(k)), c).cast("int")
    every_one = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    asked = x.where(F.col("id") % every == 0)

    # positives: blocks and chunks of a label
    sizes = x.groupBy("label").agg(
        F.ceil(F.count("*") / F.lit(size)).cast("int").alias("blocks"), F.ceil(F.sum((F.col("id") % every == 0).cast("long")) / F.lit(ANCHORS)).cast("int").alias("chunks"))
    index = x.join(sizes.where("chunks > 0"), "label").withColumn("block", deal(F.col("blocks"), 1)).withColumn("chunk", every_one(F.col("chunks")))
    queries = asked.join(sizes, "label").withColumn("chunk", deal(F.col("chunks"), 2)).withColumn("block", every_one(F.col("blocks")))
    columns = ["id", "label", "v", "block", "chunk"]
    best = meet(index.select(*columns), queries.select(*columns), ["label", "block", "chunk"], _positives(positives), "anchor_id long, positive_id long, positive_score long", parts)
    best = persisted(ranked(best, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")

    # negatives: blocks of all rows, chunks of anchors with their windows
    windows = best.groupBy("anchor_id").agg(  # at most `positives` of them
        F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("windows"))
    blocks, chunks = -(-n // size) or 1, -(-asks // ANCHORS) or 1
    index = x.withColumn("block", deal(F.lit(blocks), 1)).withColumn("chunk", every_one(F.lit(chunks)))
    queries = asked.join(windows, asked["id"] == windows["anchor_id"]).withColumn("chunk", deal(F.lit(chunks), 2)).withColumn("block", every_one(F.lit(blocks)))
    found = meet(
        index.select(*columns), queries.select(*columns, "windows"), ["block", "chunk"], _negatives(negatives, low, high),
        "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long", parts)
    out = ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
