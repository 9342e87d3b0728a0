"""Hard-negative mining over a vector-approximation file.

Components become whole numbers, ``floor(scale * x)``. The approximation file holds, for each row, the cell of each dimension, one byte each, beside the vector. Cells are
cut at quantiles of a bounded sample (``sample`` rows, the least by a hash of the vector). For an anchor a and a dimension j a table tells the least and the greatest product
of a_j with any value of a cell; the sums of the looked-up entries are a lower and an upper bound of the score. Only rows that may enter a window by their bounds
are scored exactly:

* positives: the ``positives`` first rows with the anchor's label. The window's lower end is the best lower bounds' last one; rows with an upper bound below it go.
* negatives: for each positive, the ``negatives`` first rows of other labels with ``low`` * positive <= 100 * score <= 100 * positive. Rows whose bounds lie outside go; of rows
  that lie inside for sure, the best lower bounds raise the lower end.

Bounds are whole numbers too, and hold for every row, as the outer cells end at the least and greatest values of a block. So the results are exact.

Anchors (ids divisible by ``anchor_every``) are a query set against all rows: both are dealt into blocks of even size by row, never by value, label or id, so repeated vectors
and common labels make no block large. A block's few best rows leave it, and those of all blocks are ranked.

Defined cases: rows with a null id, label or vector, with a null or non-finite component, or of another length than most vectors (ties: the shortest of the commonest) take no part;
zero vectors do, with scores of 0; components beyond ``MOST`` after scaling count as that, so scores fit in 64 bits up to 1,024 dimensions; rows with one id are rows of their own, each anchor with
answers of its own; a negative score of a positive leaves its window empty; no anchors, positives or negatives give no rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, least_by, map_batches

MOST = 1 << 26
ROWS = (2048, 32_768)
ANCHORS = 1024
BLOCK = "row long, vec_id long, label int, cells binary, vector binary"


def usable(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """row (a number of its own), vec_id, label (mended) and vector (whole numbers) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
    whole = F.transform(v, lambda x: F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), F.floor(x * float(scale)).cast("double"))).cast("int"))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), whole.alias("vector"))


def cell_edges(x: np.ndarray, cells: int) -> np.ndarray:
    """The inner edges of each dimension's cells (dimension by edge): cell c holds the values from edge c - 1 up to, but not with, edge c."""
    return np.quantile(x, np.linspace(0, 1, cells + 1)[1:-1], axis=0, method="higher").T.astype(np.int64) if len(x) else np.zeros((x.shape[1], cells - 1), np.int64)


def approximated(rows: DataFrame, edges: np.ndarray) -> DataFrame:
    """The approximation file: ``rows`` with the cells of each vector, a byte a dimension, and the vector as 32-bit numbers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
        cells = np.empty(x.shape, np.uint8)
        for j in range(x.shape[1]):
            cells[:, j] = np.searchsorted(edges[j], x[:, j], "right")
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.tobytes() for c in cells], pa.binary()), pa.array([v.tobytes() for v in x.astype("<i4")], pa.binary())], names=["row", "vec_id", "label", "cells", "vector"])

    return map_batches(rows, run, BLOCK)


class Block:
    """Rows of the file in memory, ordered by label, with the ends of their cells."""

    def __init__(self, rows: pa.Table, edges: np.ndarray):
        label = rows.column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        self.label, self.row, self.vec_id = label[order], rows.column("row").to_numpy()[order], rows.column("vec_id").to_numpy()[order]
        self.x = vectors_of(rows)[order]
        n, d = self.x.shape
        self.cells = np.frombuffer(b"".join(rows.column("cells").to_pylist()), np.uint8).reshape(n, d)[order]
        self.width = edges.shape[1] + 1
        # the place of each cell's entry in the table of all dimensions, a dimension after the other
        self.entries = np.ascontiguousarray(self.cells.T.astype(np.int32) + np.arange(d, dtype=np.int32)[:, None] * self.width)
        least, most = self.x.min(0)[:, None], self.x.max(0)[:, None]
        self.low = np.concatenate([np.minimum(least, edges[:, :1]), edges], 1)
        self.high = np.concatenate([edges - 1, np.maximum(most, edges[:, -1:])], 1)
        # of empty cells the ends may cross; no row looks them up
        self.high = np.maximum(self.low, self.high)

    def rows_of(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.label, label, "left")), int(np.searchsorted(self.label, label, "right"))

    def bounds(self, a: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of the rows from ``start`` to ``end``."""
        one, other = a[:, None] * self.low, a[:, None] * self.high
        entries = self.entries[:, start:end]
        return np.minimum(one, other).ravel().take(entries).sum(0), np.maximum(one, other).ravel().take(entries).sum(0)

    def first(self, a: np.ndarray, at: np.ndarray, n: int, low: int | None = None, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``n`` first of the rows ``at`` by exact score and id, of those with 100 * score between ``low`` and ``high``; and their scores."""
        score = self.x[at] @ a
        if low is not None:
            inside = (100 * score >= low) & (100 * score <= high)
            at, score = at[inside], score[inside]
        order = np.lexsort((self.row[at], self.vec_id[at], -score))[:n]
        return at[order], score[order]


def vectors_of(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("vector").to_pylist()), "<i4").reshape(rows.num_rows, -1).astype(np.int64)


def best_below(bound: np.ndarray, n: int) -> int | None:
    """The ``n``-th greatest of ``bound``; None of fewer."""
    return int(np.partition(bound, len(bound) - n)[len(bound) - n]) if len(bound) >= n else None


def nearest_in(anchors: pa.Table, block: Block, n: int):
    """anchor row, row, vec_id and score of each anchor's ``n`` first rows of its label in a block."""
    for own, label, a in zip(anchors.column("row").to_pylist(), anchors.column("label").to_pylist(), vectors_of(anchors)):
        start, end = block.rows_of(label)
        if start == end:
            continue
        lower, upper = block.bounds(a, start, end)
        other = block.row[start:end] != own
        least = best_below(lower[other], n)
        at = np.flatnonzero(other & (upper >= least) if least is not None else other) + start
        at, score = block.first(a, at, n)
        for i, s in zip(at.tolist(), score.tolist()):
            yield own, s, int(block.row[i]), int(block.vec_id[i]), s


def windowed_in(anchors: pa.Table, block: Block, n: int, low: int):
    """anchor row, positive score, row, vec_id and score of the ``n`` first rows of other labels in a block for each of the anchor's positive scores."""
    for own, label, a, scores in zip(anchors.column("row").to_pylist(), anchors.column("label").to_pylist(), vectors_of(anchors), anchors.column("scores").to_pylist()):
        start, end = block.rows_of(label)
        parts = [(block.bounds(a, s, e), s) for s, e in ((0, start), (end, len(block.row))) if s < e]
        if not parts:
            continue
        lower, upper = (np.concatenate([p[0][side] for p in parts]) for side in (0, 1))
        places = np.concatenate([np.arange(len(p[0][0])) + p[1] for p in parts])
        for positive in scores:
            may = (100 * upper >= low * positive) & (lower <= positive)
            sure = lower[may & (100 * lower >= low * positive) & (upper <= positive)]
            least = best_below(sure, n)
            if least is not None:
                may &= upper >= least
            at, score = block.first(a, places[may], n, low * positive, 100 * positive)
            for i, s in zip(at.tolist(), score.tolist()):
                yield own, positive, int(block.row[i]), int(block.vec_id[i]), s


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, anchor_every: int = 100, shifted_every: int = 7, labels: int = 10, cells: int = 64, sample: int = 10_000, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Labels of rows whose id is divisible by ``shifted_every`` are moved on by one, modulo ``labels`` (0: none are).
    """
    rows = usable(vectors, scale, id_col, vector_col, label_col)
    if shifted_every:
        rows = rows.withColumn("label", F.when(F.pmod("vec_id", F.lit(shifted_every)) == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(labels)).cast("int")).otherwise(F.col("label")))
    rows = cut(rows)
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths or not lengths[0].d:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows, n = rows.where(F.size("vector") == lengths[0].d), lengths[0].n
    drawn = least_by(rows.select("row", "vector"), F.xxhash64("vector"), sample, "row").select("vector").toArrow()
    edges = cell_edges(drawn.column("vector").combine_chunks().flatten().to_numpy().reshape(drawn.num_rows, -1), cells)
    file = cut(approximated(rows, edges))
    row_blocks = -(-n // min(max(ROWS[0], n // 64), ROWS[1]))
    dealt = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    anchors = file.where(F.pmod("vec_id", F.lit(anchor_every)) == 0).drop("cells")
    anchor_blocks = max(1, -(-anchors.count() // ANCHORS))
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    in_blocks = file.withColumn("b", dealt(row_blocks)).withColumn("a", every(anchor_blocks))

    def blockwise(asked: DataFrame, find) -> DataFrame:
        """anchor, positive_score, row, vec_id and score that ``find`` gives for each block of anchors and block of rows."""

        def run(anchors_here: pa.Table, rows_here: pa.Table) -> pa.Table:
            found = list(find(anchors_here, Block(rows_here, edges))) if anchors_here.num_rows and rows_here.num_rows else []
            return pa.table({name: pa.array([f[k] for f in found], pa.int64()) for k, name in enumerate(("anchor", "positive_score", "row", "vec_id", "score"))})

        dealt_anchors = asked.select(*(F.col(c).alias(c) for c in asked.columns), dealt(anchor_blocks).alias("a")).withColumn("b", every(row_blocks))
        both = dealt_anchors.groupBy("a", "b").cogroup(in_blocks.groupBy("a", "b"))
        return both.applyInArrow(run, "anchor long, positive_score long, row long, vec_id long, score long")

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    near = blockwise(anchors, lambda a, b: nearest_in(a, b, positives)).withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    near = cut(near.select("anchor", F.col("vec_id").alias("positive_id"), "positive_score", "place"))
    asked = anchors.join(near.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("positive_score").alias("scores")), "row")
    window = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "vec_id", "row")
    hard = blockwise(asked, lambda a, b: windowed_in(a, b, negatives, low)).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= negatives)
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = near.join(hard.select("anchor", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "positive_score"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
