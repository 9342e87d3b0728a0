"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample (``sample`` rows, the least by a hash of the vector): lists are split
in two by k-means until each holds at most its share of the sample, so lists are balanced. Every vector is indexed:
it goes to its nearest centroid and, if it lies near a boundary, to each further list within ``replicate`` times the nearest
distance (at most ``copies`` lists, nearest first; what is left out stays in its nearest list, so every row is indexed).
Centroids are searched by a beam over an in-memory graph of their neighbours. A query reads the lists within ``prune`` times
its nearest centroid's distance, at least ``least_lists`` of them.

Equal vectors are one entry with their ``k + 1`` least rows by id: more can't be among the k nearest, as ties go
to the smaller id and a query leaves out itself at most. So a vector that a third of all rows share is one entry, and one
query. Lists are cut into chunks by a hash, sized by their counted entries, and each chunk's distances are computed as one
block; only the best entries of a block leave it, with all that lie as near as the last of them told apart by exact distance and id.

The centroids, with their graph, are broadcast: at most ``most_lists`` of them. The fitted sample grows with the lists, up to
``most_sample`` rows.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite values take no
part; so do null ids; rows with one id are rows of their own: each is a candidate, and each is a query with ranks of its
own; fewer than k candidates are all returned; no vectors give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, least_by, map_batches

VECTOR = "array<double>"
#: The numbers that a block of distances or of gathered vectors holds at most, 16 MB of doubles.
AT_ONCE = 1 << 21


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, row (a number of its own) and vector (doubles) of the rows that take part."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.col(vector_col).cast(VECTOR).alias("vector")).where("vec_id is not null and vector is not null")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(fine)


def entries(rows: DataFrame, k: int) -> DataFrame:
    """entry (its least row by id), vector, least (that row's id) and ids (vec_id and row of the k + 1 least, ascending) of each distinct vector."""
    ranked = rows.withColumn("key", F.xxhash64("vector")).withColumn("n", F.row_number().over(Window.partitionBy("key", "vector").orderBy("vec_id", "row")))
    few = ranked.where(F.col("n") <= k + 1)
    found = few.groupBy("key", "vector").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("ids"))
    return found.select(F.element_at("ids", 1)["row"].alias("entry"), "vector", F.element_at("ids", 1)["vec_id"].alias("least"), "ids")


def balanced_centroids(x: np.ndarray, share: int, seed: int = 3) -> np.ndarray:
    """Means of lists of at most ``share`` rows, by repeated two-means."""
    rng = np.random.default_rng(seed)
    todo, done = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= share:
            done.append(x[rows].mean(0))
            continue
        part = x[rows]
        a, b = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(8):
            d = part @ (b - a) - (b @ b - a @ a) / 2
            side = d > 0
            if side.all() or not side.any():
                break
            a, b = part[~side].mean(0), part[side].mean(0)
        d = part @ (b - a)
        few = min(side.sum(), (~side).sum())
        side = d > np.median(d) if few < 0.25 * len(part) else side  # balance
        if side.all() or not side.any():
            side = np.arange(len(part)) % 2 == 0
        todo += [rows[side], rows[~side]]
    return np.array(done)


def neighbour_graph(c: np.ndarray, degree: int) -> np.ndarray:
    """The ``degree`` nearest centroids of each, and links from far parts: a row of numbers each."""
    near = np.empty((len(c), min(degree, len(c))), np.int32)
    square = (c * c).sum(1)
    step = max(1, AT_ONCE // len(c))
    for i in range(0, len(c), step):
        d = square[None, :] - 2 * c[i : i + step] @ c.T
        near[i : i + step] = np.argpartition(d, near.shape[1] - 1, 1)[:, : near.shape[1]]
    far = (np.arange(len(c))[:, None] * 7919 + np.arange(1, 5)[None, :] * 104729) % len(c)
    return np.concatenate([near, far.astype(np.int32)], 1)


def beam_search(x: np.ndarray, c: np.ndarray, graph: np.ndarray, width: int, entry_points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest centroids found for each row, nearest first, and their distances."""
    square = (c * c).sum(1)
    width = min(width, len(c))
    at = entry_points[None, :].repeat(len(x), 0)
    beam, dist = np.empty((len(x), 0), np.int64), None
    for _ in range(64):
        both = np.sort(np.concatenate([beam, at], 1), 1)
        repeat = np.zeros(both.shape, bool)
        repeat[:, 1:] = both[:, 1:] == both[:, :-1]
        d = square[both] - 2 * np.einsum("ij,ikj->ik", x, c[both], optimize=True)
        d[repeat] = np.inf
        best = np.argpartition(d, min(width, d.shape[1]) - 1, 1)[:, :width] if d.shape[1] > width else np.arange(d.shape[1])[None, :].repeat(len(x), 0)
        new = np.sort(np.take_along_axis(both, best, 1), 1)
        dist = np.take_along_axis(d, best, 1)
        order = np.argsort(np.take_along_axis(both, best, 1), 1)
        dist = np.take_along_axis(dist, order, 1)
        if new.shape == beam.shape and (new == beam).all():
            break
        beam = new
        at = graph[beam].reshape(len(x), -1)
    order = np.argsort(dist, 1)
    dist = np.take_along_axis(dist, order, 1) + (x * x).sum(1)[:, None]
    return np.take_along_axis(beam, order, 1), np.sqrt(np.maximum(dist, 0))


class Centroids:
    """Broadcast: centroids, graph and where to enter it."""

    def __init__(self, c: np.ndarray, degree: int = 24):
        self.c, self.graph = c, neighbour_graph(c, degree)
        self.entries = np.unique(np.linspace(0, len(c) - 1, 16).astype(np.int64))

    def near(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        # a row meets its beam and the neighbours of all in it, each a vector
        step = max(1, AT_ONCE // (min(width, len(self.c)) * (self.graph.shape[1] + 1) * self.c.shape[1]))
        parts = [beam_search(x[i : i + step], self.c, self.graph, width, self.entries) for i in range(0, len(x), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def lists_of(rows: DataFrame, shared, ratio: float, most: int, least: int, beam: int) -> DataFrame:
    """``rows`` (entry, vector and more) once for each list: those within ``ratio`` of the nearest distance."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(0, batch.num_rows, 256):  # a row may leave ``most`` times, with its vector
            some = batch.slice(i, 256)
            found, dist = shared.value.near(matrix(some.column(1)), beam)
            take = (dist <= ratio * dist[:, :1]) | (np.arange(dist.shape[1])[None, :] < least)
            take &= np.isfinite(dist) & (np.arange(dist.shape[1])[None, :] < most)
            row, col = np.nonzero(take)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in some.columns), pa.array(found[row, col].astype(np.int32))], names=[*batch.schema.names, "list"])

    return map_batches(rows, run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", list int")


def nearest_of(x: np.ndarray, ids: np.ndarray, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` rows of ``x`` nearest to ``q``, by exact distance and id, and those distances."""
    rough = (x * x).sum(1) - 2 * (x @ q)
    if len(x) > most:
        # all that may be as near as the last one, up to what rounding may hide
        last = np.partition(rough, most - 1)[most - 1]
        near = np.flatnonzero(rough <= last + 1e-9 * (float(q @ q) + float((x * x).sum(1).max())))
    else:
        near = np.arange(len(x))
    exact = np.sqrt(((x[near] - q) ** 2).sum(1))
    order = np.lexsort((ids[near], exact))[:most]
    return near[order], exact[order]


def search(vectors: DataFrame, k: int = 10, query_every: int = 100, sample: int = 20_000, most_sample: int = 200_000, per_list: int = 256, most_lists: int = 16_384, copies: int = 4, replicate: float = 1.15, prune: float = 1.5, least_lists: int = 8, most_probed: int = 64, chunk: int = 2048) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of each query's k nearest found."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    # the commonest length is the table's
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return empty
    rows = cut(rows.where(F.size("vector") == lengths[0].n))
    held = cut(entries(rows, k))
    n = held.count()
    lists = int(min(most_lists, max(1, n // per_list)))
    drawn = least_by(held, F.xxhash64("vector"), min(most_sample, max(sample, 12 * lists)), "least", "entry").select("vector").toArrow()
    x = np.concatenate([matrix(part) for part in drawn["vector"].chunks]) if drawn.num_rows else np.empty((0, lengths[0].n))
    shared = spark.sparkContext.broadcast(Centroids(balanced_centroids(x, max(2, len(x) // lists))))
    posted = lists_of(held.select("entry", "vector", "least", "ids"), shared, replicate, copies, 1, 16)
    posted = cut(posted.withColumn("part", F.pmod(F.xxhash64("entry"), F.lit(1 << 30))))
    parts = posted.groupBy("list").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))  # most_lists rows at most
    queries = rows.where(F.pmod(F.col("vec_id"), F.lit(query_every)) == 0)
    asked = queries.groupBy("vector").agg(F.min("row").alias("entry"))
    probes = lists_of(asked.select("entry", "vector"), shared, prune, most_probed, least_lists, most_probed)
    probes = probes.join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    posted = posted.join(F.broadcast(parts), "list").withColumn("part", (F.col("part") % F.col("parts")).cast("int"))

    told = ["query", "entry", "least", "ids", "score"]

    def nearest(asked_rows: pd.DataFrame, list_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked_rows) or not len(list_rows):
            return pd.DataFrame([], columns=told, dtype=object)  # a list that no query reads; arrays have no other type
        x, ids, entry, least = np.array(list_rows["vector"].tolist()), list_rows["ids"].to_numpy(), list_rows["entry"].to_numpy(), list_rows["least"].to_numpy()
        out = []
        for query, vector in zip(asked_rows["entry"], asked_rows["vector"]):
            near, exact = nearest_of(x, least, np.asarray(vector), k + 1)
            out += [(query, entry[at], least[at], ids[at], score) for at, score in zip(near, exact)]
        return pd.DataFrame(out, columns=told)

    blocks = probes.select("list", "part", "entry", "vector").groupBy("list", "part").cogroup(posted.select("list", "part", "entry", "vector", "least", "ids").groupBy("list", "part"))
    found = blocks.applyInPandas(nearest, "query long, entry long, least long, ids array<struct<vec_id:long,row:long>>, score double")
    once = found.groupBy("query", "entry").agg(F.min("score").alias("score"), F.min("least").alias("least"), F.first("ids").alias("ids"))
    best = once.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "least", "entry"))).where(F.col("n") <= k + 1).select("query", "score", F.inline("ids"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id", "row"))).where(F.col("n") <= k + 1).drop("n")
    # every query row with that vector, itself left out; equal vectors' queries share the found entries
    per_query = queries.select(F.col("vec_id").alias("query_id"), F.col("row").alias("asker"), "vector").join(asked.withColumnRenamed("entry", "query"), "vector").drop("vector")
    ids = best.join(per_query, "query").where("row <> asker")
    ranked = ids.withColumn("rank", F.row_number().over(Window.partitionBy("asker").orderBy("score", "vec_id", "row"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
