"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of five-word shingles (fewer words: all words are one shingle). Two documents link if the
Jaccard similarity of their sets is at least 0.8. Every document gets its class (the least doc_id of its connected
component) and its number of links, and no pair is ever a row:

1. Documents with equal shingle sets form a copy class, represented by its least id; copies are counted.
2. Representatives get MinHash values and meet in banded buckets (24 bands of 4: a pair at 0.8 is missed with
   probability 3e-6). In a bucket, values are compared in steps; after each step a pair is dropped if the
   posterior probability that its similarity reaches the threshold, given the matches so far and a uniform prior,
   is below ``tolerance``. What survives is kept as a spanning forest of the bucket, linear in its members.
3. Components of those forests are verified exactly: shingle sets of the pairs that pass the same pruning are
   intersected. Links are counted where they are found, and only a forest of them leaves the task.

Buckets and components over ``block`` members are cut into blocks, and each pair of blocks is a task, so
no task holds more than two blocks. Every pair of a component is compared in exactly one task.

Defined cases: null and empty texts have no shingles: they are alone in their class, with no links, whatever their number; rows of
one doc_id but different texts are told apart by their row and reported row by row; null ids come back as null, in a
class of null ids or of the least non-null member; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, map_batches, map_groups, mix, values_of, word_hashes
from .components import connected_components

BANDS, ROWS, STEP = 24, 4, 16
HASHES = BANDS * ROWS


def shingles(h: np.ndarray, n: int = 5) -> np.ndarray:
    """The distinct shingles of a text, given the hashes of its words, as sorted 64-bit hashes."""
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        if len(h) < n:
            total = np.uint64(len(h))
            for x in h:
                total = total * np.uint64(0x9E3779B97F4A7C15) + x
            return mix(np.array([total], np.uint64))
        total = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
        return np.unique(mix(total))


_RNG = np.random.default_rng(20240229)
_MULTIPLY = _RNG.integers(1, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, np.uint64)


def minhash(s: np.ndarray) -> np.ndarray:
    """HASHES values of a shingle set."""
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 512):
            least = np.minimum(least, (s[i : i + 512, None] * _MULTIPLY + _ADD).min(0))
    return (least >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of compared values, the fewest matches whose posterior keeps a pair.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its upper tail at t is the probability of
    at most m successes in n + 1 trials of chance t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while m < n:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out[n] = m
    return out


def surviving_pairs(sig: np.ndarray, group: np.ndarray, mine: np.ndarray, cross: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of one group that pass the incremental comparison; where ``cross`` holds, of different blocks only.

    ``group`` is sorted, so the pairs at distance d are compared together, for growing d.
    """
    out_i, out_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at, d = np.arange(len(sig)), 0
    while True:
        d += 1
        at = at[at + d < len(sig)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            return np.concatenate(out_i), np.concatenate(out_j)
        i = at[~cross[at] | (mine[at] != mine[at + d])]
        m = np.zeros(len(i), np.int64)
        for n in range(STEP, HASHES + 1, STEP):
            if not len(i):
                break
            m = m + (sig[i, n - STEP : n] == sig[i + d, n - STEP : n]).sum(1)
            keep = m >= least[n]
            i, m = i[keep], m[keep]
        out_i.append(i)
        out_j.append(i + d)


def forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A spanning forest, as (root, node) rows, of index pairs over ``nodes``."""
    root = np.arange(len(nodes))
    while len(i):  # least labels, carried on over arrays
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = np.flatnonzero(nodes[root] != nodes)
    return np.stack([nodes[root[other]], nodes[other]], 1)


def signed(docs: DataFrame, n: int) -> DataFrame:
    """row, doc_id, key, set (fingerprint of the shingle set) and signature."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, signatures = [], []
        for h in word_hashes(values_of(batch.column(3))):
            s = shingles(h, n)
            if len(s):
                with np.errstate(over="ignore"):
                    sets.append(s.sum(dtype=np.uint64).tobytes() + mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).tobytes() + len(s).to_bytes(4, "little"))
                signatures.append(minhash(s).tobytes())
            else:
                sets.append(None)
                signatures.append(None)
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary()), pa.array(signatures, pa.binary())], names=["row", "doc_id", "key", "set", "signature"])

    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("binary").alias("t"))
    return map_batches(src, run, "row long, doc_id long, key string, set binary, signature binary")


def row_key() -> F.Column:
    """One string for each (doc_id, text)."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.when(F.col("text").isNull(), "null").otherwise(F.concat(F.lit("text "), "text"))))


def blocked(members: DataFrame, key: str, node: str, block: int) -> DataFrame:
    """Members with the pairs of blocks they take part in: ``i``, ``j`` (i <= j) and their own block ``mine``."""
    sizes = members.groupBy(key).agg(F.count("*").alias("members")).where("members > 1").withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    mine = F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    placed = members.join(sizes.select(key, "blocks"), key).withColumn("mine", mine)
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("other", "blocks")


def similar_documents(docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6, block: int = 512) -> DataFrame:
    """row, doc_id, key, class_id, class_row, n_links and copies of every row of ``docs`` (doc_id, text)."""
    least = least_matches(threshold, tolerance)
    signs = cut(signed(docs, n))
    with_set = signs.where("set is not null")
    copies = with_set.groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"), F.count("*").alias("copies"))
    classes = cut(copies.select("set", F.col("least.row").alias("rep"), "copies"))
    reps = with_set.join(classes.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), "signature")

    def band_keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        with np.errstate(over="ignore"):
            keys = mix((sig * _MULTIPLY[:ROWS]).sum(2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        row = np.repeat(np.arange(len(sig)), BANDS)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(keys.ravel().view(np.int64))], names=["rep", "bucket"])

    banded = map_batches(reps, band_keys, "rep long, bucket long")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket")
    meeting = cut(banded.join(shared, "bucket", "left_semi"))
    buckets = blocked(meeting, "bucket", "rep", block).join(reps, "rep")

    def candidates(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        i, j = surviving_pairs(signatures_of(rows), *groups_of(rows, starts), least)
        edges = forest(rows.column("rep").to_numpy(), i, j)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    edges = map_groups(buckets.select("bucket", "i", "j", "mine", "rep", "signature"), ["bucket", "i", "j"], candidates, "a long, b long")
    likely = cut(connected_components(edges).withColumnRenamed("node", "rep"))
    wanted = likely.join(signs.select(F.col("row").alias("rep"), "key"), "rep")
    # rows equal in id and text give one another's shingles
    sets = docs.select(row_key().alias("key"), F.col("text").cast("binary").alias("t")).join(wanted, "key").dropDuplicates(["key", "rep"]).select("rep", "t", "component")
    def with_shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(h, n) for h in word_hashes(values_of(batch.column(1)))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([s.tobytes() for s in found], pa.binary()), pa.array([minhash(s).tobytes() for s in found], pa.binary())], names=["rep", "component", "shingles", "signature"])

    shingled = cut(map_batches(sets, with_shingles, "rep long, component long, shingles binary, signature binary").join(classes.select("rep", "copies"), "rep"))
    compared = blocked(shingled, "component", "rep", block).select("component", "i", "j", "mine", "rep", "copies", "signature", "shingles")
    verified = cut(map_groups(compared, ["component", "i", "j"], lambda rows, starts: verify(rows, starts, threshold, least), "rep long, links long, a long, b long"))
    links = verified.where("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    final = connected_components(verified.where("a is not null").select("a", "b")).withColumnRenamed("node", "rep")
    about = classes.join(final, "rep", "left").join(links, "rep", "left").select("set", "copies", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    per_row = signs.select("row", "doc_id", "key", "set").join(about, "set", "left").withColumn("component", F.coalesce("component", "row"))
    names = per_row.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"))
    return per_row.join(names, "component").select("row", "doc_id", "key", F.col("least.doc_id").alias("class_id"), F.col("least.row").alias("class_row"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("copies"))


def signatures_of(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)


def groups_of(rows: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's group number and block, and whether its group compares two blocks."""
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
    return group, rows.column("mine").to_numpy(), rows.column("i").to_numpy() != rows.column("j").to_numpy()


def verify(rows: pa.Table, starts: np.ndarray, threshold: float, least: dict[int, int]) -> pa.RecordBatch:
    """Link counts of the rows' documents and a forest of the links, by exact intersection."""
    group, mine, cross = groups_of(rows, starts)
    i, j = surviving_pairs(signatures_of(rows), group, mine, cross, least)
    nodes, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
    size = np.array([len(s) for s in sets])
    both = np.zeros(len(i), np.int64)
    pairs = np.bincount(group[i], minlength=len(starts)) if len(i) else np.zeros(len(starts), np.int64)
    large = pairs[group[i]] > 256
    for p in np.flatnonzero(~large):
        both[p] = len(np.intersect1d(sets[i[p]], sets[j[p]], assume_unique=True))
    for g in np.flatnonzero(pairs > 256):
        first, last = starts[g], starts[g + 1] if g + 1 < len(starts) else rows.num_rows
        at = np.flatnonzero(group[i] == g)
        both[at] = intersections(sets[first:last], i[at] - first, j[at] - first)
    linked = both >= threshold * (size[i] + size[j] - both) - 1e-9
    i, j = i[linked], j[linked]
    count = (np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))).astype(np.int64)
    some, edges = np.flatnonzero(count), forest(nodes, i, j)
    none = [None] * max(len(some), len(edges))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([*nodes[some].tolist(), *none[: len(edges)]], [*count[some].tolist(), *none[: len(edges)]], [*none[: len(some)], *edges[:, 0].tolist()], [*none[: len(some)], *edges[:, 1].tolist()])], names=["rep", "links", "a", "b"])


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of many pairs of few sets, on bit rows of the shingles that two sets or more hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    column, kept = (np.cumsum(often) - 1)[number], often[number]
    owner, column = owner[kept], column[kept]
    bits = np.zeros((len(sets), int(often.sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (owner, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    step = max(1, 2_000_000 // bits.shape[1])
    return np.concatenate([np.bitwise_count(bits[i[at : at + step]] & bits[j[at : at + step]]).sum(1, dtype=np.int64) for at in range(0, len(i), step)])


def ngram_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6, block: int = 512) -> DataFrame:
    """doc_id, class_id and n_links of every row."""
    return similar_documents(docs, threshold, n, tolerance, block).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6, block: int = 512) -> DataFrame:
    """``docs`` with one row of each class, its least doc_id; rows without words are alone in their class and all stay."""
    kept = similar_documents(docs, threshold, n, tolerance, block).where(F.col("row") == F.col("class_row")).select("key")
    name = free_name(docs, "key")
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # rows equal in id and text are copies, so one of them stays
    worded = docs.where(has_words).withColumn(name, row_key()).join(kept.withColumnRenamed("key", name), name, "left_semi").dropDuplicates([name]).drop(name)
    return worded.unionByName(docs.where(~has_words))
