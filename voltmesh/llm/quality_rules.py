"""Quality rules judged by an isolation forest.

Rule statistics of every document are computed once and kept as a slim table. An isolation forest of
``trees`` trees, each on ``subsample`` rows, is grown on a bounded sample of those statistics
(``sample`` rows, the least by a hash of all statistics and the id); path lengths over the random splits
give every document an anomaly score in (0, 1). The cut is calibrated on the labelled rows: the
largest distance between the kept shares of good and bad rows (Youden) among cuts that keep at least
``keep_good`` of the good ones. Score counts are gathered in 1,000 fixed bins, so calibration covers
all labels and its size doesn't grow.

Defined cases: a null or empty text has no words and fails the base rules; null ids and repeated
rows are kept as they are, one result each; without usable labels (none joins, or only one class) the cut is
the score that keeps ``keep_good`` of all rows that pass the base rules; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, least_by, map_batches, mix, values_of, word_hashes

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
BINS = 1000
_SYMBOLS = b"#*$%&|<>"
_KEEP_SYMBOLS = bytes(sorted(set(range(256)) - set(_SYMBOLS)))
_SPACES = b" \t\n\v\f\r"
_UNCOUNTED = _SPACES + bytes(range(0x80, 0xC0))  # and all bytes of a character but its first


def statistics_of(text: bytes | None, h: np.ndarray) -> tuple[int, ...]:
    """The rule statistics of one text, given the hashes of its words, in the order of STATS."""
    symbols = len(text.translate(None, _KEEP_SYMBOLS)) if text else 0
    if not len(h):
        return (0, 0, symbols, 0, 0, 0)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()] if b"\n" in text else [text]
    repeated = 0
    if len(h) > 3:
        with np.errstate(over="ignore"):
            grams = mix(h[:-2] * np.uint64(3) + mix(h[1:-1]) * np.uint64(5) + mix(h[2:] + np.uint64(7)))
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        if same.any():
            found = np.zeros(len(grams), bool)
            found[order[1:][same]] = True
            found[order[:-1][same]] = True
            covered = np.zeros(len(h), bool)
            covered[:-2] |= found
            covered[1:-1] |= found
            covered[2:] |= found
            repeated = int(covered.sum())
    chars = len(text.translate(None, _SPACES if text.isascii() else _UNCOUNTED))
    return (len(h), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines))


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and STATS of every row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        rows = [statistics_of(t, h) for t, h in zip(values_of(texts), word_hashes(values_of(texts)))]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["doc_id", *STATS])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return map_batches(src, run, "doc_id long, " + ", ".join(f"{c} long" for c in STATS))


def features(columns: list[np.ndarray]) -> np.ndarray:
    """Scale-free features of the statistics."""
    n, chars, symbols, dup, rep, lines = (np.asarray(c, float) for c in columns)
    per = np.maximum(n, 1)
    return np.stack([np.log1p(n), chars / per, symbols / per, dup / np.maximum(lines, 1), rep / per, n / np.maximum(lines, 1)], 1)


def grow_forest(x: np.ndarray, trees: int = 100, subsample: int = 256, seed: int = 17) -> dict[str, np.ndarray]:
    """Trees as flat arrays: split feature (-1 in a leaf), split value, left child, path length at a leaf."""
    rng = np.random.default_rng(seed)
    psi = min(subsample, len(x))
    top = int(np.ceil(np.log2(max(psi, 2))))
    feature, value, child, depth, roots = [], [], [], [], []

    def expected(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    for _ in range(trees):
        roots.append(len(feature))
        feature.append(-1), value.append(0.0), child.append(0), depth.append(0.0)
        todo = [(roots[-1], x[rng.choice(len(x), psi, replace=False)], 0)]
        while todo:
            at, rows, level = todo.pop()
            spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 and level < top else []
            if not len(spread):
                depth[at] = level + expected(len(rows))
                continue
            f = int(rng.choice(spread))
            cut_at = rng.uniform(rows[:, f].min(), rows[:, f].max())
            feature[at], value[at], child[at] = f, cut_at, len(feature)
            for part in (rows[rows[:, f] <= cut_at], rows[rows[:, f] > cut_at]):
                todo.append((len(feature), part, level + 1))
                feature.append(-1), value.append(0.0), child.append(0), depth.append(0.0)
    return {"feature": np.array(feature, np.int16), "value": np.array(value), "child": np.array(child, np.int32), "depth": np.array(depth), "roots": np.array(roots, np.int32), "norm": np.array(max(expected(psi), 1e-9)), "top": np.array(top)}


def anomaly(x: np.ndarray, forest: dict[str, np.ndarray]) -> np.ndarray:
    """2 ** (-mean path length / expected path length) of each row."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for root in forest["roots"]:
        at = np.full(len(x), root, np.int32)
        for _ in range(int(forest["top"])):
            f = forest["feature"][at]
            inner = f >= 0
            right = x[rows, np.maximum(f, 0)] > forest["value"][at]
            at = np.where(inner, forest["child"][at] + right, at)
        total += forest["depth"][at]
    return 2.0 ** (-total / len(forest["roots"]) / float(forest["norm"]))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def calibrated_cut(bins: list[tuple[int, int, int]], keep_good: float) -> float:
    """The cut from (bin, good rows, bad rows) counts."""
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for b, g, n in bins:
        good[b], bad[b] = g, n
    if not good.sum():
        return 1.0
    kept_good = np.cumsum(good) / good.sum()
    kept_bad = np.cumsum(bad) / max(bad.sum(), 1)
    gain = np.where(kept_good >= keep_good, kept_good - kept_bad, -np.inf) if bad.sum() else -kept_good
    gain = np.where(kept_good >= keep_good, gain, -np.inf)
    return (int(np.argmax(gain)) + 1) / BINS


def quality_rules(docs: DataFrame, labels: DataFrame, trees: int = 100, subsample: int = 256, sample: int = 8192, keep_good: float = 0.995, seed: int = 17) -> DataFrame:
    """doc_id, STATS, base_failed, score and kept of every row of ``docs``."""
    stats = cut(rule_statistics(docs))
    drawn = least_by(stats, F.xxhash64(F.lit(seed), "doc_id", *STATS), sample, "doc_id", *STATS).select(*STATS).toPandas()
    spark = docs.sparkSession
    if not len(drawn):
        return stats.withColumns({"base_failed": base_failed(), "score": F.lit(0.0), "kept": ~base_failed()})
    forest = spark.sparkContext.broadcast(grow_forest(features([drawn[c].to_numpy() for c in STATS]), trees, subsample, seed))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = anomaly(features([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(STATS))]), forest.value)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=["doc_id", *STATS, "score"])

    scored = cut(map_batches(stats, score, stats.schema.simpleString()[7:-1].replace(":", " ") + ", score double"))
    scored = scored.withColumn("base_failed", base_failed())
    graded = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passing = scored.where(~F.col("base_failed")).withColumn("bin", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int"))
    counts = passing.join(graded, "doc_id").groupBy("bin").agg(F.count_if(F.col("quality") >= 1), F.count_if(F.col("quality") < 1)).collect()
    if not sum(r[1] for r in counts) or not sum(r[2] for r in counts):
        counts = passing.groupBy("bin").agg(F.count("*"), F.lit(0)).collect()
    at = calibrated_cut([tuple(r) for r in counts], keep_good)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") <= F.lit(at)))
