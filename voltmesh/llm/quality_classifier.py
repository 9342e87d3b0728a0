"""Ordinal quality classifier: cumulative-link regression on graded ratings.

A document's grade is 0 (poor), 1 (well written but toxic) or 2 (good). Its tokens (words in one case, runs of
punctuation, line feeds, and one feature for a word that follows itself) are hashed into ``2 ** bits`` features,
each weighted by the square root of its share of the tokens, so a document is a vector of about unit length. One weight vector
is shared by all grades, with ordered thresholds:

    P(grade <= k) = sigmoid(threshold_k - w . x),   threshold_0 < threshold_1

so the model gives the expected grade and the tail probability P(grade >= 2) that decides.

The model is fitted on a bounded sample of labelled rows (``sample``, the least by a hash of the id). Ratings are noisy
and most features rare, so only features of ``least_docs`` sampled documents can have a weight, and an L1 penalty
chooses among them; the chosen ones are fitted again with a tenth of the penalty. Every row of the corpus is scored. The
weights are broadcast: their size is fixed by ``bits``.

Defined cases: null and empty texts have no features, so the thresholds alone grade them, and they are
rejected (``keep`` false); rows with null ids or repeated rows are scored one by one; several labels of one id count as
their lowest grade; of several documents of a labelled id the one with the least hash is fitted; null labels are ignored; without labels
all rows with words are kept at the highest grade; equal texts get equal scores; a p_tail equal to ``cutoff`` is kept; extra
columns pass through ``score``, but columns named like its outputs are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENS, free_name, least_by, map_batches, values_of, word_hashes

GRADES = 3
_SAME = np.uint64(0x51ED270B0A1F2D4B)


def hashed(hashes: np.ndarray, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one text, given its tokens' hashes; ``wanted``: only features for which it is true."""
    n = len(hashes)
    same = np.count_nonzero(hashes[1:] == hashes[:-1]) if n else 0
    every = (np.append(hashes, np.full(same, _SAME)) >> np.uint64(64 - bits)).astype(np.int64)
    if wanted is not None:
        every = every[wanted[every]]
    found, times = np.unique(every, return_counts=True)
    return found, np.sqrt(times / max(n, 1)).astype(np.float32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def loss_and_slopes(z: np.ndarray, grades: np.ndarray, first: float, gap: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean -log likelihood, and each row's derivatives of its own in z, in the lower and in the upper threshold."""
    a, b = sigmoid(first - z), sigmoid(first + gap - z)
    p = np.maximum(np.where(grades == 0, a, np.where(grades == 1, b - a, 1 - b)), 1e-12)
    da, db = a * (1 - a), b * (1 - b)
    low = np.where(grades == 0, -da / p, np.where(grades == 1, da / p, 0))
    high = np.where(grades == 0, 0, np.where(grades == 1, -db / p, db / p))
    return float(-np.log(p).mean()), -(low + high), low, high


def descend(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, width: int, grades: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float, float]:
    """Weights, first threshold and gap that minimise mean -log likelihood + penalty * |w|: accelerated proximal steps with restarts.

    A row's curvature in z is at most 1/2, so a step of 1 / (half the mean of |value| * row's |values|) per feature never overshoots.
    """
    n = len(grades)
    reach = np.bincount(rows, np.abs(values), n) + 2
    size = np.bincount(cols, np.abs(values) * reach[rows], width) * 0.5 / n + 1e-9
    share = np.cumsum([max((grades == k).mean(), 1e-3) for k in range(GRADES - 1)])
    logit = np.log(share / np.maximum(1 - share, 1e-3))
    t = np.array([logit[0], np.log(max(logit[1] - logit[0], 1e-2))])
    w, w_now, t_now, momentum = np.zeros(width), np.zeros(width), t.copy(), 1.0
    for _ in range(steps):
        gap = np.exp(t_now[1])
        _, gz, low, high = loss_and_slopes(np.bincount(rows, w_now[cols] * values, n), grades, t_now[0], gap)
        new = w_now - np.bincount(cols, gz[rows] * values, width) / n / size
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / size, 0)
        t_new = t_now - np.array([(low + high).mean(), high.mean() * gap]) / (0.5 * reach.mean())
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        if (w_now - new) @ (new - w) > 0:
            after = 1.0
        w_now, t_now = new + (momentum - 1) / after * (new - w), t_new + (momentum - 1) / after * (t_new - t)
        t_now[1] = np.clip(t_now[1], -6, 4)
        w, t, momentum = new, t_new, after
    return w, float(t[0]), float(np.exp(np.clip(t[1], -6, 4)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, bits: int, penalty: float = 5e-5, least_docs: int = 5, steps: int = 300) -> dict:
    """The model of some rows' features: choose features with the whole penalty, then fit those with a tenth of it."""
    at = np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows])
    col = np.concatenate([c for c, _ in rows])
    value = np.concatenate([v for _, v in rows]).astype(float)
    features = np.flatnonzero(np.bincount(col, minlength=1 << bits) >= least_docs)
    for share in (1.0, 0.1):
        of = np.full(1 << bits, -1)
        of[features] = np.arange(len(features))
        some = of[col] >= 0
        w, first, gap = descend(at[some], of[col[some]], value[some], len(features), grades, share * penalty, steps)
        features, w = features[w != 0], w[w != 0]
    weights = np.zeros(1 << bits, np.float32)
    weights[features] = w
    return {"w": weights, "thresholds": (first, first + gap), "bits": bits}


def grade_column() -> F.Column:
    """0 for poor, 1 for good but toxic, 2 for good."""
    return F.when(F.col("quality") < 1, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) >= 1, 1).otherwise(2)


def train(docs: DataFrame, labels: DataFrame, bits: int = 20, sample: int = 8000, seed: int = 5) -> dict | None:
    """The model, from at most ``sample`` labelled documents; None without labels."""
    graded = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(grade_column()).alias("grade"))
    drawn = least_by(graded, F.xxhash64(F.lit(seed), "doc_id"), sample, "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t")).join(F.broadcast(drawn), "doc_id").withColumn("order", F.xxhash64("t"))  # at most `sample` rows

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [hashed(h, bits) for h in word_hashes(values_of(batch.column(1)), TOKENS, fold=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([c.astype(np.int32).tobytes() for c, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], names=["doc_id", "grade", "order", "cols", "vals"])

    featured = map_batches(texts, run, "doc_id long, grade int, order long, cols binary, vals binary")
    one = featured.groupBy("doc_id").agg(F.min(F.struct("order", "cols", "vals", "grade")).alias("r")).select("doc_id", "r.grade", "r.cols", "r.vals")
    rows = one.toArrow().sort_by("doc_id")  # at most `sample` rows
    if not rows.num_rows:
        return None
    return fit([(np.frombuffer(c, np.int32).astype(np.int64), np.frombuffer(v, np.float32)) for c, v in zip(values_of(rows["cols"]), values_of(rows["vals"]))], rows["grade"].to_numpy(), bits)


def score(docs: DataFrame, model: dict | None, cutoff: float = 0.5) -> DataFrame:
    """``docs`` with expected_grade, p_tail (of grade 2) and keep."""
    docs = docs.drop("expected_grade", "p_tail", "keep")
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(2.0), "p_tail": F.lit(1.0), "keep": has_words})
    shared, bits, thresholds = docs.sparkSession.sparkContext.broadcast(model["w"]), model["bits"], model["thresholds"]

    @F.arrow_udf("expected_grade double, p_tail double")
    def judge(texts: pa.Array) -> pa.Array:
        w = shared.value
        wanted = w != 0
        z = np.zeros(len(texts))
        for i, h in enumerate(word_hashes(values_of(texts), TOKENS, fold=True)):
            cols, values = hashed(h, bits, wanted)
            z[i] = w[cols] @ values
        above = [1 - sigmoid(t - z) for t in thresholds]
        return pa.StructArray.from_arrays([pa.array(above[0] + above[1]), pa.array(above[1])], ["expected_grade", "p_tail"])

    judged = free_name(docs, "judged")
    with_grade = docs.withColumn(judged, judge(F.col("text").cast("binary")))
    return with_grade.withColumns({"expected_grade": F.col(judged)["expected_grade"], "p_tail": F.col(judged)["p_tail"], "keep": has_words & (F.col(judged)["p_tail"] >= cutoff)}).drop(judged)


def quality_classifier(docs: DataFrame, labels: DataFrame, cutoff: float = 0.5, bits: int = 20, sample: int = 8000) -> DataFrame:
    """Train on the labelled sample and score every row of ``docs``."""
    return score(docs, train(docs, labels, bits, sample), cutoff)
