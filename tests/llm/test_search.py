"""The nearest-neighbour search against brute force."""

import numpy as np
import pyarrow as pa
from voltmesh.llm import posting_lists


def brute(rows, k=10, every=100):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def answer(spark, rows, **options):
    got = {}
    for r in sorted(posting_lists.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **options).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_recall_and_scores(spark):
    """60,000 clustered vectors with the defaults: about 230 lists, of which a query may read a part only."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(1500, 24))
    x = (centres[rng.integers(0, 1500, 60_000)] + 0.35 * rng.normal(size=(60_000, 24))).astype("float32").astype(float)
    read = []
    lists_of = posting_lists.lists_of

    def counted(rows, shared, *options):
        out = lists_of(rows, shared, *options)
        read.append((out, len(shared.value.c)))
        return out

    posting_lists.lists_of = counted
    try:
        got = {}
        for r in posting_lists.search(spark.createDataFrame(pa.table({"vec_id": np.arange(60_000), "embedding": list(x)}))).collect():
            got.setdefault(r.query_id, {})[r.vec_id] = (r.score, r.rank)
    finally:
        posting_lists.lists_of = lists_of
    (_, n_lists), (probes, _) = read
    assert n_lists > 200 and probes.count() / 600 < 0.3 * n_lists
    square = (x * x).sum(1)
    found = 0
    assert got.keys() == set(range(0, 60_000, 100))
    for q, answers in got.items():
        d = square - 2 * (x @ x[q])
        d[q] = np.inf
        found += len(set(np.argsort(d)[:10].tolist()) & answers.keys())
        assert len(answers) == 10 and all(abs(s - np.sqrt(((x[i] - x[q]) ** 2).sum())) < 1e-9 for i, (s, _) in answers.items())
        assert [s for s, _ in sorted(answers.values(), key=lambda v: v[1])] == sorted(s for s, _ in answers.values())
    assert found / 6000 >= 0.9


def test_repeated_ids_and_ties(spark):
    # three rows of one id, one of them elsewhere: each is a query and a candidate
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [5.0, 5.0]), *[(i, [float(i), 0.0]) for i in range(1, 30)]]
    got = sorted(tuple(r) for r in posting_lists.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    want = []
    for q in range(3):
        d = [(float(np.hypot(rows[i][1][0] - rows[q][1][0], rows[i][1][1] - rows[q][1][1])), rows[i][0]) for i in range(len(rows)) if i != q]
        want += [(100, k + 1, i, s) for k, (s, i) in enumerate(sorted(d)[:10])]
    assert got == sorted(want)
    # 39 vectors as near as each other: ties go to the smaller ids
    rng = np.random.default_rng(6)
    corners = [[float(s * 3.0) if j == k else 0.0 for j in range(20)] for k in range(20) for s in (1, -1)][:39]
    corners = [[*c, 1.0] for c in corners]
    far = [(1000 + i, [float(v) for v in 50 + rng.normal(size=21)]) for i in range(1, 80)]
    got = answer(spark, [(300, [0.0] * 20 + [1.0]), *zip(range(101, 140), corners), *far])
    assert [i for i, _ in got[300]] == list(range(101, 111))


def test_copies_ties_and_bad_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(x) for x in rng.normal(size=3).astype("float32")]) for i in range(400)]
    want = brute(rows)
    bad = [(1000, None), (1100, [0.0, 0.0, 0.0]), (1200, [float("nan"), 1.0, 1.0]), (1300, [None, 1.0, 1.0]), (1400, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (1500, [1.0, 2.0])]
    got = answer(spark, rows + bad)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_few_and_none(spark):
    assert answer(spark, []) == {}
    assert answer(spark, [(100, [1.0, 0.0])]) == {}
    assert answer(spark, [(100, [1.0, 0.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0])]) == {100: [(7, 1.0), (8, 1.0)]}
