"""Both vector searches against brute force, with odd rows, ties and several blocks."""

import math

import numpy as np

from statuta.llm import maxscore, nearest

DDL = "vec_id long, embedding array<float>, score string"


def vectors(n=180, width=8, seed=0):
    r = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in r.normal(0, 0.3, width)], "x") for i in range(n)]
    rows += [(n + 20 * i, rows[7][1], "x") for i in range(1, 4)]  # ties
    rows += [(3, rows[3][1], "x"), (20, rows[20][1], "x")]  # repeated rows
    rows += [(None, rows[1][1], "x"), (1000, None, "x"), (1020, [], "x"), (1040, [0.0] * width, "x"), (1060, [float("nan")] * width, "x")]
    rows += [(1080, [None] * width, "x"), (1100, [float("inf"), *[0.0] * (width - 1)], "x"), (1120, [1.0, 2.0], "x"), (1121, [2.0, 2.0], "x")]
    return rows


def brute(rows, every, k, measure, zero):
    ok = [(i, v) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    out, asked = [], set()
    for i, v in ok:
        if i % every or i in asked:
            continue
        asked.add(i)
        near = sorted((-measure(v, w), j) for j, w in ok if j != i and len(w) == len(v))[:k]
        out += [(i, at + 1, j, -s) for at, (s, j) in enumerate(near)]
    return out


def compare(frame, want):
    found = sorted(map(tuple, frame.collect()))
    assert [r[:3] for r in found] == [r[:3] for r in sorted(want)]
    assert np.allclose([r[3] for r in found], [r[3] for r in sorted(want)], rtol=1e-12, atol=1e-12)


def test_nearest_is_exact(spark):
    rows = vectors()
    dot = lambda a, b: float(sum(x * y for x, y in zip(a, b)))
    frame = spark.createDataFrame(rows, DDL)
    want = brute(rows, 20, 20, dot, zero=False)
    for blocks in ({}, {"candidate_rows": 16, "query_block": 3}):
        compare(nearest.nearest(frame, **blocks), want)
    assert nearest.nearest(frame.limit(0)).collect() == []


def test_bounds_hold():
    r = np.random.default_rng(1)
    for scale in (1.0, 1e-6, 1e4):
        q, c = r.normal(0, scale, (20, 64)), r.standard_t(2, (300, 64)) * scale
        estimate, bound = nearest.tile(nearest.quantised(q), nearest.quantised(c), 64)
        assert (np.abs(q @ c.T - estimate) <= bound).all()


def test_maxscore_is_exact(spark):
    rows = vectors()
    dot = lambda a, b: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))
    frame = spark.createDataFrame(rows, DDL)
    want = brute(rows, 50, 5, dot, zero=True)
    for blocks in ({}, {"candidate_rows": 16, "query_block": 2}):
        compare(maxscore.top_scores(frame, **blocks), want)
    assert maxscore.top_scores(frame.limit(0)).collect() == []


def test_pruned_rows_cannot_win():
    r = np.random.default_rng(2)
    parts = np.floor(r.normal(0, 40, (2000, 24))).astype(np.int64)
    shard = maxscore.Shard(np.arange(2000), parts)
    for q in range(30):
        exact = parts @ parts[q]
        exact[q] = -(1 << 60)
        floor = int(np.sort(exact)[-5])
        score, ids = shard.top(parts[q], q, floor, 5)
        assert set(np.nonzero(exact >= floor)[0]) <= set(ids) and (score == exact[ids]).all()
        assert len(ids) < 2000
