"""Clustering against the plain rounds, and the bounds by themselves."""

import hashlib
import math

import numpy as np

from statuta.llm import centroids

DDL = "vec_id long, embedding array<float>, cluster string"


def vectors(n=400, width=64, seed=0):
    r = np.random.default_rng(seed)
    middle = r.normal(0, 0.4, (9, width))
    return [(i, [float(np.float32(c)) for c in middle[i % 9] + r.normal(0, 0.2, width)], "x") for i in range(n)]


def odd(rows):
    return rows + [
        (7, rows[7][1], "x"),
        (7, rows[8][1], "x"),
        (None, rows[3][1], None),
        *[(2000 + i, rows[5][1], "x") for i in range(150)],
        (900, None, "x"),
        (901, [], "x"),
        (902, [float("nan")] * 64, "x"),
        (903, [None] * 64, "x"),
        (904, [float("-inf"), *[0.0] * 63], "x"),
        (905, [1.0, 2.0], "x"),
    ]


def plain(rows, k=16, rounds=3):
    ok = [(i, [math.floor(64 * c) for c in v]) for i, v, _ in rows if v and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    key = lambda row: (hashlib.sha256(f"1:{'null' if row[0] is None else row[0]}".encode()).hexdigest(), row[1])
    points = [x for _, x in sorted(ok, key=key)[:k]]
    far = lambda x, p: sum((a - b) ** 2 for a, b in zip(x, p))
    for turn in range(rounds + 1):
        owner = [min(range(len(points)), key=lambda j: (far(x, points[j]), j)) for _, x in ok]
        if turn < rounds:
            for j in range(len(points)):
                mine = [x for (_, x), o in zip(ok, owner) if o == j]
                if mine:
                    points[j] = [sum(c) // len(mine) for c in zip(*mine)]
    near = [far(x, points[o]) for (_, x), o in zip(ok, owner)]
    cost = [sum(d for d, o in zip(near, owner) if o == j) for j in range(len(points))]
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return [(i, o, d, cost[o], sum(cost), digest[o]) for (i, _), o, d in zip(ok, owner, near)]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_clusters_are_those_of_plain_rounds(spark):
    rows = odd(vectors())
    frame = spark.createDataFrame(rows, DDL)
    want = order(plain(rows))
    assert order(centroids.cluster(frame).collect()) == want
    assert order(centroids.cluster(frame.repartition(3), block=37).collect()) == want


def test_few_vectors_huge_components_and_no_rows(spark):
    make = lambda rows: centroids.cluster(spark.createDataFrame(rows, DDL)).collect()
    few = vectors(5)
    assert order(make(few)) == order(plain(few)) and make([]) == [] and make([(1, None, "x")]) == []
    alike = [(i, few[0][1], "x") for i in range(30)]
    assert {(r["cluster"], r["distance"]) for r in make(alike)} == {(0, 0)}
    huge = make([(i, [1e30 * (-1) ** i, *[0.0] * 63], "x") for i in range(40)])
    assert len(huge) == 40 and {r["distance"] for r in huge} == {0}


def test_only_expired_vectors_are_scanned_and_owners_stay_exact():
    r = np.random.default_rng(5)
    middle = r.integers(-300, 300, (8, 16))
    x = middle[r.integers(0, 8, 3000)] + r.integers(-40, 40, (3000, 16))
    block, now = centroids.Block(x.astype(np.int64), 8), centroids.Centroids((middle + r.integers(-30, 30, (8, 16))).tolist())
    sums = np.zeros((8, 17), np.int64)
    scanned = []
    for _ in range(6):
        sums += block.assign(now)
        scanned.append(block.scanned)
        exact = ((x[:, None, :] - np.array(now.points)) ** 2).sum(axis=2).argmin(axis=1)
        assert (block.owner == exact).all() and sum(map(len, block.heaps)) == len(x)
        assert (sums[:, -1] == np.bincount(exact, minlength=8)).all()
        now = now.moved(sums[:, :-1].tolist(), sums[:, -1].tolist())
    assert scanned[0] == 3000 and scanned[-1] < 300


def test_wide_and_narrow_distances_agree():
    r = np.random.default_rng(6)
    x, c = r.integers(-(1 << 26), 1 << 26, (20, 64)), r.integers(-(1 << 26), 1 << 26, (4, 64))
    exact = [[sum((a - b) ** 2 for a, b in zip(p, q)) for q in c.tolist()] for p in x.tolist()]
    assert centroids.squared(x, c).tolist() == exact
    small = [[sum((a - b) ** 2 for a, b in zip(p, q)) for q in (c >> 16).tolist()] for p in (x >> 16).tolist()]
    assert centroids.squared(x >> 16, c >> 16).tolist() == small
    assert (centroids.unpacked(centroids.packed(x), 64, 20) == x).all() and (centroids.unpacked(centroids.packed(x >> 16), 64, 20) == x >> 16).all()
