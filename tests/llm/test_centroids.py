"""Centroid clustering against plain k-means in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from tallyloom.llm import centroids


def plain(rows, k=40, rounds=5, salt=2, dims=64):
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(min(1e300, max(-1e300, 256 * x))))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((distance(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), m in zip(kept, mine, strict=True) if m == j]
            c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else c[j]
    last = [near(v) for _, v in kept]
    sums = {}
    for d, j in last:
        sums[j] = sums.get(j, 0) + d
    return sorted(((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True)), key=repr)


def rows_of(seed, n, dims=64, centres=12, spread=0.05):
    draws = np.random.default_rng(seed)
    middles = draws.standard_normal((centres, dims))
    return [(i, [float(x) for x in np.float32(middles[i % centres] + spread * draws.standard_normal(dims))]) for i in range(n)]


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, lower int").repartition(3)
    return sorted((tuple(r) for r in centroids.clusters(df, **options).collect()), key=repr)


@pytest.mark.parametrize(("seed", "centres", "spread"), [(1, 12, 0.05), (2, 60, 0.3), (3, 3, 1.0)])
def test_clusters_equal_plain_k_means(spark, seed, centres, spread):
    rows = rows_of(seed, 400, centres=centres, spread=spread)
    assert got(spark, [(*r, "x", 1) for r in rows]) == plain(rows)


def test_odd_vectors_ties_and_repeated_rows(spark):
    rows = rows_of(4, 150)
    rows += [(200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 65), (204, [None] + [0.5] * 63), (205, [math.nan] + [0.5] * 63), (206, [math.inf] + [0.5] * 63)]
    rows += [(None, [0.25] * 64), (None, [-0.25] * 64), (207, [1e30] * 64), (207, [1e30] * 64), (208, [-1e305] * 64), (5, [0.0] * 64), (5, [-0.0] * 64)] + [(300 + i, [0.125] * 64) for i in range(40)]
    rows += rows[:20]
    assert got(spark, [(*r, None, None) for r in rows]) == plain(rows)


def test_few_vectors_make_as_many_clusters_and_none_give_none(spark):
    rows = rows_of(5, 3)
    assert got(spark, [(*r, "x", 1) for r in rows]) == plain(rows)
    assert got(spark, []) == []
    assert got(spark, [(1, None, "x", 1)]) == []


def test_other_sizes_and_scan_fewer_than_all_distances(spark):
    rows = rows_of(6, 300, dims=5, centres=25)
    assert got(spark, [(*r, "x", 1) for r in rows], k=25, dims=5, rounds=3, salt=9) == plain(rows, k=25, dims=5, rounds=3, salt=9)
    v = np.floor(256 * np.array([r[1] for r in rows_of(7, 3000, centres=40)])).astype(np.int64)
    c = v[:40].copy()
    groups = centroids.groups_of(c)
    now = centroids.Round(c, groups, np.zeros(40))
    state = now.first(v)
    moved = c + 1
    after = centroids.Round(moved, groups, np.sqrt(np.square(moved - c).sum(axis=1).astype(float)))
    mine, upper, lower = after.next(v, *state)
    d = centroids.squares(v, moved)
    assert (mine == d.argmin(axis=1)).all() and (np.sqrt(d.min(axis=1)) <= upper).all()
    d[np.arange(len(v)), mine] = np.iinfo(np.int64).max
    assert all((np.sqrt(d[:, groups == g].min(axis=1)) >= lower[:, g]).all() for g in range(groups.max() + 1))
    assert ((state[1] + after.moved[state[0]]) < (state[2] - after.far).min(axis=1)).mean() > 0.9  # stay without a look at a centroid
