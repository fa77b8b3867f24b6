"""Ball-tree clustering against plain rounds of k-means over integers."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from harvest.llm import centroids


def brute(rows, k=40, rounds=5, dimension=64, scale=256):
    kept = [(i, np.floor(np.array(v, float) * scale).astype(object)) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, np.array([int(x) for x in v], object)) for i, v in kept]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v.tolist()) for i, v in kept if i is not None)[:k]
    c = [np.array(v, object) for _, v in first]
    near = lambda v: min((int(((v - x) ** 2).sum()), n) for n, x in enumerate(c))[::-1]
    for _ in range(rounds):
        own = [near(v)[0] for _, v in kept]
        c = [np.array([int(s) // own.count(n) for s in sum(v for (_, v), o in zip(kept, own, strict=True) if o == n)], object) if n in own else x for n, x in enumerate(c)]
    got = [(i, *near(v)) for i, v in kept]
    total = {n: sum(d for _, o, d in got if o == n) for n in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, n, d, total[n], sum(total.values()), sha[n]) for i, n, d in got), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    tight = rng.normal(size=(8, 64)) * 4  # clusters that whole balls belong to
    made = [(i, (tight[i % 8] + rng.normal(size=64) * 0.02).tolist()) for i in range(300)]
    made += [(300 + i, rng.normal(size=64).tolist()) for i in range(60)]
    made += [(7, made[7][1]), (7, [0.5] * 64), (None, [0.25] * 64), (900, None), (901, [1.0] * 63), (902, [float("nan")] * 64), (903, [None] + [0.0] * 63), (904, []), (905, [float("inf")] * 64), (906, [0.0] * 64), (907, [0.0] * 64)]
    return made


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "'x' AS distance", "2 AS v", "3 AS n")


@pytest.mark.parametrize("block", [16, 8192])
def test_equals_plain_rounds(spark, rows, block):
    assert rows_of(centroids.cluster(frame(spark, rows).repartition(3), block=block)) == brute(rows)


def test_few_vectors_ties_and_empty(spark):
    few = [(i, [float(i % 2)] * 64) for i in range(5)]
    assert rows_of(centroids.cluster(frame(spark, few))) == brute(few)
    assert centroids.cluster(frame(spark, [(1, None)])).collect() == [] and centroids.cluster(frame(spark, few).limit(0)).collect() == []
    with pytest.raises(ValueError):
        centroids.cluster(frame(spark, [(1, [1e9] * 64)])).collect()


def test_whole_balls_go_to_one_centroid(rows):
    v = np.floor(np.array([v for _, v in rows[:300]]) * 256).astype(np.int64)
    tree, order = centroids.BallTree.build(v, leaf=8)
    assert sorted(order.tolist()) == list(range(300)) and (tree.rows == v[order]).all()
    parts = list(tree.filtered(v[:8]))
    covered = np.concatenate([np.arange(tree.first[n], tree.end[n]) for n, _ in parts])
    assert sorted(covered.tolist()) == list(range(300))
    assert any(tree.left[n] >= 0 and len(c) == 1 for n, c in parts)  # an inner ball, taken by its count and sum
    cluster, distance = centroids.assigned(tree, v[:8])
    d = np.square(v[order][:, None] - v[None, :8]).sum(axis=2)
    assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    sums, counts = np.zeros((8, 64), np.int64), np.zeros(8, np.int64)
    centroids.totals(tree, v[:8], sums, counts)
    assert all((sums[k] == v[order][cluster == k].sum(axis=0)).all() and counts[k] == (cluster == k).sum() for k in range(8))


def test_large_components_are_compared_in_integers():
    a, b = np.array([[centroids.MOST - 1, -3]]), np.array([[1 - centroids.MOST, 4], [centroids.MOST - 2, -3]])
    assert centroids.squared(a, b).tolist() == [[(2 * centroids.MOST - 2) ** 2 + 49, 1]]
