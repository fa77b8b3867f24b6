"""Centroid clustering (k-means) of integer vectors by ball-tree filtering.

Every task builds metric trees over blocks of its own rows: a ball has its rows' radius, count and integer sum. In a
round the centroids meet the balls from the root down. By the triangle inequality a ball keeps only the centroids that
can be nearest to any of its rows; a ball with one left goes to it whole, by its count and sum, any other is opened, and
in leaves each row is compared exactly with the centroids left. Rows aren't shuffled: each task adds up at most one row
per centroid, and the driver sees the centroids alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table
from .vectors import matrix

#: Vectors of one tree: 4 MB of 64 integers each.
BLOCK = 8192
LEAF = 64
#: Components stay below this, so that no squared distance of up to 256 components passes 62 bits.
MOST = 1 << 26


@dataclass
class BallTree:
    """Rows in the tree's order; of each node its first and end row, left child (-1: leaf; the right one follows it), sum and radius."""

    rows: np.ndarray
    first: np.ndarray
    end: np.ndarray
    left: np.ndarray
    sums: np.ndarray
    radius: np.ndarray

    @classmethod
    def build(cls, rows: np.ndarray, leaf: int = LEAF) -> tuple[BallTree, np.ndarray]:
        """The tree, and which of the given rows lies at each of its places."""
        order, nodes = np.arange(len(rows)), [[0, len(rows), -1]]
        sums, radius, i = [], [], 0
        while i < len(nodes):
            first, end, _ = nodes[i]
            own = rows[order[first:end]]
            sums.append(own.sum(axis=0))
            x = own.astype(float)
            far = np.sqrt(np.square(x - sums[-1] / len(own)).sum(axis=1))
            radius.append(far.max())
            if len(own) > leaf and radius[-1] > 0:
                a = x[far.argmax()]
                b = x[np.square(x - a).sum(axis=1).argmax()]
                half = len(own) // 2
                order[first:end] = order[first:end][np.argpartition(x @ (b - a), half)]
                nodes[i][2] = len(nodes)
                nodes += [[first, first + half, -1], [first + half, end, -1]]
            i += 1
        first, end, left = np.array(nodes, np.int64).T
        return cls(rows[order], first, end, left, np.array(sums, np.int64), np.array(radius)), order

    def filtered(self, centroids: np.ndarray):
        """(first, end, numbers of the centroids that can be nearest) of balls that together are all rows; more than one only for leaves."""
        c = centroids.astype(float)
        squares = np.square(c).sum(axis=1)
        nodes, left_in = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
        while len(nodes):
            x = self.sums[nodes] / (self.end - self.first)[nodes, None]
            own = np.square(x).sum(axis=1)
            far = np.sqrt(np.maximum(own[:, None] - 2 * (x @ c.T) + squares, 0))
            slack = 1e-6 * (1 + np.sqrt(own.max() + squares.max()))  # far above what the sums round off
            nearest = np.where(left_in, far, np.inf).min(axis=1)
            left_in &= far <= (nearest + 2 * self.radius[nodes] + slack)[:, None]
            done = (left_in.sum(axis=1) == 1) | (self.left[nodes] < 0)
            for node, mask in zip(nodes[done], left_in[done], strict=True):
                yield node, np.flatnonzero(mask)
            further = self.left[nodes[~done]]
            nodes, left_in = np.concatenate([further, further + 1]), np.concatenate([left_in[~done]] * 2)


def squared(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x centroids): in doubles where all sums stay below 53 bits, else in integers."""
    widest = int(max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0))) + 1
    kind = np.float64 if 4 * widest * widest * rows.shape[1] < 1 << 53 else np.int64
    a, b = rows.astype(kind), centroids.astype(kind)
    return (np.square(a).sum(axis=1)[:, None] - 2 * (a @ b.T) + np.square(b).sum(axis=1)).astype(np.int64)


def assigned(tree: BallTree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and exact squared distance of each row of the tree."""
    cluster, distance = np.zeros(len(tree.rows), np.int32), np.zeros(len(tree.rows), np.int64)
    for node, which in tree.filtered(centroids):
        a, b = tree.first[node], tree.end[node]
        d = squared(tree.rows[a:b], centroids[which])
        best = d.argmin(axis=1)
        cluster[a:b], distance[a:b] = which[best], d[np.arange(b - a), best]
    return cluster, distance


def totals(tree: BallTree, centroids: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds each centroid's rows to its sum and count; a ball of one centroid adds its own without a look at its rows."""
    for node, which in tree.filtered(centroids):
        a, b = tree.first[node], tree.end[node]
        if len(which) == 1:
            sums[which[0]] += tree.sums[node]
            counts[which[0]] += b - a
            continue
        nearest = squared(tree.rows[a:b], centroids[which]).argmin(axis=1)
        for k in np.unique(nearest):
            of = nearest == k
            sums[which[k]] += tree.rows[a:b][of].sum(axis=0)
            counts[which[k]] += of.sum()


def _trees(vectors: DataFrame, dimension: int, block: int) -> DataFrame:
    """A table of trees, a row each, over blocks of the rows that a task has: nothing is shuffled."""

    def run(batches):
        for b in batches:
            for first in range(0, b.num_rows, block):
                cut = pa.Table.from_batches([b.slice(first, block)])
                tree, order = BallTree.build(matrix(cut.column("v"), dimension, np.int64))
                ids = cut.column("vec_id").combine_chunks().take(pa.array(order))
                parts = [pa.array([x.tobytes()], pa.binary()) for x in (tree.rows, tree.first, tree.end, tree.left, tree.sums, tree.radius)]
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), *parts], names=["ids", *_PARTS])

    return table(vectors.mapInArrow(run, "ids array<long>, " + ", ".join(f"{p} binary" for p in _PARTS)))


_PARTS = ("vectors", "first", "end", "left", "sums", "radius")


def _read(batches, dimension: int):
    """(ids, tree) of each row of the table of trees."""
    for b in batches:
        for i in range(b.num_rows):
            get = lambda name, kind: np.frombuffer(b.column(name)[i].as_buffer(), kind)
            rows, sums = (get(p, np.int64).reshape(-1, dimension) for p in ("vectors", "sums"))
            yield b.column("ids")[i].values, BallTree(rows, *(get(p, np.int64) for p in ("first", "end", "left")), sums, get("radius", float))


def _sums(trees: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, count, sum by component) of the centroids that have rows."""
    k, dimension = centroids.shape

    def run(batches):
        sums, counts = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64)
        for _, tree in _read(batches, dimension):
            totals(tree, centroids, sums, counts)
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(counts[has]), pa.array(list(sums[has]), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    parts = trees.mapInArrow(run, "cluster int, n long, s array<long>")
    return parts.groupBy("cluster").agg(F.sum("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(dimension)))).collect()


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dimension: int = 64, seed: str = "2", vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """RESULT of every vector of exactly ``dimension`` components, none null or non-finite; each component x counts as floor(scale * x).

    Centroids start as the k vectors of smallest sha256 of ``seed:vec_id``, in that order (equal ids: by their vectors),
    or as all of them where there are fewer. A round assigns every vector to the nearest centroid, ties to the smaller
    number, and moves each centroid that has vectors to the floor of their mean; then vectors are assigned once more.
    Repeated rows count as often as they occur. A vector without an id is clustered, but no first centroid. Other
    vectors take no part; none left, the result is empty. Raises where a component passes MOST.
    """
    spark, x = vectors.sparkSession, F.col(embedding).cast("array<double>")
    good = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(F.size("x") == dimension)
    good = good.where(~F.exists("x", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf"))))
    widest = good.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, b: F.greatest(a, F.abs(b * scale))))).first()[0]
    if widest is not None and widest >= MOST:
        raise ValueError(f"components of up to {widest} in units of 1/{scale}; squared distances may pass 63 bits")
    good = good.select("vec_id", F.transform("x", lambda a: F.floor(a * scale)).alias("v"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = good.where(F.col("vec_id").isNotNull()).orderBy(key, "v").limit(k).select("v").collect()
    if not start:
        return spark.createDataFrame([], RESULT)
    centroids = np.array([r[0] for r in start], np.int64)
    trees = _trees(good, dimension, block)
    for _ in range(rounds):
        moved = centroids.copy()
        for number, n, s in _sums(trees, centroids):
            moved[number] = [a // n for a in s]
        if np.array_equal(moved, centroids):  # no later round would move them either
            break
        centroids = moved

    def run(batches):
        for ids, tree in _read(batches, dimension):
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(a) for a in assigned(tree, centroids))], names=["vec_id", "cluster", "distance"])

    rows = table(trees.mapInArrow(run, "vec_id long, cluster int, distance long"))
    drop(trees)
    inertia = {r[0]: r[1] for r in rows.groupBy("cluster").agg(F.sum("distance")).collect()}
    about = [(c, n, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in inertia.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row per centroid: k at most
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
