"""Approximate nearest neighbours by learned partitions.

Fitting, on a bounded sample: the exact neighbour graph of the sample is cut into balanced partitions
(few edges cross, no partition exceeds its share by more than a slack), then a small softmax classifier
learns to tell a vector's partition. Indexing, over every row: the classifier assigns each vector to its
most probable partition. Search: each query goes to its most probable partitions, and all their vectors are
reranked by the exact inner product. How much probability the visited partitions must hold is measured on sample rows
kept from fitting, for a wanted recall. Partitions grow in number with the rows, and large ones are split into cells
by a hash of the row, so no task holds an unbounded one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .vectors import FOUND, blocks_for, found, frame, matrix, merged, valid

#: Rows of a partition, about, and the least and greatest number of partitions.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 4096, 16, 256
#: Vectors that the index is fitted on, for each partition, about, and of these the share that only measures (one in).
SAMPLE, ASIDE = 256, 8
#: Of most of the sample's neighbours this share must be found.
RECALL = 0.95
NEIGHBOURS = 12
#: Products that the driver holds at once while it fits (32 MB).
SLICE = 1 << 22


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row by inner product (ties in any order)."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    step = max(1, SLICE // max(1, len(x)))
    for i in range(0, len(x), step):
        s = x[i : i + step] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + step] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_partition(graph: np.ndarray, x: np.ndarray, parts: int, rounds: int = 20, slack: float = 1.1, seed: int = 7) -> np.ndarray:
    """Labels of a balanced cut: seeds far apart, then rounds in which each row moves to the partition that most
    of its neighbours (both ways) have, the surest first, as long as that partition has room."""
    n, rng = len(x), np.random.default_rng(seed)
    room = int(np.ceil(slack * n / parts))
    centres = [int(rng.integers(n))]
    near = x @ x[centres[0]]
    for _ in range(parts - 1):
        centres.append(int(near.argmin()))
        near = np.maximum(near, x @ x[centres[-1]])
    score = x @ x[centres].T
    labels = np.full(n, -1)
    rows = np.repeat(np.arange(n), graph.shape[1])
    for _ in range(rounds):
        order = np.argsort(-(np.partition(score, -2, axis=1)[:, -1] - np.partition(score, -2, axis=1)[:, -2]) if parts > 1 else np.zeros(n), kind="stable")
        ranked, used, new = np.argsort(-score, axis=1, kind="stable"), np.zeros(parts, np.int64), np.empty(n, np.int64)
        for i in order:
            for p in ranked[i]:
                if used[p] < room:
                    used[p] += 1
                    new[i] = p
                    break
        if (new == labels).mean() > 0.999:
            break
        labels = new
        votes = np.zeros((n, parts))
        np.add.at(votes, (rows, labels[graph.ravel()]), 1)
        np.add.at(votes, (graph.ravel(), labels[rows]), 1)
        mean = np.stack([x[labels == p].mean(axis=0) if (labels == p).any() else x[rng.integers(n)] for p in range(parts)])
        score = votes / max(1, graph.shape[1]) + 0.5 * x @ mean.T / max(1e-12, np.abs(x @ mean.T).max())
    return labels


@dataclass
class Router:
    """One hidden layer of rectified units and a softmax over partitions."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, soft: np.ndarray, hidden: int = 64, epochs: int = 60, seed: int = 3) -> Router:
        rng = np.random.default_rng(seed)
        d, k = x.shape[1], soft.shape[1]
        p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, k)), np.zeros(k)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 128):
                b = order[i : i + 128]
                h = np.maximum(x[b] @ p[0] + p[1], 0)
                g = (cls(*p).probabilities(x[b]) - soft[b]) / len(b)
                gh = (g @ p[2].T) * (h > 0)
                step += 1
                for j, grad in enumerate((x[b].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                    m[j] = 0.9 * m[j] + 0.1 * grad
                    v[j] = 0.99 * v[j] + 0.01 * grad**2
                    p[j] = p[j] - 0.005 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
        return cls(*p)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(base: DataFrame, dimension: int, rows: int, parts: int, k: int, recall: float = RECALL, sample: int | None = None) -> tuple[Router, float]:
    """The router, and the probability that visited partitions must hold together, from about ``sample`` rows by a hash.

    There are at most half as many partitions as rows to fit on. Without rows kept aside all partitions are visited.
    """
    u = F.pmod(F.xxhash64("row", F.lit("ann")), F.lit(1 << 30)) / float(1 << 30)
    got = base.where(u < (sample or SAMPLE * parts) / max(rows, 1)).select("row", "v").toArrow().sort_by("row")
    x = unit(matrix(got.column("v"), dimension))
    aside = np.arange(len(x)) % ASIDE == ASIDE - 1
    x, kept = x[~aside], x[aside]
    parts = max(1, min(parts, len(x) // 2))
    if not len(x):
        return Router(np.zeros((dimension, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), np.inf
    graph = neighbour_graph(x, NEIGHBOURS)
    labels = balanced_partition(graph, x, parts)
    soft = np.zeros((len(x), parts))  # a row's own partition and where its neighbours lie
    soft[np.arange(len(x)), labels] = 0.5
    np.add.at(soft, (np.repeat(np.arange(len(x)), graph.shape[1]), labels[graph.ravel()]), 0.5 / max(1, graph.shape[1]))
    router = Router.fit(x, soft / soft.sum(axis=1, keepdims=True))
    if not len(kept) or recall >= 1:
        return router, np.inf
    p = router.probabilities(kept)
    order = np.argsort(-p, axis=1, kind="stable")
    ranked = np.take_along_axis(p, order, axis=1)
    before = np.empty_like(p)  # what a query has seen before it comes to a partition
    np.put_along_axis(before, order, np.cumsum(ranked, axis=1) - ranked, axis=1)
    near = nearest(kept, x, k)
    home = router.probabilities(x).argmax(axis=1)
    return router, float(np.quantile(np.take_along_axis(before, home[near], axis=1), recall)) + 1e-9


def nearest(queries: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of x of each query, in any order: slices of the products, so memory doesn't grow with the queries."""
    k = min(k, len(x))
    out, step = np.empty((len(queries), k), np.int64), max(1, SLICE // max(1, len(x)))
    for i in range(0, len(queries), step):
        s = queries[i : i + step] @ x.T
        out[i : i + step] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(x) else np.arange(k)
    return out


def ann_search(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL, parts: int | None = None, block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score double): the k found candidates of largest inner product of each query.

    Queries are the rows whose id ``every`` divides, candidates all rows but the query's own. Scores are the
    exact inner products of the original vectors in double precision; ties go to the smaller id. Vectors
    null, zero, or with null or non-finite components, and rows without an id, take no part. A repeated vec_id is a
    candidate, and has a list, as often as it occurs. Vectors meet those of their own dimension. Where the visited
    partitions hold fewer than k candidates but others exist, the query visits all partitions.
    """
    base, sizes = valid(vectors, vec_id, embedding, zeros=False)
    cores, lists = base.sparkSession.sparkContext.defaultParallelism, []
    for dimension, n in sorted(sizes.items()):
        wanted = parts or max(LEAST_PARTS, min(MOST_PARTS, n // PART_ROWS))
        lists.append(_searched(base.where(F.size("v") == dimension), dimension, n, wanted, k, every, recall, block, cores))
    if not lists:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return merged(reduce(DataFrame.unionByName, lists), k)


def _searched(base: DataFrame, dimension: int, n: int, parts: int, k: int, every: int, recall: float, block: int | None, cores: int) -> DataFrame:
    """Partial lists (FOUND) of the vectors of one dimension."""
    router, mass = fit(base, dimension, n, parts, k, recall)

    def assign(batches):
        for b in batches:
            p = router.probabilities(unit(matrix(pa.chunked_array([b.column("v")]), dimension)))
            order = np.argsort(-p, axis=1, kind="stable").astype(np.int32)
            ranked = np.take_along_axis(p, order, axis=1)
            visits = ((np.cumsum(ranked, axis=1) - ranked) < mass).sum(axis=1)
            queries = b.column("vec_id").to_numpy() % every == 0
            visited = [o[: v if q else 1] for o, v, q in zip(order, visits, queries, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("v"), pa.array(visited, pa.list_(pa.int32()))], names=["row", "vec_id", "v", "_h_visited"])

    routed = table(base.mapInArrow(assign, "row long, vec_id long, v array<double>, _h_visited array<int>"))
    index = routed.select("row", "vec_id", "v", F.col("_h_visited")[0].alias("_h_p"))
    sizes = {r[0]: r[1] for r in index.groupBy("_h_p").count().collect()}  # at most `parts` rows
    number = lambda of: F.coalesce(F.create_map(*[F.lit(x) for p, c in of.items() for x in (p, c)])[F.col("_h_p")], F.lit(0))
    held = F.create_map(*[F.lit(x) for p, c in sizes.items() for x in (p, c)])
    every_part = F.array(*[F.lit(p) for p in sorted(sizes)])
    reach = F.aggregate("_h_visited", F.lit(0).cast("long"), lambda a, p: a + F.coalesce(held[p], F.lit(0)))
    queries = routed.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v", F.explode(F.when(reach > k, F.col("_h_visited")).otherwise(every_part)).alias("_h_p"))
    visitors = {r[0]: r[1] for r in queries.groupBy("_h_p").count().collect()}
    q_cells = {p: blocks_for(c, dimension, 1, block) for p, c in visitors.items()}
    cells = {p: blocks_for(c, dimension, -(-2 * cores // parts), block) for p, c in sizes.items()}
    if not q_cells:
        return base.sparkSession.createDataFrame([], FOUND.format("double"))
    spread, to = F.xxhash64("row"), lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    queries = queries.withColumn("_h_q", F.pmod(spread, number(q_cells)).cast("int")).withColumn("_h_n", number(cells)).where("_h_n > 0").withColumn("_h_b", to(F.col("_h_n"))).drop("_h_n")
    index = index.withColumn("_h_b", F.pmod(spread, number(cells)).cast("int")).withColumn("_h_n", number(q_cells)).where("_h_n > 0").withColumn("_h_q", to(F.col("_h_n"))).drop("_h_n")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list = []
        if left.num_rows and right.num_rows:
            (q_rows, q_ids), (rows, ids) = [[x.column(c).to_numpy() for c in ("row", "vec_id")] for x in (left, right)]
            q, x = (matrix(t.column("v"), dimension) for t in (left, right))
            slack = 1e-12 * dimension * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
            for i in range(0, len(q), 256):
                for j, s in enumerate(q[i : i + 256] @ x.T, i):
                    # the product of matrices may round by what else is in the block; what it lets pass is summed again by itself
                    at = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1] - slack[j]) if len(s) > k + 1 else np.arange(len(s))
                    found(q_rows[j], q_ids[j], ids[at], rows[at], np.einsum("nd,d->n", x[at], q[j]), k, out)
        return frame(out, pa.float64())

    key = ["_h_p", "_h_b", "_h_q"]
    return queries.groupBy(key).cogroup(index.groupBy(key)).applyInArrow(cell, FOUND.format("double"))
