"""Exact top-k search over integer vectors by exhaustive term-at-a-time accumulation.

Vectors are sparse rows: each dimension is a term with the weight floor(scale * x), zero weights are
left out. Candidates lie in blocks of bounded size, each with postings per term. Query rows are taken
in chunks: for each term of any query, its weighted postings are scattered into dense score arrays
(candidates x queries). Partition selection gives each query's best of the block; a window merges blocks.
Every query meets every candidate: blocks of queries and of candidates form a grid, one task a cell. Blocks are as
large as memory allows: a block of b queries is multiplied with each candidate that is sent to it, so what is sent
shrinks against the work as b grows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import FOUND, blocks_for, found, frame, matrix, merged, valid

#: Queries whose score arrays are filled together.
QUERY_CHUNK = 128
#: Candidates whose scores lie together in a processor's cache.
ROWS = 1024


def postings(weights: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Of each term the rows that have it and their weights; a list of over half the rows has all rows (None), 0 for the rest."""
    out: list = []
    for t in range(weights.shape[1]):
        rows = np.flatnonzero(weights[:, t])
        out.append((None, np.ascontiguousarray(weights[:, t])) if 2 * len(rows) > len(weights) else (rows, weights[rows, t]))
    return out


def accumulate(lists: list[tuple[np.ndarray | None, np.ndarray]], queries: np.ndarray, n: int) -> np.ndarray:
    """Scores (n candidates x queries): for each term the weighted postings are added to the queries that have it."""
    scores = np.zeros((n, len(queries)), queries.dtype)
    part = np.empty_like(scores)
    for t, (rows, weights) in enumerate(lists):
        q = np.ascontiguousarray(queries[:, t])
        if not len(weights) or not q.any():
            continue
        if rows is None:
            np.multiply(weights[:, None], q[None], out=part)
            scores += part
        else:
            has = np.flatnonzero(q)
            scores[np.ix_(rows, has)] += weights[:, None] * q[None, has]
    return scores


def exact_topk(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score long): the k candidates of largest integer inner product of each query.

    Queries are the rows whose id ``every`` divides, candidates all rows but the query's own; ties go to the smaller
    id; with fewer candidates, all of them. Null vectors and such with null or non-finite components, and rows
    without an id, take no part; zero vectors do (score 0). A repeated vec_id is a candidate, and has a list, as often as
    it occurs. Vectors meet those of their own dimension. Raises where a score might pass 63 bits.
    """
    base, sizes = valid(vectors, vec_id, embedding, zeros=True)
    widest = base.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x * scale))))).first()[0] if sizes else 0.0
    cores, parts = base.sparkSession.sparkContext.defaultParallelism, []
    for dimension, n in sorted(sizes.items()):
        bound = (int(widest) + 1) ** 2 * dimension
        if bound >= 2**63:
            raise ValueError(f"scores of vectors with components up to {widest / scale} may pass 63 bits")
        parts.append(_searched(base.where(F.size("v") == dimension), dimension, n, k, scale, every, np.int32 if bound < 2**31 else np.int64, block, cores))
    if not parts:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return merged(reduce(DataFrame.unionByName, parts), k)


def _searched(base: DataFrame, dimension: int, n: int, k: int, scale: int, every: int, dtype, block: int | None, cores: int) -> DataFrame:
    """Partial lists (FOUND) of the vectors of one dimension."""
    weights = base.select("row", "vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("w"))
    q_blocks = blocks_for(base.where(F.col("vec_id") % every == 0).count(), dimension, 1, block)
    blocks, spread = blocks_for(n, dimension, -(-2 * cores // q_blocks), block), F.xxhash64("row")
    queries = weights.where(F.col("vec_id") % every == 0).withColumn("_h_q", F.pmod(spread, F.lit(q_blocks)).cast("int"))
    queries = queries.withColumn("_h_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    candidates = weights.withColumn("_h_b", F.pmod(spread, F.lit(blocks)).cast("int")).withColumn("_h_q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list = []
        if left.num_rows and right.num_rows:
            (q_rows, q_ids), (rows, ids) = [[x.column(c).to_numpy() for c in ("row", "vec_id")] for x in (left, right)]
            q, w = (matrix(x.column("w"), dimension, dtype) for x in (left, right))
            lists = [(first, postings(w[first : first + ROWS])) for first in range(0, len(w), ROWS)]
            for i in range(0, len(q), QUERY_CHUNK):
                own = q[i : i + QUERY_CHUNK]
                scores = np.empty((len(own), len(w)), dtype)
                for first, part in lists:
                    scores[:, first : first + ROWS] = accumulate(part, own, min(ROWS, len(w) - first)).T
                for j, s in enumerate(scores):
                    found(q_rows[i + j], q_ids[i + j], ids, rows, s, k, out)
        return frame(out, pa.int64())

    key = ["_h_b", "_h_q"]
    return queries.groupBy(key).cogroup(candidates.groupBy(key)).applyInArrow(cell, FOUND.format("long"))
