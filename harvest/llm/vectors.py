"""What the two vector searches share: clean vectors by dimension, cells of bounded size, and merging of partial top-k lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: Bytes of numbers that one side of a cell holds: what one task has in memory twice.
CELL_BYTES = 32 << 20
#: Dimensions that a table may mix; each is searched by itself.
MOST_DIMENSIONS = 64
FOUND = "query long, query_id long, vec_id long, row long, score {}"


def valid(df: DataFrame, vec_id: str, embedding: str, zeros: bool) -> tuple[DataFrame, dict[int, int]]:
    """A table (row, vec_id, v array<double>) and how many vectors each dimension has.

    Null vectors, empty ones, such with null or non-finite components, without an id, and (unless asked for) zero vectors
    take no part. ``row`` tells rows apart, also where ids repeat.
    """
    v = F.col(embedding).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad)
    if not zeros:
        out = out.where(F.exists("v", lambda x: x != 0))
    out = table(out.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))
    sizes = {r[0]: r[1] for r in out.groupBy(F.size("v")).count().limit(MOST_DIMENSIONS + 1).collect()}
    if len(sizes) > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} dimensions in one table")
    return out, sizes


def blocks_for(rows: int, dimension: int, least: int = 1, rows_of: int | None = None) -> int:
    """Blocks that keep ``rows`` vectors within CELL_BYTES (or ``rows_of`` rows) each, and ``least`` if there are rows enough."""
    most = rows_of or max(1, CELL_BYTES // (8 * dimension))
    return max(1, math.ceil(rows / most), min(least, math.ceil(rows / 1024)))


def matrix(column: pa.ChunkedArray, dimension: int, dtype=np.float64) -> np.ndarray:
    """A column of lists of one dimension as a matrix."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return (np.concatenate(flat) if flat else np.zeros(0)).reshape(-1, dimension).astype(dtype, copy=False)


def best_of(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id, then row: partition selection, then a sort of what is left."""
    if len(scores) > k:
        worst = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= worst)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((rows[at], ids[at], -scores[at]))][:k]


def found(query: int, query_id: int, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int, out: list) -> None:
    """Appends the columns of FOUND of one query's best candidates; its own row is none of them."""
    other = rows != query
    if not other.all():
        ids, rows, scores = ids[other], rows[other], scores[other]
    at = best_of(scores, ids, rows, k)
    out.append((np.full(len(at), query), np.full(len(at), query_id), ids[at], rows[at], scores[at]))


def frame(out: list, kind: pa.DataType) -> pa.Table:
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
    types = [pa.int64()] * 4 + [kind]
    return pa.table([pa.array(c.astype(t.to_pandas_dtype(), copy=False), t) for c, t in zip(cols, types, strict=True)], names=["query", "query_id", "vec_id", "row", "score"])


def merged(parts: DataFrame, k: int) -> DataFrame:
    """The k best of each query row's partial lists: at most k rows a block come in, so no query is a hot key."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
