"""What the operators share: tables in the shared folder, and numpy kernels over Arrow text buffers.

Conventions of all operators: a null text counts as empty unless an operator's docstring says
otherwise; columns that an operator does not need are ignored, and internal columns start with ``_h_``
so that they don't clash with those of the input; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy kernel takes at once (one document at least, however long).
CHUNK_BYTES = 1 << 20
#: A key is hot when it has more than this share (one in HOT) of a join's rows.
HOT = 4096

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_LOCAL_DIRS: dict[str, str] = {}
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors and the driver share.

    Where that setting is absent a temporary folder takes its place, on a local master only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _LOCAL_DIRS.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="harvest-")
        _LOCAL_DIRS[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/harvest-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, limit: int = 8 << 20) -> Iterator[None]:
    """Jobs that run meanwhile send Python batches of at most ``limit`` bytes (a row at least); the setting is put back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, limit)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(df: DataFrame) -> DataFrame:
    """Write ``df`` in the shared folder and read it again: cuts the lineage, survives lost executors. ``drop`` deletes it, at last the application's end."""
    spark = df.sparkSession
    path = shared_dir(spark)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_h_path"] = path
    files, folder = _files(spark, path)
    files.deleteOnExit(folder)  # what a result still reads goes with the application
    return out


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, for the driver's Hadoop client."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def drop(*frames: DataFrame) -> None:
    """Delete the files of tables that ``table`` wrote and nothing reads any more."""
    for df in frames:
        files, path = _files(df.sparkSession, df.__dict__["_h_path"])
        files.delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner find what finished jobs left: it drops shuffle files when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def whole_texts(df: DataFrame, *columns, key: str = "doc_id") -> DataFrame:
    """(doc_id long, text string, columns) for Python, which gets them in batches that Spark bounds by bytes as by rows."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)


def kept(docs: DataFrame, decide) -> DataFrame:
    """The rows of docs, with all their columns, for which ``decide`` (a record batch to booleans) says so; no shuffle."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(decide(b), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column as strings, nulls where there is none of that name."""
    return batch.column(name).cast(pa.string()) if name in batch.schema.names else pa.nulls(batch.num_rows, pa.string())


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with ``groups``, which has one row a key and in ``_h_c`` how many of the rows are the key's.

    Keys with over 1 / HOT of these rows (fewer than HOT keys) are broadcast, all others meet by a shuffle.
    """
    total = groups.agg(F.sum("_h_c")).first()[0] or 0
    hot = F.col("_h_c") * HOT > total
    often = groups.where(hot).drop("_h_c")
    rest = rows.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(groups.where(~hot).drop("_h_c"), keys)
    return rest.unionByName(rows.join(F.broadcast(often), keys))


def _level(parts: DataFrame, kind, fan_in: int) -> DataFrame:
    """(part, block, value): sums by block of ``fan_in`` neighbouring parts, added in their order, so rounding doesn't depend on which comes first."""

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("of")
        value = sum(np.frombuffer(x.as_buffer(), kind) for x in group.column("value"))
        return pa.table([group.column("part")[:1], group.column("block")[:1], pa.array([np.asarray(value, kind).tobytes()], pa.binary())], names=["part", "block", "value"])

    return parts.withColumn("of", F.col("part")).withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("part", "block").applyInArrow(add, "part long, block long, value binary")


def tree_sums(parts: DataFrame, n: int, kind, fan_in: int = 64) -> DataFrame:
    """(part, block, value): the sums by block of arrays in ``value`` (binary), of parts 0 .. n - 1, at most ``fan_in`` at a time."""
    while True:
        n = -(-n // fan_in)
        parts = _level(parts, kind, fan_in)
        if n <= 1:
            return parts


def few_sums(parts: DataFrame, kind, fan_in: int = 64) -> dict[int, np.ndarray]:
    """The same by block, for a few blocks of small arrays and any number of parts: two levels, and what is left, a row for
    ``fan_in`` squared parts and block, is added in order on the driver."""
    with small_batches(parts.sparkSession):
        rows = sorted((r["block"], r["part"], r["value"]) for r in _level(_level(parts, kind, fan_in), kind, fan_in).collect())
    out: dict[int, np.ndarray] = {}
    for block, _, value in rows:
        out[block] = out.get(block, 0) + np.frombuffer(value, kind)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int) -> np.ndarray:
    """Odd constants without a common structure, the same everywhere."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS[kind]
    if len(have) < n:
        base = np.full(max(n, 2 * len(have)), _R if kind == "up" else _R_INV, np.uint64)
        base[0] = 1
        _POWERS[kind] = have = np.cumprod(base, dtype=np.uint64)
    return have[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; a null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes and at most ``rows``: first row, end row, bytes, offsets from 0."""
    data, offsets = text_buffer(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), n, first + rows)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words ``[^\\x20\\x09-\\x0D]+`` begin and end in the bytes, and where rows begin among the words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATORS[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of spans of bytes, after lower-casing A-Z: a polynomial modulo 2**64 by prefix sums, then splitmix64."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(((LOWER[data] if fold else data).astype(np.uint64) + np.uint64(1)) * _powers("up", n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers("down", n)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``span_hashes`` of all words, and where rows begin in them."""
    starts, ends, rows = word_spans(data, offsets)
    return span_hashes(data, starts, ends), rows


class Lookup:
    """Places in a sorted array of hashes: the top bits lead to the few that share them."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = keys, np.uint64(64 - max(8, min(20, int(len(keys)).bit_length() + 3)))
        top = (keys >> self.shift).astype(np.int64)
        size = np.bincount(top, minlength=1 << int(64 - self.shift))
        self.first, self.most = (np.cumsum(size) - size).astype(np.int32), int(size.max()) if len(keys) else 0

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each (0 where it isn't there), and whether it is there."""
        place, there = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        if not len(self.keys):
            return place, there
        base, last = self.first[(wanted >> self.shift).astype(np.int64)].astype(np.int64), len(self.keys) - 1
        for k in range(self.most):
            at = np.minimum(base + k, last)
            hit = self.keys[at] == wanted
            np.copyto(place, at, where=hit)
            there |= hit
        return place, there


def one_hash(word: bytes) -> int:
    """``word_hashes`` of one word."""
    return int(word_hashes(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0][0])


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a row, and where rows begin; a shorter row that has words gives one."""
    count = np.diff(rows)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    begins = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(begins[-1], np.uint64)
    k = multipliers(size)
    total = len(words)
    if total >= size:
        run = np.zeros(total - size + 1, np.uint64)
        for j in range(size):
            run += words[j : total - size + 1 + j] * k[j]
        row_of = np.repeat(np.arange(len(count)), count)
        whole = row_of[: total - size + 1] == row_of[size - 1 :]
        to = np.repeat(count >= size, made)
        out[to] = mix(run[whole])
    for r in np.flatnonzero((count > 0) & (count < size)):
        w = words[rows[r] : rows[r + 1]]
        out[begins[r]] = mix(np.array([sum(int(x) * int(k[j]) for j, x in enumerate(w)) + len(w) & (1 << 64) - 1], np.uint64))[0]
    return out, begins


def key_crc32(doc_id: str = "doc_id"):
    """crc32 of the id as text, as a column."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def crc32_of_ids(ids) -> np.ndarray:
    """The same over an array of ids."""
    return np.fromiter((zlib.crc32(str(x).encode()) for x in ids), np.int64, len(ids))
