"""Token ids in training order, in binary shards of fixed stride.

Documents become sequences of at most ``length`` tokens. A first pass counts each input partition's sequences, so
that each has an index among all n; a second pass tokenises again and writes. A keyed Feistel network over the
smallest even number of bits, with cycle-walking, permutes 0 .. n - 1: the image of a sequence's index is its global
slot. Equal ranges of slots are the shards, so that slot s is record ``s % records`` of shard ``s // records``
(only the last shard may be shorter), and a reader goes on anywhere by seeking.

A record has its slot, the document's id (8 bytes each), the piece, the number of ids (4 bytes each), ``length``
unsigned 16-bit ids, padded with the end id, and a line feed; numbers are little-endian. Record r of a shard is at byte
``r * stride``. Files are written by Spark's own committer to any file system that it knows, and read back in
splits of whole records, so that no task has a shard in memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, mix, multipliers, shared_dir, small_batches, table, whole_texts
from .span_ids import ByteIds

LENGTH = 256
#: Records of a shard (70 MB at 256 ids): what one task sorts.
RECORDS = 1 << 17
END_ID = 50256
#: Bytes of text that are encoded at once (one document at least).
ENCODED_BYTES = 1 << 18
#: Tasks that write at most; a task writes its shards one after the other.
MOST_TASKS = 1 << 15
#: The piece's top bit tells a null doc_id.
_NULL = 1 << 31
_HEAD = np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("piece", "<u4"), ("n", "<u4")])
_ENCODERS: dict[str, ByteIds] = {}
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The place of each index in a keyed permutation of 0 .. n - 1."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, keys = np.uint64((1 << half) - 1), mix(multipliers(rounds) + np.uint64(key % (1 << 64)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return left << np.uint64(half) | right

    out = once(np.asarray(index, np.uint64))
    while len(far := np.flatnonzero(out >= np.uint64(n))):  # walk on along the cycle until it is back in range
        out[far] = once(out[far])
    return out.astype(np.int64)


def _documents(batches, path: str, pattern: str, end_id: int | None = None):
    """Runs of rows: doc_ids, all ids (each row's with the end id) and where rows begin; without an end id the numbers of ids."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteIds(path, pattern)
    for b in batches:
        for first, stop, data, offsets in chunks(b.column("text"), ENCODED_BYTES):
            doc = b.column("doc_id").slice(first, stop - first)
            yield (doc, _ENCODERS[path].count(data, offsets)) if end_id is None else (doc, *_ENCODERS[path].encode(data, offsets, end_id))


def _pack(ids: np.ndarray) -> bytes:
    """The high and the low bytes apart, compressed: for the way through the shuffle."""
    return _ZIP.compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 2).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_UNZIP.decompress(data), np.uint8).reshape(2, -1).T).view("<u2").ravel()


def stride(length: int = LENGTH) -> int:
    return _HEAD.itemsize + 2 * length + 1


@contextmanager
def _fixed_splits(spark: SparkSession) -> Iterator[None]:
    """Meanwhile the number of cores, which may change, doesn't change how files are split."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, before or spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)


def materialise(docs: DataFrame, path: str, tokenizer: str, pattern: str, key: int = 17, length: int = LENGTH, records: int = RECORDS, end_id: int = END_ID) -> int:
    """Write the shards of (doc_id, text) below ``path``, which must not be there yet; how many sequences there are.

    A null or empty text is one sequence with the end id alone; repeated rows are written as often as they
    occur; a null doc_id stays null; an empty table writes no shard. The vocabulary must fit 16 bits. Both
    passes must see the same rows in the same partitions: file splits are held fixed meanwhile, inputs that
    come from a shuffle are written first, and the job fails if a partition's rows or sequences differ.
    """
    spark = docs.sparkSession
    own = whole_texts(docs)
    with small_batches(spark), _fixed_splits(spark):
        if "Exchange" in own._jdf.queryExecution().executedPlan().toString():
            own = table(own)

        def count(batches):
            rows = found = 0
            for doc, per in _documents(batches, tokenizer, pattern):
                rows, found = rows + len(doc), found + int((per // length + 1).sum())
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([rows]), pa.array([found])], names=["part", "rows", "found"])

        base, total = {}, 0
        for r in sorted(own.mapInArrow(count, "part long, rows long, found long").collect()):  # a row for each input partition
            base[r["part"]] = (total, r["rows"], r["found"])
            total += r["found"]
        if not total:
            return 0
        known = spark.sparkContext.broadcast(base)

        def send(batches):
            part = TaskContext.get().partitionId()
            (at, rows, found), seen, sent = known.value.get(part, (0, 0, 0)), 0, 0
            for doc, ids, begin in _documents(batches, tokenizer, pattern, end_id):
                pieces = -(-np.diff(begin) // length)
                row = np.repeat(np.arange(len(doc)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = begin[row] + piece * length
                end = np.minimum(first + length, begin[row + 1])
                place = feistel(at + sent + np.arange(len(row)), total, key)
                seen, sent = seen + len(doc), sent + len(row)
                if seen > rows or sent > found:
                    break
                short = ids.astype("<u2")
                data = [_pack(short[i:j]) for i, j in zip(first.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(place // records), doc.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(data, pa.binary())], names=["place", "shard", "doc_id", "piece", "ids"])
            if (seen, sent) != (rows, found):
                raise RuntimeError(f"partition {part} has {seen} rows and {sent} sequences, and had {rows} and {found}")

        def write(batches):
            _ENCODERS.clear()  # tokenising is over: its tables leave the worker
            for b in batches:
                n = b.num_rows
                rows = np.zeros(n, np.dtype([("head", _HEAD), ("ids", "<u2", (length,))]))
                rows["ids"] = end_id
                doc = b.column("doc_id")
                rows["head"]["slot"] = b.column("place").to_numpy()
                rows["head"]["doc_id"] = doc.fill_null(0).to_numpy()
                rows["head"]["piece"] = b.column("piece").to_numpy() + np.where(doc.is_null().to_numpy(zero_copy_only=False), _NULL, 0)
                for r, data in enumerate(b.column("ids").to_pylist()):
                    ids = _unpack(data)
                    rows["ids"][r, : len(ids)] = ids
                    rows["head"]["n"][r] = len(ids)
                offsets = np.arange(n + 1, dtype=np.int32) * rows.itemsize
                yield pa.RecordBatch.from_arrays([b.column("shard"), pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])], names=["shard", "value"])

        tasks = min(-(-total // records), MOST_TASKS)
        sent = own.mapInArrow(send, "place long, shard long, doc_id long, piece int, ids binary")
        sent = sent.repartitionById(tasks, (F.col("shard") % tasks).cast("int")).sortWithinPartitions("shard", "place")
        sent.mapInArrow(write, "shard long, value binary").select("shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)
        return total


def read_records(spark: SparkSession, path: str, first: int = 0, end: int | None = None, length: int = LENGTH, records: int = RECORDS) -> DataFrame:
    """(slot, shard, offset, doc_id, piece, n_tokens, ids binary) of slots ``first`` to ``end``; only their shards are read."""
    kind = np.dtype([("head", _HEAD), ("ids", "<u2", (length,)), ("line", "u1")])

    def run(batches):
        for b in batches:
            value = b.column("value")
            rows = np.frombuffer(value.buffers()[2], kind, len(value), value.offset * kind.itemsize)
            slot = rows["head"]["slot"]
            rows = rows[(slot >= first) & (slot < (1 << 62 if end is None else end))]
            head, slot = rows["head"], rows["head"]["slot"]
            none = head["piece"] >= _NULL
            cols = [pa.array(slot), pa.array(slot // records), pa.array(slot % records * kind.itemsize), pa.array(head["doc_id"], mask=none), pa.array((head["piece"] & (_NULL - 1)).astype(np.int32)), pa.array(head["n"].astype(np.int64))]
            ids = [x[:n].tobytes() for x, n in zip(rows["ids"], head["n"].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary())], names=["slot", "shard", "offset", "doc_id", "piece", "n_tokens", "ids"])

    shards = "*" if end is None else "{" + ",".join(str(k) for k in range(first // records, (end - 1) // records + 1)) + "}"
    found = spark.sparkContext._jsc.binaryRecords(f"{path}/shard={shards}", kind.itemsize)
    values = DataFrame(spark._jsparkSession.createDataset(found.rdd(), spark._jvm.org.apache.spark.sql.Encoders.BINARY()), spark)
    return values.mapInArrow(run, "slot long, shard long, offset long, doc_id long, piece int, n_tokens long, ids binary")


def training_order(docs: DataFrame, tokenizer: str, pattern: str, path: str | None = None, key: int = 17, length: int = LENGTH, records: int = RECORDS, end_id: int = END_ID) -> DataFrame:
    """Materialise, and read back (slot, shard, offset, doc_id, piece, n_tokens, ids_crc32) of each record."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/shards"
    schema = "slot long, shard long, offset long, doc_id long, piece int, n_tokens long, ids_crc32 long"
    if not materialise(docs, path, tokenizer, pattern, key, length, records, end_id):
        return spark.createDataFrame([], schema)

    def crc(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([zlib.crc32(x) for x in b.column("ids").to_pylist()], pa.int64())], names=[*b.schema.names[:-1], "ids_crc32"])

    return read_records(spark, path, length=length, records=records).mapInArrow(crc, schema)
