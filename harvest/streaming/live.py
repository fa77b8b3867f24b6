"""Keyed state of streams: rows whose key the store lacks, once each, and a retry queue on event-time timers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState

from ..functions import errors

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start meanwhile keep their state in RocksDB, which timers and large key sets need; the setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Take what a stream has now and read what came out: rows written once by batch, also where a batch runs again."""
    spark = stream.sparkSession
    with on_disk(spark):
        query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


class _First(StatefulProcessor):
    """Whether a key was seen; of a batch's rows of a key the first in the order given is the one that counts."""

    def __init__(self, key: str, order: list[str], at: str | None, keep_ms: int | None, columns: list[str]):
        self.key, self.order, self.at, self.keep_ms, self.columns = key, order, at, keep_ms, columns

    def init(self, handle):
        self.handle, self.seen = handle, handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key, initialState, timerValues):
        self.seen.update((True,))

    def handleInputRows(self, key, rows, timerValues):
        if self.seen.exists():
            for _ in rows:  # a group's rows are read to the end
                pass
            return
        best = None
        for part in rows:
            part = part if best is None else pd.concat([best, part])
            best = part.sort_values(self.order, kind="stable").head(1)
        if best is not None:
            self.seen.update((True,))
            if self.keep_ms is not None:
                self.handle.registerTimer(int(best[self.at].iloc[0].timestamp() * 1000) + self.keep_ms)
            yield best[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.seen.clear()
        yield pd.DataFrame()

    def close(self):
        pass


def accepted(found: DataFrame, stored: DataFrame, key: str, order: list[str], at: str | None = None, keep_ms: int | None = None) -> DataFrame:
    """The rows of a stream whose ``key`` neither the store's rows nor an earlier row of the stream has: each key once.

    The store's keys are the stream's first state, so no batch reads the store again, and what was accepted is state too:
    a restarted query goes on from its checkpoint, and rows that come again are known. Of a batch's rows of one key
    the first by ``order`` counts. Rows without a key go. With ``keep_ms`` a key is forgotten once the watermark of ``at`` (a
    column that the stream has one for) has passed its row by so much; the store then has to stand behind it.
    State is kept by key over the shuffle's partitions. A key's rows are taken by batches of Arrow, one row kept.
    """
    own = found.where(F.col(key).isNotNull())
    keys = stored.select(F.col(key).cast(found.schema[key].dataType).alias(key)).where(F.col(key).isNotNull()).distinct()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    mode = ("append", "eventTime") if keep_ms is not None else ("append", "none")
    return own.groupBy(key).transformWithStateInPandas(_First(key, order, at, keep_ms, found.columns), schema, *mode, initialState=keys.groupBy(key))


class _Retries:
    """The retry queue of a bucket of jobs: of each job when it is due, what is known of it, and how its next attempt ends.

    A call for each job, with its own frames and its own ways to the state store, takes far longer than the few rows that it has, so jobs
    come by buckets: one call and one value of state, Arrow's bytes of the entries. The state's timeout is the bucket's next turn.
    """

    STATE = "jobs binary"
    CHANGES = "job_id {}, action string, retry_after long, at long"
    #: What an entry holds: microseconds that it says, milliseconds of its next turn, and the job.
    ENTRY = (("due", pa.int64()), ("turn", pa.int64()), ("known", pa.bool_()), ("applied", pa.bool_()), ("tried", pa.bool_()), ("error", pa.string()))
    EMPTY = (None, None, False, False, False, None)

    def __init__(self, wait_ms: int, tick_ms: int):
        self.wait_ms, self.tick_ms = wait_ms, tick_ms

    def _unpacked(self, packed: bytes | None) -> dict:
        if packed is None:
            return {}
        ids, *entries = (c.to_pylist() for c in pa.ipc.open_stream(packed).read_all().columns)
        return dict(zip(ids, zip(*entries, strict=True), strict=True))

    def _packed(self, jobs: dict) -> bytes:
        columns = [pa.array(list(jobs)), *(pa.array(c, kind) for c, (_, kind) in zip(zip(*jobs.values(), strict=True), self.ENTRY, strict=True))]
        all_jobs, out = pa.table(columns, names=["job_id", *(n for n, _ in self.ENTRY)]), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, all_jobs.schema) as writer:
            writer.write_table(all_jobs)
        return out.getvalue().to_pybytes()

    def _worked(self, jobs: dict, now: int) -> Iterator[tuple]:
        """The changes that working the due entries at a time makes."""
        for job, (due, turn, known, applied, tried, error) in list(jobs.items()):
            if turn is None or turn > now:
                continue
            limited = re.search(errors.LIMITED, (error or "").lower()) is not None
            action = "dequeue_missing" if not known else "dequeue_applied" if applied else "keep" if not tried else "applied" if not error else "requeue" if limited else "keep"
            stays = action in ("keep", "requeue")
            again = now + (self.wait_ms if action == "requeue" else self.tick_ms)
            until = (again * 1000 if action == "requeue" else due) if stays else None
            jobs[job] = (until, again if stays else None, known, applied or action == "applied", False, None)
            yield job, action, until, now * 1000

    def __call__(self, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, jobs = state.getCurrentWatermarkMs(), self._unpacked(*(state.getOption or (None,)))
        out = list(self._worked(jobs, now))  # due before these rows came, or without any
        rows = [r for p in parts if len(p) for r in zip(*(p[c].tolist() for c in ("at_us", "job_id", "kind", "until_us", "applied", "error")), strict=True)]
        for at, job, kind, until, flag, text in sorted(rows, key=lambda r: (r[0] != r[0], r[0])):
            due, turn, known, applied, tried, error = jobs.get(job, self.EMPTY)
            if kind == "enqueue":
                due = int(until) if until == until else None
                turn = None if due is None else -(-due // 1000)  # a timer has milliseconds
                out.append((job, "queued", due, int(at) if at == at else None))
            elif kind == "job":
                known, applied = True, flag is True
            elif kind == "gone":
                known, applied = False, False
            elif kind == "outcome":
                tried, error = True, text
            jobs[job] = (due, turn, known, applied, tried, error)
        out += self._worked(jobs, now)  # queued for a time that has passed
        if rows or out:
            state.update((self._packed(jobs),))
        turns = [e[1] for e in jobs.values() if e[1] is not None]
        if turns:
            state.setTimeoutTimestamp(max(min(turns) - 1, 1))  # a timeout waits until the watermark is beyond it
        if out:
            job, action, until, at = zip(*out, strict=True)
            yield pd.DataFrame({"job_id": job, "action": action, "retry_after": pd.array(until, "Int64"), "at": pd.array(at, "Int64")})


def retries(log: DataFrame, wait_hours: int = 2, tick_minutes: int = 30, late: str = "0 seconds", buckets: int = 4096) -> DataFrame:
    """(job_id, action, retry_after, at): every change of the retry queue, as a stream.

    log: (job_id, at, kind, retry_after, applied, error), where kind is enqueue (with retry_after), job (with applied), gone, or outcome, how the
    next attempt ends (error, empty for none). An entry is a timer: once the watermark of ``at`` reaches it, it is
    worked as ``relational.retry_run`` works a due entry at that time. Behind a limit it waits ``wait_hours`` more, kept ones are
    due at the next tick; an outcome serves one attempt. ``retry_after`` is the entry's time while it stays, else null.
    State is kept by ``buckets`` of jobs, by their hash; a bucket's is written anew when one of its jobs changes, so with tens of millions of jobs take more.
    """
    times = F.unix_micros("at").alias("at_us"), F.unix_micros("retry_after").alias("until_us")
    own = log.select("job_id", F.col("at").cast("timestamp").alias("at"), "kind", F.col("retry_after").cast("timestamp").alias("retry_after"), "applied", "error").withWatermark("at", late)
    own = own.where("job_id is not null").select(F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("bucket"), "job_id", "at", *times, "kind", "applied", "error")
    job = log.schema["job_id"].dataType.simpleString()
    machine = _Retries(wait_hours * 3_600_000, tick_minutes * 60_000)
    changes = own.groupBy("bucket").applyInPandasWithState(machine.__call__, machine.CHANGES.format(job), machine.STATE, "append", "EventTimeTimeout")
    return changes.select("job_id", "action", *(F.timestamp_micros(c).alias(c) for c in ("retry_after", "at")))


def queue_of(changes: DataFrame) -> DataFrame:
    """(job_id, retry_after) of the queue that a log of changes leaves: each job's last one, if it stays."""
    last = changes.groupBy("job_id").agg(F.max_by(F.struct("action", "retry_after"), F.struct("at", F.col("action") != "queued")).alias("x"))
    return last.select("job_id", "x.retry_after").where("retry_after is not null")
