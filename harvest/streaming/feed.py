"""Polling of feeds as a stream: each micro-batch is loaded by an idempotent merge into versioned tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import having, recent, upsert
from ..sources.store import Store


def run_feed(stream: DataFrame, store: Store, name: str, keys: list[str], update: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df, order: str | None = None, interval: str | None = None, checkpoint: str = "", on_new: Callable[[DataFrame], None] | None = None):
    """Start a query that merges each batch; without an interval it takes what is there and ends.

    Of rows with one key in a batch the last in ``order`` (a column that isn't stored; else in the batch's own order) gives
    the updates and the first all else; the first batch goes the same way. ``on_new`` gets the rows that the store
    lacked, once written: at least once each, as a batch may run again.
    """

    def load(batch: DataFrame, _: int) -> None:
        rows = prepare(batch)
        rows = rows.withColumnRenamed(order, "_pos") if order else rows.withColumn("_pos", F.monotonically_increasing_id())
        stored = store.read(name) if store.exists(name) else rows.drop("_pos").limit(0)
        store.write(name, upsert(stored, rows, keys, update, order="_pos"))
        if on_new is not None:
            on_new(having(store.read(name), stored.select(*keys), keys, there=False))

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def keep_recent(store: Store, name: str, rows: DataFrame, order: str, n: int = 100) -> None:
    """A bounded log: the new rows and the old ones, of which the last n stay."""
    whole = store.read(name).unionByName(rows) if store.exists(name) else rows
    store.write(name, recent(whole, order, n))


def replay(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)
