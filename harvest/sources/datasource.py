"""Pages as a data source of Spark: ``spark.read.format("harvest_pages").option("addresses", folder).option("getter", "module:name").load()``.

The addresses are a folder that ``plan`` writes, with a part for each bucket of hosts. A part is one partition of the source: the
driver lists folders, no address. All of a host's addresses lie in one part, in mixed order with those of others, so the client's limits
hold for each host, however many tasks run, and a task goes on with other hosts while one waits.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import url as U
from . import fetch

NAME = "harvest_pages"


def plan(urls: DataFrame, folder: str, buckets: int, url: str = "url") -> None:
    """Write addresses as the folder that the source reads: by bucket of their hosts, each bucket in an order that mixes hosts."""
    own = urls.select(F.col(url).cast("string").alias("url"))
    own = own.withColumn("bucket", F.pmod(F.xxhash64(U.host_of(F.coalesce("url", F.lit("")))), F.lit(buckets)).cast("int"))
    own.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.xxhash64("url")).write.partitionBy("bucket").parquet(folder)


class HostBucket(InputPartition):
    def __init__(self, folder: str):
        super().__init__(folder)


def _open(uri: str):
    """The file system of a shared folder and the path in it; Spark's file: is Arrow's file://."""
    from pyarrow import fs

    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return fs.FileSystem.from_uri(uri)


class PagesReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["addresses"]
        module, _, name = options["getter"].partition(":")
        self.getter = (module, name or "getter")
        kinds = {"rate": float, "burst": int, "attempts": int, "least_ms": float, "most_ms": float}
        self.limits = {k: kind(options[k]) for k, kind in kinds.items() if k in options}

    def partitions(self) -> list[HostBucket]:
        from pyarrow import fs

        files, path = _open(self.folder)
        found = files.get_file_info(fs.FileSelector(path))
        return [HostBucket(f.path) for f in sorted(found, key=lambda f: f.path) if f.base_name.startswith("bucket=")] or [HostBucket("")]

    def read(self, partition: HostBucket) -> Iterator:
        import pyarrow.dataset as ds

        if not partition.value:
            return
        part = ds.dataset(partition.value, filesystem=_open(self.folder)[0], format="parquet")
        getter = getattr(import_module(self.getter[0]), self.getter[1])
        addresses = (u for b in part.to_batches(columns=["url"], batch_size=fetch.WINDOW) for u in b.column("url").to_pylist())
        yield from fetch.batches_of(addresses, getter, fetch.Client(**self.limits))


class PagesSource(DataSource):
    """Options: addresses (a folder of ``plan``), getter (module:name of a ``fetch.Getter``), and a client's limits by name."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return fetch.SCHEMA

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)


def read(spark: SparkSession, addresses: str, getter: str, **limits) -> DataFrame:
    """(url, status, headers, html, attempts, error) of the planned addresses."""
    spark.dataSource.register(PagesSource)
    return spark.read.format(NAME).options(addresses=addresses, getter=getter, **limits).load()
