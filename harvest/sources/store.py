"""Tables as versioned Parquet folders with a pointer: a write makes a new version and then moves the pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Store:
    """One writer; readers see the last complete version. Works on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = []
        for s in fs.listStatus(path):
            version = s.getPath().getName()
            if version.startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{version}/_SUCCESS")):
                done.append(int(version[1:]))
        return sorted(done)

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/v{self._versions(name)[-1]}")

    def write(self, name: str, df: DataFrame) -> None:
        """A version counts once Spark's committer has left its mark, so a failed write changes nothing."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{(self._versions(name) or [0])[-1] + 1}")
