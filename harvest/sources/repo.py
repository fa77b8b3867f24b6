"""The store's tables: their types, additive migration, and the operations that read and change them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import url
from ..functions.text import key_id
from ..operators import relational as R
from .store import Store


def _schema(columns: str) -> T.StructType:
    kinds = {"string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(","))])


# Columns and types of the tables.
COMPANIES = _schema("id string, name string, careers_url string, active boolean, apply_email string, created_at timestamp, updated_at timestamp")
JOBS = _schema("id string, company_id string, aggregator_name string, title string, url string, apply_url string, apply_via_portal boolean, canonical_url string, location string, description string, hr_email string, hr_phone string, discovered_at timestamp, posted_at string, applied boolean, applied_at timestamp, banned boolean")
QUEUE = _schema("job_id string, url string, retry_after timestamp, created_at timestamp, last_error string")
SCHEMAS = {"companies": COMPANIES, "jobs": JOBS, "queue": QUEUE}
# What columns hold that older rows lack, and which columns an upsert of a job changes.
DEFAULTS = {"active": True, "apply_email": "", "aggregator_name": "", "apply_url": "", "apply_via_portal": False, "canonical_url": "", "hr_email": "", "hr_phone": "", "applied": False, "banned": False}
JOB_UPDATES = ["title", "url", "apply_url", "apply_via_portal", "location", "description", "hr_email", "hr_phone", "posted_at", "aggregator_name"]


def migrate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in a schema's columns and order: those it lacks get their default (else null); a column that the schema
    lacks is an error, as nothing may be lost."""
    extra = [c for c in df.columns if c not in schema.names]
    if extra:
        raise ValueError(f"columns {extra} aren't in the schema")
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields))


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small value as one indented JSON file, on any file system that Spark knows."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray((json.dumps(value, indent=2, ensure_ascii=False) + "\n").encode()))
    finally:
        out.close()


class Repo:
    """Companies, jobs and the queue of retries as versioned tables. Every change writes a new version, so one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        for name, schema in SCHEMAS.items():
            if not self.store.exists(name):
                self.store.write(name, spark.createDataFrame([], schema))
            elif self.store.read(name).schema.names != schema.names:
                self.store.write(name, migrate(self.store.read(name), schema))

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def _change(self, name: str, df: DataFrame) -> None:
        self.store.write(name, migrate(df, SCHEMAS[name]))

    # companies
    def upsert_companies(self, rows: DataFrame, now: Column) -> None:
        """By id; ``created_at`` stays."""
        new = migrate(rows, COMPANIES).withColumns({"created_at": now, "updated_at": now, "_pos": F.monotonically_increasing_id()})
        merged = R.upsert(self.table("companies"), new, ["id"], ["name", "careers_url", "active", "updated_at"], order="_pos")
        self._change("companies", merged)

    def upsert_companies_by_name(self, rows: DataFrame, now: Column) -> DataFrame:
        """By name; (name, id) of each, where an id that is there stays and a new one comes from the name."""
        new = migrate(rows.drop("id"), T.StructType([f for f in COMPANIES.fields if f.name != "id"])).withColumns({"id": key_id(F.lit("company"), F.col("name")), "created_at": now, "updated_at": now, "_pos": F.monotonically_increasing_id()})
        merged = R.upsert(self.table("companies"), new, ["name"], ["careers_url", "active", "updated_at"], order="_pos")
        self._change("companies", merged)
        return R.having(self.table("companies"), rows.select("name").distinct(), "name").select("name", "id")

    def list_companies(self) -> DataFrame:
        return R.active_sorted(self.table("companies"), F.col("active"), "name")

    # jobs
    def upsert_jobs(self, rows: DataFrame) -> DataFrame:
        """By company and canonical address; the rows whose company isn't there, which change nothing."""
        lost = R.rejects(rows, self.table("companies"), "company_id", "id")
        own = R.having(rows, self.table("companies").select(F.col("id").alias("company_id")), "company_id").withColumn("canonical_url", url.canonical_stored(F.col("url")))
        own = migrate(own.drop("id"), T.StructType([f for f in JOBS.fields if f.name != "id"])).withColumns({"id": key_id(F.lit("job"), F.col("company_id"), F.col("canonical_url")), "_pos": F.monotonically_increasing_id()})
        self._change("jobs", R.upsert(self.table("jobs"), own, ["company_id", "canonical_url"], JOB_UPDATES, order="_pos"))
        return lost

    def _marked(self, ids: list[str], values: dict[str, Column]) -> int:
        there = self.spark.createDataFrame([(i,) for i in ids], "id string")
        n = R.affected(self.table("jobs"), there, "id").first()[0]
        if n:
            self._change("jobs", R.update_by(self.table("jobs"), there, "id", values))
        return n

    def apply_jobs(self, ids: list[str], now: Column) -> int:
        return self._marked(ids, {"applied": F.lit(True), "applied_at": now})

    def ban_jobs(self, ids: list[str]) -> int:
        return self._marked(ids, {"banned": F.lit(True)})

    def delete_jobs(self, ids: list[str]) -> int:
        """The queue's entries of these jobs go too."""
        there = self.spark.createDataFrame([(i,) for i in ids], "id string")
        n = R.affected(self.table("jobs"), there, "id").first()[0]
        if n:
            self._change("jobs", R.delete_by(self.table("jobs"), there, "id"))
            self._change("queue", R.delete_by(self.table("queue"), there.toDF("job_id"), "job_id"))
        return n

    def jobs_page(self, query: R.JobQuery) -> tuple[DataFrame, int]:
        found = R.search(self.table("jobs"), self.table("companies"), query)
        return R.page(self.table("jobs"), self.table("companies"), self.table("queue"), query), found.count()

    def jobs(self, query: R.JobQuery) -> DataFrame:
        return self.jobs_page(query)[0]

    def jobs_by_ids(self, ids: list[str]) -> DataFrame:
        return R.multi_get(self.table("jobs"), ids, "id", JOBS.names)

    def job_url_exists(self, address: str) -> bool:
        key = self.spark.range(1).select(url.canonical_stored(F.lit(address)).alias("canonical_url"))
        return not R.having(self.table("jobs"), key, "canonical_url").isEmpty()

    # the queue of retries
    def enqueue(self, rows: DataFrame, now: Column) -> None:
        """By job_id (job_id, url, retry_after, last_error); ``created_at`` stays."""
        new = migrate(rows, QUEUE).withColumns({"created_at": now, "_pos": F.monotonically_increasing_id()})
        self._change("queue", R.upsert(self.table("queue"), new, ["job_id"], ["url", "retry_after", "last_error"], order="_pos"))

    def due(self, now: Column) -> DataFrame:
        return R.due(self.table("queue"), now)

    def dequeue(self, job_id: str) -> None:
        self._change("queue", R.delete_by(self.table("queue"), self.spark.createDataFrame([(job_id,)], "job_id string"), "job_id"))

    def postpone(self, job_id: str, until: Column) -> None:
        self._change("queue", R.postpone(self.table("queue"), self.spark.createDataFrame([(job_id,)], "job_id string"), until))

    def close(self) -> None:
        """Nothing is held open."""
