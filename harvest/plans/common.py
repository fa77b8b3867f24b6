"""What the catalogue's queries share: tables, literal tables for both engines, and the job-board view of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(columns: str, rows: list[tuple]) -> str:
    """A VALUES relation that Spark and DuckDB both read."""

    def lit(x) -> str:
        if x is None:
            return "NULL"
        return str(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({columns}))"


def literal(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """The same as a DataFrame; strings go through createDataFrame, so that no SQL escape applies."""
    return spark.createDataFrame(rows, columns.replace(" ", "").split(","))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("description"), F.lit("").alias("location"), (F.col("o_orderstatus") == "F").alias("applied"), F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("boolean")).otherwise(F.col("o_orderkey") % 11 == 0).alias("banned"), F.col("o_orderdate").alias("discovered_at"), F.col("o_totalprice").alias("price"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("name"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0")
    return o.select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderdate") + F.expr("INTERVAL 2 HOURS")).alias("retry_after"))


JOBS = "(SELECT o_orderkey AS id, o_custkey AS company_id, o_orderpriority AS title, o_orderstatus AS description, '' AS location, o_orderstatus = 'F' AS applied, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 11 = 0 END AS banned, o_orderdate AS discovered_at, o_totalprice AS price FROM orders)"
COMPANIES = "(SELECT c_custkey AS id, concat_ws(' ', c_name, c_mktsegment) AS name FROM customer)"
QUEUE = "(SELECT o_orderkey AS job_id, o_orderdate + INTERVAL 2 HOUR AS retry_after FROM orders WHERE o_orderkey % 5 = 0)"
#: The folded LIKE of the store in DuckDB; its LIKE knows no escape either.
ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
