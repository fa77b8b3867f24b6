"""The corpus pipeline: quality classifier, language ID, n-gram near duplicates, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of docs. Every row is
decided by itself, also where doc_id is null or repeats; a null text is an empty one; an empty table gives an empty
result; columns besides doc_id, text, source and lang go along as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvest.llm import langid, ngram_join, packing, quality
from harvest.llm.common import table
from harvest.llm.queries import tokenizer

#: Word runs of five and a similarity of 0.8, as near-duplicate stages take.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Row keys (8 bytes each) that are broadcast at most, as counted; more meet the rows by a shuffle.
BROADCAST_KEYS = 1 << 20


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the co-trained quality classifier accepts; all of them where ``labels`` doesn't hold both classes."""
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is identified; those that the calibrated limit or ``und`` (no letter) rejects go."""
    return langid.identified(docs, langid.train(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of the smallest doc_id, one without an id only if none has one.

    Rows get a key, written with them, by which the operator and the choice tell them apart; texts without words stay.
    """
    rows = table(docs.withColumn("_h_row", F.monotonically_increasing_id()))
    groups = ngram_join.ngram_components(rows.select(F.col("_h_row").alias("doc_id"), "text"), NEAR_PERCENT, NEAR_WORDS)
    named = groups.select(F.col("doc_id").alias("_h_row"), "component_id").join(rows.select("_h_row", "doc_id"), "_h_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_h_row"))
    chosen = table(named.groupBy("component_id").agg(first.alias("m")).select(F.col("m._h_row").alias("_h_row")))
    few = chosen.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(chosen) if few else chosen, "_h_row", "left_semi").drop("_h_row")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in training sequences."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = table(docs)
    return docs
