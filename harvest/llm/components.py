"""Connected components by contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in the edges (a, b): the smallest id that links reach.

    Each round points every vertex at the smallest of itself and its neighbours, follows these pointers to
    their roots by doubling, and contracts: of the roots that still have links, half at least go in each
    round, for chains as for stars. The min aggregates combine before they shuffle, so a hub is no hot key
    for them. Each step is cut off by a written table.
    """
    links = table(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b"))
    chain: DataFrame | None = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "id"))
        while True:
            further = step.select(F.col("id").alias("to"), F.col("to").alias("next")).where("to <> next")
            if step.join(further, "to", "left_semi").isEmpty():
                break
            done = step
            step = table(step.join(further, "to", "left").select("id", F.coalesce("next", "to").alias("to")))
            drop(done)
        if chain is None:
            chain = step
        else:
            moved = chain.withColumnRenamed("to", "mid").join(step.withColumnRenamed("id", "mid"), "mid", "left")
            chain = table(moved.select("id", F.coalesce("to", "mid").alias("to")))
        left, right = (step.select(F.col("id").alias(c), F.col("to").alias(f"{c}2")) for c in "ab")
        done = links
        links = table(links.join(left, "a").join(right, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct())
        drop(done)
    if chain is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return chain.select("id", F.col("to").alias("component"))
