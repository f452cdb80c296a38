"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.sources.store import discard


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node of it) for every node that has an edge.

    Alternating large-star and small-star steps: each is an aggregation by minimum, which combines before the shuffle,
    and a join back whose hot side Spark can split. Every round's edges are written to the shared folder, and their
    number falls as stars form; at the end each node has one edge, to its component's smallest.
    """

    def step(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            least = e.groupBy("u").agg(F.min("v").alias("m"))
            moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            out = moved.unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def sign(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = sign(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        half = written(step(e, True), "edges")
        last, e = e, written(step(half, False), "edges")
        now = sign(e)
        discard(last)  # what it led to is written
        discard(half)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
