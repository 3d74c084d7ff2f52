"""Connected components of an undirected graph, by alternating large-star and small-star steps.

Each step points nodes at the smallest neighbour; the edges shrink towards stars around each component's smallest node, in about
log^2 steps at most and two or three for the star-like graphs that near duplicates give. Every step is one aggregation and one
join (a hot node's edges can be split by adaptive execution) and is written to the shared folder, so no lineage builds up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Tables, removed, written


def _least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least of u and its neighbours v."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("u", "m"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def components(edges: DataFrame, tables: Tables, most_steps: int = 60) -> DataFrame:
    """edges (u, v), in any direction: one row per node, (node, label), label being the least node of its component.

    The table of the last step belongs to `tables`; those of earlier steps are deleted as soon as the next one stands.
    """
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    mark = _mark(edges)
    for _ in range(most_steps):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        near = _least(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        last, edges = edges, written(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        removed(last)
        if (new := _mark(edges)) == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    tables.held.append(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
