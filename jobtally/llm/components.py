"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _state(edges: DataFrame) -> tuple:
    """What changes as long as the edges do: their number and an order-free checksum."""
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; the root is the smallest node it reaches.

    Large-star and small-star take turns: the first hangs the greater neighbours
    of each node on its smallest neighbour, the second its smaller ones, until
    every component is a star. A hub's rows are only grouped for a minimum,
    which is summed up before the shuffle, and joined, which Spark splits. Each
    round is a table in the shared folder. Loops count as nodes; null ends are left out.
    """
    edges = materialize(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).where("node is not null").distinct()
    edges = materialize(edges.where("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialize(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
