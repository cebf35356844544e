"""Connected components of an edge table, by alternating large and small stars.

Each node points to the smallest node that it has met; a large star moves a node's larger neighbours to
the smallest of all its neighbours, a small star does so for the smaller ones. Both keep the components,
and the edges end as one star per component. Every step is a group-by with partial sums and an
equi-join, so a node with very many edges is split over tasks like any skewed key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """edges: (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = scratch.write(least.select("u", F.least("u", "m").alias("m")), "star")
        moved = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = scratch.write(edges.groupBy("u").agg(F.min("v").alias("m")), "star")
        joined = edges.join(least, "u")
        moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge whose ends differ, as a table of ``scratch``; component is the smallest node reachable."""
    with Scratch(edges.sparkSession) as steps:
        e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
        e = steps.write(e, "edges")
        before = None
        while (now := _sum(e)) != before:
            before = now
            if not now[0]:
                break
            e = steps.write(_star(steps.write(_star(e, True, steps), "edges"), False, steps), "edges")
        stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return scratch.write(stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
