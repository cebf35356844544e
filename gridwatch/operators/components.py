"""Connected components within keys, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _star(e: DataFrame, keys: list[str], large: bool) -> DataFrame:
    """Edges (u, v) with u > v: a large star moves a node's larger neighbours to the least node around, a small star the smaller ones."""
    ends = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
    least = ends.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("u", "m").alias("m"))
    j = ends.join(least, [*keys, "u"])
    if large:
        return j.filter("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    return j.filter("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(*keys, "u", F.col("m").alias("v"))).filter("u <> v").distinct()


def least_reachable(edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """For each node of an edge (keys, a, b) that isn't the least of its component: node, least."""
    k = list(keys)
    e = written(edges.select(*k, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before, now = None, e.agg(F.count("*"), F.bit_xor(F.xxhash64(*k, "u", "v"))).first()
    while now != before and now[0]:
        e = written(_star(_star(e, k, True), k, False), "edges")
        before, now = now, e.agg(F.count("*"), F.bit_xor(F.xxhash64(*k, "u", "v"))).first()
    return e.select(*k, F.col("u").alias("node"), F.col("v").alias("least"))
