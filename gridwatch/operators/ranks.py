"""Exact ranks and quantiles of any number of values: counts by value, range partitions, and offsets of partitions.

No task holds more than one range of distinct values, and what crosses ranges is a count per range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def cumulative(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """One row per key and distinct non-null value: its count, how many values of the key lie below it, and how many the key has."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("count"))
    ranged = written(counts.repartitionByRange(n, *keys, value).withColumn("part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy(*keys, "part").agg(F.sum("count").alias("size"))
    whole = Window.partitionBy(*keys)  # as many rows as ranges
    before = F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select(*keys, "part", F.coalesce(before, F.lit(0)).alias("offset"), F.sum("size").over(whole).alias("total"))
    inside = F.sum("count").over(Window.partitionBy(*keys, "part").orderBy(value)) - F.col("count")
    return ranged.withColumn("inside", inside).join(offsets, [*keys, "part"]).select(*keys, value, "count", (F.col("offset") + F.col("inside")).alias("below"), "total")


def quantiles(df: DataFrame, keys: tuple[str, ...], value: str, shares: tuple[float, ...]) -> DataFrame:
    """Per key with a value: ``q``, an array of the quantiles at ``shares``, by linear interpolation between the two values around each."""
    c = cumulative(df, keys, value)
    at = {i: F.lit(float(p)) * (F.col("total") - 1) for i, p in enumerate(shares)}
    here = lambda place: F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("count")), F.col(value)))
    found = c.groupBy(*keys).agg(F.max("total").alias("total"), *[here(f(x)).alias(f"{n}{i}") for i, x in at.items() for n, f in (("low", F.floor), ("high", F.ceil))])
    q = [F.when(F.col(f"low{i}") == F.col(f"high{i}"), F.col(f"low{i}")).otherwise((F.ceil(x) - x) * F.col(f"low{i}") + (x - F.floor(x)) * F.col(f"high{i}")) for i, x in at.items()]
    return found.select(*keys, F.array(*q).alias("q"))


def with_quantiles(stats: DataFrame, df: DataFrame, keys: tuple[str, ...], value: str, shares: tuple[float, ...]) -> DataFrame:
    """``stats`` with ``q``; null for keys without a value."""
    return stats.join(quantiles(df, keys, value, shares), list(keys), "left")


def average_ranks(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each value replaced by its rank within its column; ties share their mean rank. Rows must have every column."""
    rows = written(df.select(F.monotonically_increasing_id().alias("row"), *[F.col(c).cast("double").alias(c) for c in columns]), "rows")
    long = rows.unpivot(["row"], list(columns), "feature", "value")
    ranks = cumulative(long, ("feature",), "value").select("feature", "value", (F.col("below") + (F.col("count") + 1) / 2).alias("rank"))
    return long.join(ranks, ["feature", "value"]).groupBy("row").agg(*[F.max(F.when(F.col("feature") == c, F.col("rank"))).alias(c) for c in columns]).drop("row")
